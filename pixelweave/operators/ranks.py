"""Global ranks and prefix sums of sorted rows, without a window over a large group."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pixelweave.sources import staging


def _running(value: str) -> object:
    """Rows of one sorted partition with the partition's number and the sum of a column before each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + np.cumsum(v) - v, pa.int64())], names=[*b.schema.names, "_sum"])
            total += int(v.sum())

    return run


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{i}"]) for i, k in enumerate(keys)))


def before(df: DataFrame, keys: list[str], order: list[str], name: str, value: str | None = None) -> DataFrame:
    """Add the number of rows before each row in its group, or the sum of a column of whole, not negative numbers over them.

    A range shuffle sorts all rows by keys and order, so a large group lies in many partitions; each
    partition counts from zero, and what a group has in the partitions before (one row for each group
    and partition) is added. The order must be total, else tied rows may fall either way; rows that
    tie in all columns of keys and order stay in one partition.
    """
    spark, columns = df.sparkSession, df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    if value is None:
        placed = dealt.withColumn("_sum", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))  # the row's number in its partition
    else:
        placed = dealt.mapInArrow(_running(value), StructType([*dealt.schema, StructField("_sum", LongType())]))
    path = f"{staging.shared_dir(spark)}/ranks-{uuid.uuid4().hex}"
    staging.until_exit(spark, path)
    at = staging.staged(placed, path)  # the partitions must not be dealt anew
    own = F.lit(1) if value is None else F.col(value)
    runs = at.groupBy(*keys, "_part").agg(F.min("_sum").alias("_first"), F.sum(own).cast("long").alias("_total"))
    earlier = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = runs.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    on = at["_part"] == base["_p"]
    on = on & _same(at, base, keys) if keys else on
    return at.join(base, on).select(*(at[c] for c in columns), (F.col("_sum") + F.col("_shift")).alias(name))


def percentiles(df: DataFrame, keys: list[str], value: str, ties: list[str], at: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: rows (keys, p, value). `ties` makes the order of equal values total.

    Only the rows whose rank a percentile asks for are gathered. Nulls don't count.
    """
    ranked = before(df.where(F.col(value).isNotNull()).select(*keys, value, *ties), keys, [value, *ties], "_rank")
    place = F.col("p") * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    wanted = ranked.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, "_n", F.explode(F.array(*(F.lit(float(p)) for p in at))).alias("p"))
    ends = F.array(
        F.struct(low.alias("r"), F.when(low == high, 1.0).otherwise(high - place).alias("w")),
        F.struct(high.alias("r"), (place - low).alias("w")),
    )
    wanted = wanted.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "p", F.explode(ends).alias("e"))
    on = ranked["_rank"] == wanted["e.r"]
    on = on & _same(ranked, wanted, keys) if keys else on
    return ranked.join(wanted, on).groupBy(*(ranked[k] for k in keys), "p").agg(F.sum(F.col("e.w") * F.col(value)).alias(value))
