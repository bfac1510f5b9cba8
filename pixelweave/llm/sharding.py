"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, staged, table

OVERHEAD = 16  # bytes a row takes besides its text
WHOLE = 0.05  # a group of equal texts stays whole up to this share of a shard (or the largest row)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bytes before each row within its partition."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        before = total + np.cumsum(size) - size
        names = [*batch.schema.names, "part", "row_at", "byte_at"]
        n = batch.num_rows
        extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(before)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)
        rows, total = rows + n, total + int(size.sum())


def shards_by_bytes(
    docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, whole: float = WHOLE
) -> DataFrame:
    """Deal documents into contiguous shards of near equal size.

    The global order is (hash of text, id), so equal texts lie side by side. A range shuffle sorts
    the rows; each partition sums its bytes; the totals of the partitions (one number each) give
    the global prefix sums, and a row goes to the shard in which its middle byte falls. A group of
    equal texts that straddles a cut stays whole if it is no larger than `whole` of a shard or
    than the largest row; there are at most `shards` - 1 such groups.

    Returns id, size (UTF-8 bytes plus `overhead`), text_crc32, shard and slot (the row's place in
    its shard, gapless from 0). Null texts count as empty, null ids sort first, repeated rows each
    get a slot, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    rows = ids_only(docs, id=doc_id, text=text).select(
        "id",
        F.xxhash64(body).alias("h"),
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "h", "id", "size").sortWithinPartitions("h", "id", "size")
    kind = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    at = staged(ordered.mapInArrow(_running, f"{kind}, part int, row_at bigint, byte_at bigint"))
    # one row a partition: bounded by the number of partitions, not by the data
    totals = at.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("m")).orderBy("part").collect()
    if not totals:
        return at.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n0, b0 = np.cumsum([0, *(r.n for r in totals)]), np.cumsum([0, *(r.b for r in totals)])
    total = int(b0[-1])
    starts = spark.createDataFrame([(r.part, int(n0[i]), int(b0[i])) for i, r in enumerate(totals)], "part int, n0 long, b0 long")
    # compared as integers: 2 * shards * middle // (2 * total)
    middle = (F.col("b0") + F.col("byte_at")) * 2 + F.col("size")
    placed = at.join(F.broadcast(starts), "part").select(
        "h", "id", "size", "text_crc32", (F.col("n0") + F.col("row_at")).alias("row_at"),
        F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int")).alias("shard"),
    )
    limit = max(int(whole * total / shards), max(r.m for r in totals))
    # rows of a group are side by side, so at most one group lies on each cut
    cut = (
        placed.groupBy("h").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.sum("size").alias("bytes"))
        .where((F.col("lo") < F.col("hi")) & (F.col("bytes") <= limit)).select("h", "lo")
    )
    cut = spark.createDataFrame(cut.limit(shards).collect(), "h long, lo int")
    placed = placed.join(F.broadcast(cut), "h", "left").withColumn("shard", F.coalesce("lo", "shard")).drop("lo")
    firsts = placed.groupBy("shard").agg(F.min("row_at").alias("first")).collect()  # one row a shard
    firsts = spark.createDataFrame([(r["shard"], r["first"]) for r in firsts], "shard int, first long")
    return placed.join(F.broadcast(firsts), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("row_at") - F.col("first")).alias("slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shards_by_bytes(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
