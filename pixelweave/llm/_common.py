"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BATCH = 1 << 20  # bytes of text that are worked on at once, about; a longer text counts alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in one process may it be one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The lineage ends there: lost executors cost a read, not a recomputation. The files go
    when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def large_rows(spark: SparkSession):
    """For what runs inside, few rows are read at a time, and few bytes sent to Python."""
    return _settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "4"})


def small_batches(spark: SparkSession):
    """For what runs inside, Python gets few bytes at a time, however long the rows."""
    return _settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"})


def shuffles_removed(spark: SparkSession):
    """Shuffle files of a table that is staged inside go, on all executors, once it is written."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, so that memory doesn't follow the rows of a batch."""
    ends = text_bytes(batch.column(column))[1][1:]
    s = 0
    while s < batch.num_rows:
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield batch.slice(s, e - s)
        s = e


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "text") -> DataFrame:
    """Apply a function to slices of Arrow batches with a bounded amount of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text):
                yield f(part)

    return df.mapInArrow(run, schema)


def with_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], list[pa.Array]], columns: str, text: str) -> DataFrame:
    """Append columns that a function makes of slices of Arrow batches.

    The rows keep their order and other columns; a column of an appended one's name gives way to it.
    """
    names, added = df.columns, StructType.fromDDL(columns)
    own = [StructField(f"_{k}", f.dataType, f.nullable) for k, f in enumerate(df.schema)]
    new = [StructField(f"_{len(own) + k}", f.dataType) for k, f in enumerate(added)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = f(batch.rename_columns(names))
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[x.name for x in (*own, *new)])

    done = map_arrow(df.toDF(*(x.name for x in own)), run, StructType([*own, *new]), f"_{names.index(text)}")
    return done.select(
        *(F.col(x.name).alias(n) for x, n in zip(own, names, strict=True) if n not in added.names),
        *(F.col(x.name).alias(a.name) for x, a in zip(new, added, strict=True)),
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of bytes and the offsets of its rows (null: empty)."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % modulus


def ids_only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names; whatever else the table holds is left out."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that a table doesn't have, made from those given."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def kind_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]
