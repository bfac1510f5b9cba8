"""Tables written to the folder that driver and executors share, where a long job's lineage ends."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, spark.checkpoint.dir. Only in one process may it be one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the session's JVM ends."""
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)


def staged(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Write a table and read it back."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
