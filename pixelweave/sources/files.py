"""Files of a folder tree as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.operators import catalogue


def walk(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """All files below a folder with one of the extensions, in any case: (path, below, length, modificationTime).

    `below` is the path from the root on, to mirror the tree elsewhere. Contents are not read: the
    scan prunes that column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = catalogue.with_extension(files.select("path", "length", "modificationTime"), *extensions)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    start = F.locate(f"/{base}/", F.col("path")) + len(base) + 2
    return found.select("path", F.substr("path", start).alias("below"), "length", "modificationTime")
