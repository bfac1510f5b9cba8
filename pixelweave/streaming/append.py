"""Result rows appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_results(rows: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append the rows of a stream to a Parquet table, each exactly once.

    After a failure the query goes on where it was: the file sink's log and the checkpoint say what
    has been written. With `once` it ends when all there is has been read.
    """
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
