"""Result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixelweave.operators.catalogue import result_table


def write_results(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV part files with a fixed header; read by name, they are in total order."""
    result_table(rows, columns, order).write.mode("overwrite").option("header", True).csv(path)
