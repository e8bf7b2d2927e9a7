"""CSV files with a title row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_titled(df: DataFrame, path: str) -> None:
    """All rows as text below their titles. Large results stay split over several files."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_header(df: DataFrame, path: str) -> None:
    """The title row alone."""
    write_titled(df.limit(0), path)
