"""Imports of title rows and of record lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.plans.export import Template


def read_titled(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a title row, every column as text; titles are trimmed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def map_titles(titled: DataFrame, template: Template, table: DataFrame, now: Column) -> DataFrame:
    """Rename titles to column keys, drop unknown titles and fill the time stamps the table has.

    A file without data rows is an error.
    """
    if titled.isEmpty():
        raise ValueError("the file must contain a title row and data")
    keys = {title: key for key, title in template.columns.items()}
    rows = titled.select(*[F.col(f"`{t}`").alias(keys[t]) for t in titled.columns if t in keys])
    for stamp in ("created_at", "updated_at"):
        if stamp in table.columns:
            given = F.col(stamp) if stamp in rows.columns else F.lit(None)
            rows = rows.withColumn(stamp, F.coalesce(given.cast("timestamp"), now))
    kinds = dict(table.dtypes)
    return rows.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in rows.columns])


def import_titled(spark: SparkSession, path: str, template: Template, table: DataFrame, now: Column) -> DataFrame:
    """The table with the rows of a titled file appended."""
    rows = map_titles(read_titled(spark, path), template, table, now)
    return table.unionByName(rows, allowMissingColumns=True)


def append_records(records: DataFrame, path: str) -> None:
    """Append a list of records to a table folder."""
    records.write.mode("append").parquet(path)
