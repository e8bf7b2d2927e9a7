"""Report rows in their envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelopes(report: DataFrame, date: Column, business: str, kind: str, name: str) -> DataFrame:
    """Each report row as one JSON text inside its envelope."""
    envelope = F.struct(
        date.alias("Date"),
        F.lit(business).alias("BusinessType"),
        F.lit(kind).alias("InspectionType"),
        F.lit(name).alias("InspectionName"),
        F.struct(*report.columns).alias("InspectionResult"),
    )
    return report.select(F.to_json(envelope).alias("payload"))


def write_report(payloads: DataFrame, path: str) -> None:
    """One JSON document per line. Delivery over the network is the caller's foreachBatch."""
    payloads.write.mode("overwrite").text(path)
