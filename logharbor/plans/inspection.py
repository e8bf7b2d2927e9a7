"""The daily inspection report: slow query shapes with counts, durations and an example."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.functions.times import display_time
from logharbor.operators.aggregates import rounded, sampled_buckets, top_hits
from logharbor.operators.filters import slow_for_source
from logharbor.operators.joins import UNNAMED, map_label


def slow_buckets(docs: DataFrame, thresholds: Mapping[str, float], limit: int | None = None) -> DataFrame:
    """Buckets by brand and fingerprint of what is slow for its brand: one scan and one aggregate for all brands.

    With a limit only the largest counts of each brand stay; ties go to the smaller fingerprint.
    """
    slow = docs.filter(slow_for_source(F.col("brand"), F.col("durationMs"), thresholds))
    buckets = rounded(sampled_buckets(slow, ("brand", "checkSum")))
    if limit is None:
        return buckets
    return top_hits(buckets, ["brand"], [F.desc("doc_count"), F.asc("checkSum")], limit)


def inspection_report(
    docs: DataFrame,
    day: str,
    thresholds: Mapping[str, float],
    names: Mapping[str, str],
    now: Column,
    limit: int | None = None,
) -> DataFrame:
    """Report rows of all sources for one ingest day.

    ``thresholds`` gives the duration from which a query of a brand is slow,
    ``names`` the configured instance names. All shapes are reported unless a limit per brand is given.
    """
    today = docs.filter(F.col("ingest_date") == day)
    buckets = slow_buckets(today, thresholds, limit)
    instance = F.col("sample.instanceId")
    return buckets.select(
        "brand",
        F.col("sample.indexName").alias("DBName"),
        F.col("sample.queryText").alias("SQLText"),
        F.col("checkSum").alias("sqlhash"),
        display_time(F.col("sample.`@timestamp`")).alias("sqltime"),
        now.alias("__time__"),
        F.lit("").alias("__source__"),
        map_label(instance, names, F.concat(F.lit(UNNAMED), instance)).alias("DBInstanceName"),
        F.col("max_duration").alias("MaxExecutionTime"),
        F.col("avg_duration").alias("AverageExecutionTime"),
        F.col("doc_count").alias("MySQLTotalExecutionCounts"),
    )
