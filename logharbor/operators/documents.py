"""Raw vendor records to the common slow-log document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.functions import (
    bracket_fields,
    doc_id_a,
    doc_id_b,
    dsl_format,
    epoch_millis,
    extract_source,
    fingerprint,
    is_json,
    iso_millis,
    lenient_double,
    lenient_long,
    line_header,
    mask_dsl,
    parse_event_time,
    usage_percentages,
)


def with_template(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Add queryTemplate, dslFormat, checkSum and dslHash to rows with queryText.

    Validity, template and fingerprint are three projections: each result is
    used twice further on, and Spark then keeps it instead of computing it anew.
    """
    text = F.col("queryText")
    checked = df.withColumn("_valid", is_json(text))
    masked = checked.withColumns(
        {"queryTemplate": mask_dsl(text, mode, F.col("_valid")), "dslFormat": dsl_format(F.col("_valid"))}
    )
    return masked.withColumns(
        {"checkSum": fingerprint(F.col("queryTemplate")), "dslHash": fingerprint(text)}
    ).drop("_valid")


def flatten_a(raw: DataFrame, task: str = "", mode: str = "strict") -> DataFrame:
    """Vendor A raw rows to documents; a row whose time is malformed is dropped."""
    return _identified_a(with_template(_flat_a(raw), mode), task)


def fields_a(raw: DataFrame, task: str = "") -> DataFrame:
    """flatten_a without what masking finds out: all that tells documents and their versions apart.

    ``with_template`` makes these rows the documents of ``flatten_a``, so it can wait until it is settled which of them are kept.
    """
    return _identified_a(_flat_a(raw).withColumn("dslHash", fingerprint(F.col("queryText"))), task)


def _flat_a(raw: DataFrame) -> DataFrame:
    c = "contentCollection"
    flat = raw.select(
        parse_event_time(F.col(f"{c}.time")).alias("_t"),
        F.coalesce("timestamp", F.lit(0)).alias("@timestamp"),
        _text(f"{c}.content").alias("queryText"),
        lenient_double(F.col(f"{c}.search_time_ms")).alias("durationMs"),
        _text(f"{c}.index_name").alias("indexName"),
        _text(f"{c}.host").alias("nodeIP"),
        _text("instanceId").alias("instanceId"),
        _text(f"{c}.level").alias("level"),
        lenient_double(F.col(f"{c}.search_total_hits")).alias("searchHits"),
        _text(f"{c}.search_type").alias("searchType"),
        lenient_long(F.col(f"{c}.shard_id")).alias("shardId"),
        _text(f"{c}.slow_search_log_type").alias("slowSearchType"),
        lenient_long(F.col(f"{c}.total_shards")).alias("shardTotal"),
    ).filter("_t IS NOT NULL")
    return flat.withColumn("eventTime", iso_millis(F.col("_t"))).drop("_t")


def _identified_a(documents: DataFrame, task: str) -> DataFrame:
    return documents.withColumns(
        {
            "taskId": F.lit(task),
            "doc_id": doc_id_a(
                F.col("`@timestamp`"), F.col("nodeIP"), F.col("indexName"), F.col("durationMs"), F.col("instanceId")
            ),
        }
    )


def parse_b(raw: DataFrame, task: str = "", mode: str = "strict") -> DataFrame:
    """Vendor B text lines to documents.

    A row is dropped when its time is malformed or no query object is found.
    ``raw`` carries the cluster as a column.
    """
    line = F.col("content")
    parsed = (
        raw.select(
            line,
            parse_event_time(F.col("date")).alias("_t"),
            _text("level").alias("level"),
            _text("cluster").alias("instanceId"),
        )
        .filter("_t IS NOT NULL")
        # Unfolding an array of nought or one drops the NULL rows like a filter would, but a
        # filter would be pushed below the projection and extract every text a second time.
        .select("*", F.explode(F.array_compact(F.array(extract_source(line)))).alias("queryText"))
        .withColumns({**line_header(line), **bracket_fields(line)})
        .withColumns({"eventTime": iso_millis(F.col("_t")), "@timestamp": epoch_millis(F.col("_t"))})
        .drop("content", "_t")
    )
    return with_template(parsed, mode).withColumns(
        {
            "taskId": F.lit(task),
            "doc_id": doc_id_b(
                F.col("eventTime"), F.col("nodeName"), F.col("indexName"), F.col("durationMs"), F.col("instanceId")
            ),
        }
    )


def parse_dump(dumps: DataFrame, instances: DataFrame, now_millis: Column) -> DataFrame:
    """Thread dumps (instanceId, rawText) with the settings of their instance."""
    return dumps.join(instances, "instanceId").select(
        now_millis.alias("@timestamp"),
        "esTag",
        "instanceId",
        usage_percentages(F.col("rawText")).alias("usagePercent"),
        "rawText",
        "hotInterval",
        "hotThreads",
        "hotType",
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
