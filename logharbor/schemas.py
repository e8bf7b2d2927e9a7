"""Explicit schemas of the landed and stored records, as DDL text."""

VENDOR_A_RAW = (
    "contentCollection STRUCT<content STRING, host STRING, index_name STRING, level STRING,"
    " search_time_ms STRING, search_total_hits STRING, search_type STRING, shard_id STRING,"
    " slow_search_log_type STRING, time STRING, total_shards STRING>,"
    " host STRING, instanceId STRING, `timestamp` BIGINT"
)

VENDOR_B_RAW = ("content STRING, `date` STRING, level STRING")

CLUSTER_DETAIL = (
    "id STRING, instances ARRAY<STRUCT<id STRING, name STRING, type STRING>>"
)

SLOW_LOG = (
    "doc_id STRING, eventTime STRING, `@timestamp` BIGINT, queryText STRING,"
    " queryTemplate STRING, checkSum STRING, dslHash STRING, dslFormat STRING,"
    " durationMs DOUBLE, indexName STRING, nodeIP STRING, nodeName STRING, instanceId STRING,"
    " level STRING, searchHits DOUBLE, searchType STRING, shardId BIGINT,"
    " slowSearchType STRING, shardTotal BIGINT, taskId STRING"
)

HOT_THREADS = (
    "`@timestamp` BIGINT, esTag STRING, instanceId STRING, usagePercent ARRAY<DOUBLE>,"
    " rawText STRING, hotInterval STRING, hotThreads INT, hotType STRING"
)

AUDIT = (
    "ip STRING, method STRING, path STRING, status INT, latency BIGINT, agent STRING,"
    " error_message STRING, body STRING, resp STRING, user_id INT"
)
