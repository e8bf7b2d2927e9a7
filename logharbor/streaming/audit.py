"""Audit records from request rows; the same projection serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions.jsontext import query_string_json
from logharbor.functions.text import guard_body


def audit_records(requests: DataFrame) -> DataFrame:
    """Requests (ip, method, path, query, body, content_type, status, started, ended, user_id) as audit rows.

    A GET stores its query string as JSON, other methods their body, both
    guarded by size; latency is in nanoseconds.
    """
    body = F.when(F.upper("method") == "GET", query_string_json(F.col("query"))).otherwise(F.col("body"))
    return requests.select(
        "ip",
        "method",
        "path",
        "status",
        ((F.unix_micros("ended") - F.unix_micros("started")) * 1000).alias("latency"),
        guard_body(body, F.coalesce("content_type", F.lit(""))).alias("body"),
        F.coalesce(F.col("user_id").try_cast("int"), F.lit(0)).alias("user_id"),
    )
