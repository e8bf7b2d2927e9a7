"""Document identity and number rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(number: Column) -> Column:
    """Double to bigint, cutting toward zero; beyond its range the nearest bigint, and 0 for NaN."""
    number = number.cast("double")
    low, high = F.lit(-(1 << 63)).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")
    return (
        F.when(F.isnan(number), F.lit(0).cast("bigint"))
        .when(number >= 2.0**63, high)
        .when(number <= -(2.0**63), low)
        .otherwise(number.try_cast("bigint"))
    )


def round_cents(number: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(number * 100) / 100


def _join(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def doc_id_a(timestamp: Column, ip: Column, index: Column, duration: Column, instance: Column) -> Column:
    """Identity of a vendor A record; the dots of the address become underscores."""
    return _join(timestamp, F.replace(ip, F.lit("."), F.lit("_")), index, truncate(duration), instance)


def doc_id_b(event_time: Column, node: Column, index: Column, duration: Column, cluster: Column) -> Column:
    """Identity of a vendor B record."""
    return _join(event_time, node, index, truncate(duration), cluster)
