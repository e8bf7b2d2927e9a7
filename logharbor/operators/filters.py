"""Predicates built from request values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.operators.joins import keys_of

_WORD = r"[\p{L}\p{N}_]"


def is_blank(value: Any) -> bool:
    """Request values that mean "not given": None, '', 0 and empty lists. False is a value."""
    return value is None or (value is not False and value in ("", 0)) or value == [] or value == ()


def is_missing(value: Any) -> bool:
    """Stored conditions take every value but None, '' and empty lists; zero is a value there."""
    return value is None or (isinstance(value, str) and value == "") or value == [] or value == ()


def like_contains(column: Column, value: str) -> Column:
    """``LIKE '%value%'``: the wildcards in the value stay wildcards."""
    return column.like(f"%{value}%")


def closed_range(column: Column, low: Any = None, high: Any = None) -> Column:
    """Closed range with optional ends; 0 and blank ends are open."""
    bounds = []
    if not is_blank(low):
        bounds.append(column >= F.lit(low))
    if not is_blank(high):
        bounds.append(column <= F.lit(high))
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def required_range(column: Column, low: Any, high: Any) -> Column:
    """Closed range whose ends must both be given."""
    if is_blank(low) or is_blank(high):
        raise ValueError("both ends of the time range are required")
    return column.between(F.lit(low), F.lit(high))


def query_terms(query: str) -> list[str]:
    """The distinct words of a query, lower-cased."""
    return sorted({t for t in re.split(r"[^\w]+", query.lower()) if t})


def match_any_term(column: Column, query: str) -> Column:
    """True when any word of the query occurs as a whole word in the text."""
    terms = query_terms(query)
    if not terms:
        return F.lit(False)
    words = "|".join(re.escape(t) for t in terms)
    return F.rlike(F.lower(column), F.lit(rf"(?<!{_WORD})(?:{words})(?!{_WORD})"))


def _pair(value: Any) -> tuple[Any, Any]:
    if not isinstance(value, Sequence) or isinstance(value, str) or len(value) != 2:
        raise ValueError("BETWEEN takes two values")
    return F.lit(value[0]), F.lit(value[1])


# Operator name of a stored condition -> predicate.
PREDICATES = {
    "=": lambda c, v: c == F.lit(v),
    "<>": lambda c, v: c != F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "LIKE": like_contains,
    "BETWEEN": lambda c, v: c.between(*_pair(v)),
    "NOT BETWEEN": lambda c, v: ~c.between(*_pair(v)),
    "IN": lambda c, v: c.isin([v] if isinstance(v, str) or not isinstance(v, Sequence) else list(v)),
    "MATCH": match_any_term,
}


class Condition(NamedTuple):
    """One optional search condition: the request key, the column and the operator."""

    key: str
    column: str
    operator: str = "="


def conjunction(conditions: Sequence[Condition], request: Mapping[str, Any], absent=is_missing) -> Column:
    """AND of the conditions whose request value is given; ``absent`` tells which are not."""
    given = [
        PREDICATES[c.operator](F.col(c.column), request[c.key])
        for c in conditions
        if not absent(request.get(c.key))
    ]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def search(df: DataFrame, conditions: Sequence[Condition], request: Mapping[str, Any]) -> DataFrame:
    """Rows that meet every given condition."""
    return df.filter(conjunction(conditions, request))


def search_slow_logs(df: DataFrame, request: Mapping[str, Any]) -> DataFrame:
    """Slow-log search: required event time range, everything else optional."""
    when = required_range(F.col("eventTime"), request.get("startTime"), request.get("endTime"))
    duration = closed_range(F.col("durationMs"), request.get("minDurationMs"), request.get("maxDurationMs"))
    return df.filter(when & duration & conjunction(SLOW_LOG_CONDITIONS, request, is_blank))


SLOW_LOG_CONDITIONS = (
    Condition("queryText", "queryText", "MATCH"),
    Condition("indexName", "indexName"),
    Condition("nodeIP", "nodeIP"),
    Condition("instanceId", "instanceId"),
    Condition("level", "level"),
    Condition("searchHits", "searchHits", ">="),
    Condition("searchType", "searchType"),
    Condition("slowSearchType", "slowSearchType"),
)

# Field types of a generated table that take no search condition.
UNSEARCHABLE = frozenset({"picture", "pictures", "video", "json", "richtext", "array"})


def typed_condition(key: str, column: str, field_type: str, operator: str) -> Condition | None:
    """Search condition of a generated field, or None when its type takes none."""
    if not operator or field_type in UNSEARCHABLE:
        return None
    if field_type == "enum" and operator in ("BETWEEN", "NOT BETWEEN"):
        raise ValueError("an enum takes no range search")
    return Condition(key, column, operator)


def type_or_id(df: DataFrame, kind: str | None, ident: Any, status: bool | None = None) -> DataFrame:
    """``(type = ? OR id = ?) AND status = ?``; a status that is not given means true."""
    wanted = True if status is None else status
    return df.filter(((F.col("type") == kind) | (F.col("id") == ident)) & (F.col("status") == wanted))


def not_deleted(df: DataFrame, alias: str | None = None) -> DataFrame:
    """Drop soft-deleted rows when the table has the stamp column."""
    if "deleted_at" not in df.columns:
        return df
    name = f"{alias}.deleted_at" if alias else "deleted_at"
    return df.filter(F.col(name).isNull())


def slow_for_source(source: Column, value: Column, thresholds: Mapping[str, float]) -> Column:
    """Severity threshold with one limit per source."""
    return reduce(
        lambda a, b: a | b,
        [(source == F.lit(name)) & (value >= F.lit(limit)) for name, limit in thresholds.items()],
        F.lit(False),
    )


def in_data_scope(df: DataFrame, owner: str, scopes: DataFrame, caller: str, role: Any) -> DataFrame:
    """Rows whose owner role is in the data scope of the caller's role.

    ``scopes`` holds (caller role, visible role) links.
    """
    visible = keys_of(scopes.filter(F.col(caller) == role), owner)
    return df.join(visible, owner, "left_semi")


def not_listed(df: DataFrame, denied: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key is not on the deny list."""
    return df.join(keys_of(denied, on), on, "left_anti")


def first_match(df: DataFrame, predicate: Column, order: Sequence[str]) -> DataFrame:
    """The first row that meets the predicate."""
    return df.filter(predicate).orderBy(*order).limit(1)
