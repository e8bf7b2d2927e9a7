"""Rule-based row validation as a data-quality job."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_EMPTY = "notEmpty"
_COMPARE = {
    "lt": operator.lt,
    "le": operator.le,
    "eq": operator.eq,
    "ne": operator.ne,
    "ge": operator.ge,
    "gt": operator.gt,
}

Rules = Mapping[str, Sequence[str]]


def _measure(column: Column, kind: T.DataType) -> Column | None:
    """What comparisons look at: length of text and arrays, value of numbers."""
    if isinstance(kind, T.StringType):
        return F.char_length(column)
    if isinstance(kind, T.ArrayType):
        return F.size(column)
    if isinstance(kind, T.NumericType):
        return column
    return None


def _not_empty(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return column
    size = _measure(column, kind)
    return column.isNotNull() if size is None else size != 0


def check(column: Column, kind: T.DataType, rule: str) -> Column:
    """True when the value meets the rule; NULL never does."""
    name, _, argument = rule.partition("=")
    if name == NOT_EMPTY:
        passed = _not_empty(column, kind)
    elif name == "regexp":
        passed = F.rlike(column.cast("string"), F.lit(argument))
    elif name in _COMPARE:
        size = _measure(column, kind)
        if size is None:
            return F.lit(False)
        limit = float(argument) if isinstance(kind, T.FractionalType) else int(argument)
        passed = _COMPARE[name](size, F.lit(limit))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.coalesce(passed, F.lit(False))


def _walk(schema: T.StructType, rules: Rules, prefix: str = "") -> Iterator[tuple[str, str, Column]]:
    """(field, rule, passed) in schema order, the fields of a struct before the struct itself."""
    for field in schema.fields:
        path = f"{prefix}`{field.name}`"
        if isinstance(field.dataType, T.StructType):
            yield from _walk(field.dataType, rules, f"{path}.")
        for rule in rules.get(field.name, ()):
            yield field.name, rule, check(F.col(path), field.dataType, rule)


def with_violation(df: DataFrame, rules: Rules, name: str = "violation") -> DataFrame:
    """Add the first broken rule of each row as struct(field, rule); NULL when the row passes."""
    broken = [
        F.when(~passed, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
        for field, rule, passed in _walk(df.schema, rules)
    ]
    none = F.lit(None).cast("struct<field:string,rule:string>")
    return df.withColumn(name, F.coalesce(*broken, none))


def violations(df: DataFrame, rules: Rules, keys: Sequence[str]) -> DataFrame:
    """One row (keys, field, rule) per row that fails, with its first broken rule."""
    return (
        with_violation(df, rules)
        .filter("violation IS NOT NULL")
        .select(*keys, "violation.field", "violation.rule")
    )


def all_violations(df: DataFrame, rules: Rules, keys: Sequence[str]) -> DataFrame:
    """One row (keys, field, rule) per broken rule."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~passed, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))
                for field, rule, passed in _walk(df.schema, rules)
            ]
        )
    )
    return df.select(*keys, F.inline(broken))


def violation_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """How many rows break each rule: one pass and one row per rule, no row-level shuffle."""
    walked = list(_walk(df.schema, rules))
    totals = df.agg(*[F.count_if(~passed).alias(f"r{i}") for i, (_, _, passed) in enumerate(walked)])
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.col(f"r{i}").alias("failed"))
                    for i, (f, r, _) in enumerate(walked)
                ]
            )
        )
    )


def split_by_rules(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail)."""
    marked = with_violation(df, rules)
    passed = marked.filter("violation IS NULL").drop("violation")
    return passed, marked.filter("violation IS NOT NULL").drop("violation")
