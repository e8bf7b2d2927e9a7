"""Export and search driven by a stored template."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.functions.text import plain_number
from logharbor.functions.times import SECONDS
from logharbor.operators.filters import Condition, conjunction, is_blank, not_deleted
from logharbor.operators.joins import chain_join
from logharbor.operators.paging import checked_order, window_of


@dataclass(frozen=True)
class Join:
    """One joined table: kind is LEFT JOIN, INNER JOIN or RIGHT JOIN."""

    kind: str
    table: str
    on: str


@dataclass(frozen=True)
class Template:
    """A stored export: ordered {column expression: title}, joins, conditions, limit and order."""

    name: str
    table: str
    info: str
    joins: Sequence[Join] = ()
    conditions: Sequence[Condition] = ()
    limit: int | None = None
    order: str | None = None
    columns: Mapping[str, str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", json.loads(self.info))


def _expression(text: str) -> str:
    return text.replace('"', "").replace("`", "")


def export_rows(template: Template, tables: Mapping[str, DataFrame], params: Mapping[str, Any]) -> DataFrame:
    """The rows a template selects, typed, one column per title in template order.

    ``params`` may hold condition values, ``limit``, ``offset``, ``order`` and
    ``filterDeleted``. Condition columns and the order column may be qualified
    only where the joined tables share names; the order column must belong to
    the main table.
    """
    main = tables[template.table]
    joined = chain_join(main, template.table, [(j.kind, j.table, tables[j.table], j.on) for j in template.joins])
    if str(params.get("filterDeleted", "")).lower() == "true":
        for name in [template.table, *[j.table for j in template.joins]]:
            if "deleted_at" in tables[name].columns:
                joined = joined.filter(F.col(f"{name}.deleted_at").isNull())
    rows = joined.filter(conjunction(template.conditions, params))

    wanted = params.get("order")
    checked_order(main, wanted, template.order)
    order = []
    if wanted or template.order:
        column, *direction = (wanted or template.order).split(" ")
        name = F.col(f"{template.table}.{column}")
        order = [name.desc() if direction == ["desc"] else name.asc()]
    limit, offset = params.get("limit"), params.get("offset")
    rows = window_of(
        rows,
        order,
        None if is_blank(limit) else int(limit),
        None if is_blank(offset) else int(offset),
        template.limit,
    )
    return rows.select(
        *[F.expr(_expression(e).split(" as ")[0].strip()).alias(title) for e, title in template.columns.items()]
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: seconds for times, plain numbers, NULL stays NULL."""

    def text(f: T.StructField):
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, SECONDS)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            column = plain_number(column.cast("double"))
        return column.cast("string").alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def export(template: Template, tables: Mapping[str, DataFrame], params: Mapping[str, Any]) -> DataFrame:
    """export_rows as text, ready for a titled file."""
    return as_text(export_rows(template, tables, params))


def titles(template: Template, tables: Mapping[str, DataFrame]) -> DataFrame:
    """No rows, only the titles."""
    return export(template, tables, {}).limit(0)


__all__ = ["Condition", "Join", "Template", "as_text", "export", "export_rows", "not_deleted", "titles"]
