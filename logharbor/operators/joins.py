"""Lookups, preloads and key-set checks.

No join here carries a broadcast hint: Spark broadcasts a side when its known
size is below the session's threshold, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.operators.ranking import rank_within

# Fixed value: label in front of the id of an unnamed instance.
UNNAMED = "未命名实例-"

JOIN_KINDS = {"LEFT JOIN": "left", "INNER JOIN": "inner", "RIGHT JOIN": "right"}


def chain_join(main: DataFrame, name: str, steps: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """Join tables one after the other on free conditions.

    Each step is (kind, alias, table, condition); kind is a JOIN_KINDS key.
    """
    joined = main.alias(name)
    for kind, alias, table, condition in steps:
        if kind not in JOIN_KINDS:
            raise ValueError(f"unknown join kind {kind!r}")
        joined = joined.join(table.alias(alias), F.expr(condition), JOIN_KINDS[kind])
    return joined


def attach_one(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Belongs-to: add the matching row of other as a struct; NULL when there is none."""
    packed = other.select(F.col(other_key).alias(key), F.struct(*other.columns).alias(name))
    return df.join(packed, key, "left")


def keys_of(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The distinct keys of a table: what a semi or anti join needs of its right side.

    Copies of a hot key shrink before the shuffle, and the join reuses the partitioning.
    """
    return df.select(*([key] if isinstance(key, str) else key)).distinct()


def numbered(children: DataFrame, key: str, fields: Sequence[str], position: str = "position") -> DataFrame:
    """Children of each key in the order of the fields, one row each, numbered from 0.

    The same form for any number of children: a hot key is ranked over range partitions.
    """
    ranked = rank_within(children.select(key, *fields), [key], list(fields), position)
    return ranked.withColumn(position, (F.col(position) - 1).cast("bigint")).select(key, position, *fields)


def attach_many(
    parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], name: str
) -> DataFrame:
    """Has-many: a row for each parent and child with ``position`` and the child's fields as ``<name>_<field>``.

    Children are ordered by the fields as given, so the sort column comes first. A parent without
    children has one row with NULL there.
    """
    rows = numbered(children.withColumnRenamed(child_key, key), key, fields)
    return parents.join(rows.withColumnsRenamed({f: f"{name}_{f}" for f in fields}), key, "left")


def attach_linked(
    owners: DataFrame,
    links: DataFrame,
    targets: DataFrame,
    owner_key: str,
    target_key: str,
    fields: Sequence[str],
    name: str,
) -> DataFrame:
    """Many-to-many through a link table (owner_key, target_key); a repeated link counts once."""
    pairs = links.select(owner_key, target_key).distinct()
    return attach_many(owners, pairs.join(targets, target_key), owner_key, owner_key, fields, name)


def linked_to(df: DataFrame, links: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows that a link table refers to."""
    return df.join(keys_of(links, key), key, "left_semi")


def without(df: DataFrame, excluded: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose (compound) key is not in excluded."""
    return df.join(keys_of(excluded, key), key, "left_anti")


def offenders(requested: DataFrame, allowed: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Requested keys that are not allowed. The request is valid when the result is empty."""
    names = [key] if isinstance(key, str) else list(key)
    return keys_of(requested, names).join(keys_of(allowed, names), names, "left_anti")


def with_label(
    df: DataFrame, labels: DataFrame, code: str, label: str, default: Column | None = None
) -> DataFrame:
    """Label of a code through a two-column table (code, label); default or '' when unmapped."""
    fallback = F.lit("") if default is None else default
    return df.join(labels.select(code, label), code, "left").withColumn(label, F.coalesce(label, fallback))


def with_instance_name(df: DataFrame, names: DataFrame, code: str, label: str) -> DataFrame:
    """Instance name, or a fixed prefix and the id when the instance has none."""
    return with_label(df, names, code, label, F.concat(F.lit(UNNAMED), F.col(code).cast("string")))


def map_label(code: Column, labels: Mapping[str, str], default: Column) -> Column:
    """Label of a code through a small configured mapping."""
    if not labels:
        return default
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, code), default)


def with_labels(df: DataFrame, key: str, codes: str, labels: DataFrame, label: str, name: str) -> DataFrame:
    """Array of codes to the array of their labels in order; unmapped codes give NULL.

    ``labels`` is a table (code, label) of any size: the codes are unfolded,
    joined and folded again per row key.
    """
    code = [c for c in labels.columns if c != label][0]
    unfolded = df.select(key, F.posexplode(codes).alias("_pos", code))
    named = unfolded.join(labels, code, "left")
    folded = named.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", label))), lambda s: s[label]
        ).alias(name)
    )
    return df.join(folded, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
