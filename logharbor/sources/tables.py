"""Named external databases, option lists and the catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.filters import not_deleted

# JDBC driver classes of the supported databases.
DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "pgsql": "org.postgresql.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlite": "org.sqlite.JDBC",
}

_IS_KEY = (
    "CASE WHEN EXISTS (SELECT 1 FROM information_schema.table_constraints t"
    " JOIN information_schema.key_column_usage k ON k.constraint_name = t.constraint_name"
    " AND k.table_schema = t.table_schema AND k.table_name = t.table_name"
    " WHERE t.constraint_type = 'PRIMARY KEY' AND t.table_schema = c.table_schema"
    " AND t.table_name = c.table_name AND k.column_name = c.column_name) THEN 1 ELSE 0 END"
)


def _standard(database: str, text: str, comment: str) -> str:
    """Column catalog of a database with an information schema."""
    length = (
        f"COALESCE(CAST(c.character_maximum_length AS {text}),"
        f" CONCAT(CAST(c.numeric_precision AS {text}), ',', CAST(c.numeric_scale AS {text})))"
    )
    return (
        f"SELECT {database} AS db, c.table_name AS tbl, c.column_name AS col, c.data_type AS type, {length} AS length,"
        f" {comment} AS comment, {_IS_KEY} AS is_key, c.ordinal_position AS ordinal FROM information_schema.columns c"
    )


# Catalog queries: databases, tables and columns of each kind of database.
DATABASE_QUERIES = {
    "mysql": "SELECT schema_name AS db FROM information_schema.schemata",
    "mssql": "SELECT name AS db FROM sys.databases",
    "pgsql": "SELECT datname AS db FROM pg_database WHERE datistemplate = false",
    "oracle": "SELECT username AS db FROM all_users",
    "sqlite": "SELECT name AS db FROM pragma_database_list",
}
TABLE_QUERIES = {
    "mysql": "SELECT table_schema AS db, table_name AS tbl FROM information_schema.tables",
    "mssql": "SELECT table_catalog AS db, table_name AS tbl FROM information_schema.tables",
    "pgsql": "SELECT table_schema AS db, table_name AS tbl FROM information_schema.tables",
    "oracle": "SELECT owner AS db, table_name AS tbl FROM all_tables",
    "sqlite": "SELECT 'main' AS db, name AS tbl FROM sqlite_master WHERE type = 'table'",
}
COLUMN_QUERIES = {
    "mysql": _standard("c.table_schema", "CHAR", "c.column_comment"),
    "mssql": _standard("c.table_catalog", "VARCHAR(40)", "''"),
    "pgsql": _standard(
        "c.table_schema", "VARCHAR",
        "COALESCE(col_description((quote_ident(c.table_schema) || '.' || quote_ident(c.table_name))::regclass, c.ordinal_position), '')",
    ),
    "oracle": (
        "SELECT c.owner AS db, c.table_name AS tbl, c.column_name AS col, c.data_type AS type,"
        " CASE WHEN c.data_precision IS NULL THEN TO_CHAR(c.data_length)"
        " ELSE c.data_precision || ',' || c.data_scale END AS length, m.comments AS comment,"
        " CASE WHEN EXISTS (SELECT 1 FROM all_constraints t JOIN all_cons_columns k"
        " ON k.owner = t.owner AND k.constraint_name = t.constraint_name WHERE t.constraint_type = 'P'"
        " AND t.owner = c.owner AND t.table_name = c.table_name AND k.column_name = c.column_name) THEN 1 ELSE 0 END AS is_key,"
        " c.column_id AS ordinal FROM all_tab_columns c LEFT JOIN all_col_comments m"
        " ON m.owner = c.owner AND m.table_name = c.table_name AND m.column_name = c.column_name"
    ),
    "sqlite": (
        "SELECT 'main' AS db, m.name AS tbl, p.name AS col, p.type AS type, '' AS length, '' AS comment,"
        " p.pk > 0 AS is_key, p.cid + 1 AS ordinal FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table'"
    ),
}


class Databases:
    """Aliases of external databases; an alias that is not registered is an error.

    A source is ``{"format": "parquet", "path": folder}`` for folders of files or
    ``{"kind": "mysql", "url": ..., ...}`` for JDBC. JDBC reads split on
    ``partitionColumn`` when the bounds and numPartitions are among the options.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, Mapping[str, str]]):
        self.spark = spark
        self.sources = dict(sources)

    def options(self, alias: str) -> Mapping[str, str]:
        if alias not in self.sources:
            raise KeyError(f"no database is registered as {alias!r}")
        return self.sources[alias]

    def table(self, alias: str, name: str) -> DataFrame:
        source = self.options(alias)
        if "path" in source:
            kind = source["format"]
            return self.spark.read.format(kind).load(f"{source['path']}/{name}.{kind}")
        return self._jdbc(source).option("dbtable", name).load()

    def databases(self, alias: str) -> DataFrame:
        """The databases a JDBC source can see."""
        return self._catalog(alias, DATABASE_QUERIES)

    def tables(self, alias: str) -> DataFrame:
        """The tables of a JDBC source."""
        return self._catalog(alias, TABLE_QUERIES)

    def columns(self, alias: str) -> DataFrame:
        """The columns of a JDBC source: type, length or precision, comment, key flag, ordinal."""
        return self._catalog(alias, COLUMN_QUERIES)

    def _catalog(self, alias: str, texts: Mapping[str, str]) -> DataFrame:
        source = self.options(alias)
        return self._jdbc(source).option("query", texts[source["kind"]]).load()

    def _jdbc(self, source: Mapping[str, str]):
        options = {k: v for k, v in source.items() if k != "kind"}
        return self.spark.read.format("jdbc").option("driver", DRIVERS[source["kind"]]).options(**options)


def option_list(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, value) pairs of a table, soft-deleted rows left out."""
    return not_deleted(df).select(F.col(label).alias("label"), F.col(value).alias("value"))


_LENGTHS = r"\(([0-9, ]+)\)"


def describe(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per column of the given tables: type, length text, comment, key flag, ordinal, rows.

    Schemas are metadata the driver already holds; the row counts come from the tables.
    """
    keys = keys or {}
    parts = []
    for name, df in tables.items():
        fields = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.regexp_extract(F.lit(f.dataType.simpleString()), _LENGTHS, 1).alias("length"),
                F.lit((f.metadata or {}).get("comment", "")).alias("comment"),
                F.lit(f.name in keys.get(name, ())).alias("is_key"),
                F.lit(i + 1).alias("ordinal"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        counted = df.agg(F.count("*").alias("table_rows"))
        parts.append(counted.select(F.lit(name).alias("table"), F.inline(F.array(*fields)), "table_rows"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
