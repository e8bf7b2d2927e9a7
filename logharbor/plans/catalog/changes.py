"""Sinks and table changes (K)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logharbor.operators import tables as k
from logharbor.operators.filters import Condition
from logharbor.plans.catalog.base import REPORT_DAY, THRESHOLDS, Tables, query, slow_docs
from logharbor.plans.catalog.rollups import REPORT_SQL
from logharbor.plans.export import Join, Template, export, titles
from logharbor.plans.inspection import inspection_report
from logharbor.sinks import daily, files, report, titled

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def orders(t: Tables):
    return t.orders.select(*ORDER)


@query(
    "k01_batch_upsert",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice + 2
      ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders
    WHERE o_orderstatus <> 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def k01(t: Tables):
    base = orders(t).filter("o_orderstatus <> 'P'")
    pulled = orders(t).filter("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    first = pulled.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(1)})
    second = pulled.withColumns({"o_totalprice": F.col("o_totalprice") + 2, "seq": F.lit(2)})
    return k.upsert(base, first.unionByName(second), ["o_orderkey"], order=["seq"])


@query(
    "k02_single_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 WHEN o_orderpriority = '3-MEDIUM' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def k02(t: Tables):
    base = orders(t).filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = orders(t).filter("o_orderstatus = 'P' OR o_orderpriority = '3-MEDIUM'").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit(None).cast("string").alias("o_orderstatus")
    )
    return k.upsert(base, changed, ["o_orderkey"], ["o_custkey"], merge="coalesce")


def dated_events(t: Tables):
    return daily.with_ingest_date(t.events.select("event_id", "value", "event_type", "ts"), F.col("ts")).drop("ts")


@query(
    "k03_append",
    "SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, event_id, value FROM events UNION ALL"
    " SELECT strftime(ts, '%Y-%m-%d'), event_id, value FROM events",
)
def k03(t: Tables):
    path = t.scratch("append")
    daily.append_daily(dated_events(t), path)
    daily.append_daily(dated_events(t), path)
    return t.spark.read.parquet(path).select(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "event_id", "value")


@query(
    "k04_daily_partitions",
    "SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value * 2 ELSE value END AS value FROM events",
)
def k04(t: Tables):
    path = t.scratch("daily")
    daily.overwrite_daily(dated_events(t), path)
    later = dated_events(t).filter("ingest_date >= '2024-01-15'").withColumn("value", F.col("value") * 2)
    daily.overwrite_daily(later, path)
    return t.spark.read.parquet(path).select(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "event_id", "value")


@query(
    "k04_daily_upsert",
    """SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, concat('e', event_id) AS doc_id,
      CASE WHEN event_type = 'error' THEN value + 1 ELSE value END AS value FROM events
    WHERE ts < TIMESTAMP '2024-01-29' OR event_type = 'error'""",
)
def k04_upsert(t: Tables):
    base_path, out = t.scratch("base"), t.scratch("upserted")
    docs = dated_events(t).withColumn("doc_id", F.concat(F.lit("e"), F.col("event_id")))
    columns = ["ingest_date", "doc_id", "value"]
    daily.overwrite_daily(docs.filter("ingest_date < '2024-01-29'").select(*columns), base_path)
    changes = docs.filter("event_type = 'error'").select("ingest_date", "doc_id", (F.col("value") + 1).alias("value"))
    # Each change comes twice, the first time with another value; days without changes are copied as they are.
    twice = changes.withColumns({"value": F.col("value") - 5, "seq": F.lit(1)}).unionByName(changes.withColumn("seq", F.lit(2)))
    days = daily.upsert_daily(t.spark, twice, base_path, out, ["seq"])
    base = t.spark.read.parquet(base_path).withColumn("ingest_date", F.col("ingest_date").cast("string"))
    daily.append_daily(base.filter(~F.col("ingest_date").isin(days)), out)
    return t.spark.read.parquet(out).select(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "doc_id", "value")


@query(
    "k04_files_upsert",
    """SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, concat('e', event_id) AS doc_id,
      CASE WHEN event_type = 'error' THEN value + 1 ELSE value END AS value FROM events
    WHERE ts < TIMESTAMP '2024-01-29' OR event_type = 'error'""",
)
def k04_files(t: Tables):
    path = t.scratch("file-table")
    docs = dated_events(t).withColumn("doc_id", F.concat(F.lit("e"), F.col("event_id"))).select("ingest_date", "doc_id", "value", "event_type")
    columns = ["ingest_date", "doc_id", "value"]
    files.create(docs.filter("ingest_date < '2024-01-29'").select(*columns), path, "doc_id", "ingest_date", 40)
    changes = docs.filter("event_type = 'error'").select("ingest_date", "doc_id", (F.col("value") + 1).alias("value"))
    # Each change comes twice, the first time with another value.
    twice = changes.withColumns({"value": F.col("value") - 5, "seq": F.lit(1)}).unionByName(changes.withColumn("seq", F.lit(2)))
    files.upsert(twice, path, "doc_id", "ingest_date", ["seq"])
    return files.read(t.spark, path)


@query(
    "k02_conflict_retry",
    "SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, concat('e', event_id) AS doc_id,"
    " CASE WHEN event_type = 'click' THEN value + 1 WHEN event_type = 'view' THEN value + 2 ELSE value END AS value FROM events",
)
def k02_conflict(t: Tables):
    path = t.scratch("two-writers")
    docs = dated_events(t).withColumn("doc_id", F.concat(F.lit("e"), F.col("event_id"))).select("ingest_date", "doc_id", "value", "event_type")
    files.create(docs.select("ingest_date", "doc_id", "value"), path, "doc_id", "ingest_date", 8)

    def changed(kind, more):
        return docs.filter(F.col("event_type") == kind).select("ingest_date", "doc_id", (F.col("value") + more).alias("value"), F.lit(1).alias("seq"))

    # Both writers start from version 0; the second one is told of the conflict and starts again from what the first made.
    files.upsert(changed("click", 1), path, "doc_id", "ingest_date", ["seq"], base=0)
    try:
        files.upsert(changed("view", 2), path, "doc_id", "ingest_date", ["seq"], base=0)
    except files.VersionConflict:
        files.upsert_retrying(changed("view", 2), path, "doc_id", "ingest_date", ["seq"])
    return files.read(t.spark, path)


@query(
    "k05_report_sink",
    f"""SELECT '2024-02-02 00:00:00' AS date, 'search' AS business, 'slow-log' AS kind, sqlhash, "MaxExecutionTime" AS max_time,
      "MySQLTotalExecutionCounts" AS executions, "SQLText" AS sql_text FROM ({REPORT_SQL})""",
)
def k05(t: Tables):
    path = t.scratch("report")
    rows = inspection_report(slow_docs(t), REPORT_DAY, THRESHOLDS, {"es-7": "orders search"}, F.lit("2024-02-02 00:00:00"))
    report.write_report(report.envelopes(rows, F.lit("2024-02-02 00:00:00"), "search", "slow-log", "daily"), path)
    schema = (
        "Date STRING, BusinessType STRING, InspectionType STRING,"
        " InspectionResult STRUCT<sqlhash STRING, MaxExecutionTime DOUBLE, MySQLTotalExecutionCounts BIGINT, SQLText STRING>"
    )
    return t.spark.read.schema(schema).json(path).select(
        F.col("Date").alias("date"), F.col("BusinessType").alias("business"), F.col("InspectionType").alias("kind"),
        "InspectionResult.sqlhash", F.col("InspectionResult.MaxExecutionTime").alias("max_time"),
        F.col("InspectionResult.MySQLTotalExecutionCounts").alias("executions"),
        F.col("InspectionResult.SQLText").alias("sql_text"),
    )


EXPORT = Template(
    "orders", "orders",
    '{"orders.o_orderkey": "Order", "customer.c_name as owner": "Customer", "nation.n_name": "Country",'
    ' "orders.o_orderdate": "Placed", "orders.o_totalprice": "Total"}',
    joins=(
        Join("LEFT JOIN", "customer", "customer.c_custkey = orders.o_custkey"),
        Join("LEFT JOIN", "nation", "nation.n_nationkey = customer.c_nationkey"),
    ),
    conditions=(
        Condition("status", "orders.o_orderstatus", "="),
        Condition("min_total", "orders.o_totalprice", ">="),
        Condition("name", "customer.c_name", "LIKE"),
        Condition("priority", "orders.o_orderpriority", "="),
    ),
    order="o_orderkey",
)


def export_tables(t: Tables):
    stamped = t.customer.withColumn("deleted_at", F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("2024-01-01").cast("timestamp")))
    live = t.orders.withColumn("deleted_at", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")))
    return {"orders": live, "customer": stamped, "nation": t.nation}


@query(
    "k06_template_export",
    """SELECT cast(o_orderkey AS VARCHAR) AS "Order", c_name AS "Customer", n_name AS "Country",
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "Placed", regexp_replace(cast(o_totalprice AS VARCHAR), '[.]0$', '') AS "Total"
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderpriority <> '5-LOW' AND coalesce(c_mktsegment, '') <> 'MACHINERY' AND o_orderstatus = 'O'
      AND o_totalprice >= 1200.5 AND c_name LIKE '%0_%'""",
)
def k06(t: Tables):
    path = t.scratch("export")
    params = {"filterDeleted": "true", "status": "O", "min_total": 1200.5, "name": "0_", "priority": ""}
    titled.write_titled(export(EXPORT, export_tables(t), params), path)
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query("k07_header_export", "SELECT 'Order,Customer,Country,Placed,Total' AS titles")
def k07(t: Tables):
    path = t.scratch("header")
    titled.write_header(titles(EXPORT, export_tables(t)), path)
    return t.spark.read.text(path).withColumnRenamed("value", "titles")


@query(
    "k08_guarded_insert",
    """WITH b AS (SELECT c_custkey AS seq, c_name AS name FROM customer UNION ALL
      SELECT c_custkey + 10000000, c_name FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT seq, name, CASE WHEN name IN (SELECT c_name FROM customer WHERE c_acctbal < 500) THEN 'exists'
      WHEN row_number() OVER (PARTITION BY name ORDER BY seq) > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM b""",
)
def k08(t: Tables):
    base = t.customer.filter("c_acctbal < 500").select(F.col("c_name").alias("name"))
    batch = t.customer.select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    again = t.customer.filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 10000000).alias("seq"), F.col("c_name").alias("name"))
    return k.guard_insert(base, batch.unionByName(again), ["name"], "seq")


@query(
    "k09_guarded_update",
    """WITH ch AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN concat('Customer#', lpad(cast(c_custkey + 1 AS VARCHAR), 9, '0'))
        WHEN 'MACHINERY' THEN concat('Shared#', c_nationkey) ELSE c_name END AS name FROM customer)
    SELECT id, name, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_name = name AND c_custkey <> id) THEN 'exists'
      WHEN id > min(id) OVER (PARTITION BY name) THEN 'duplicate' ELSE 'accepted' END AS status FROM ch""",
)
def k09(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Shared#"), F.col("c_nationkey")))
        .otherwise(F.col("c_name"))
    )
    return k.guard_update(base, t.customer.select(F.col("c_custkey").alias("id"), new.alias("name")), "id", ["name"])


def patches(t: Tables):
    """Changes for part of the customers, some of their fields zero."""
    return t.customer.filter("c_mktsegment IN ('BUILDING', 'FURNITURE')").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.lit("renamed")).alias("c_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.0)).otherwise(F.lit(7.5)).alias("c_acctbal"),
    )


@query(
    "k10_patch_nonzero",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'renamed' ELSE c_name END AS c_name, c_nationkey,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 7.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""",
)
def k10(t: Tables):
    return k.patch_nonzero(t.customer, patches(t), "c_custkey", ["c_name"])


@query(
    "k11_patch_columns",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'renamed' WHEN 'BUILDING' THEN '' ELSE c_name END AS c_name,
      CASE c_mktsegment WHEN 'FURNITURE' THEN 7.5 WHEN 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal,
      CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN '2024-05-06' ELSE '2020-01-01' END AS updated_at FROM customer""",
)
def k11(t: Tables):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit("2020-01-01").alias("updated_at"))
    return k.patch_columns(base, patches(t), "c_custkey", ["c_name"], {"updated_at": F.lit("2024-05-06")})


@query(
    "k12_save_rows",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'saved' ELSE c_name END AS c_name,
      CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""",
)
def k12(t: Tables):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    rows = t.customer.filter("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit("saved").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal")
    )
    return k.save_rows(base, rows, "c_custkey", ["c_name"])


@query(
    "k13_soft_delete",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '1999-01-01' WHEN o_orderstatus = 'P' THEN '2024-05-06' END AS deleted_at,
      CASE WHEN o_orderpriority <> '5-LOW' AND o_orderstatus = 'P' THEN 'admin' END AS deleted_by FROM orders""",
)
def k13(t: Tables):
    base = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("1999-01-01")).alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_by"),
    )
    ids = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    return k.soft_delete(base, ids, "o_orderkey", F.lit("2024-05-06"), {"deleted_by": F.lit("admin")})


@query("k14_hard_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)")
def k14(t: Tables):
    ids = t.customer.filter("c_acctbal < 1000").select(F.col("c_custkey").alias("o_custkey"))
    return k.hard_delete(t.orders.select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query(
    "k15_cascade_delete",
    """WITH ids AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P')
    SELECT 'orders' AS tab, o_orderkey AS id, cast(o_custkey AS BIGINT) AS other FROM orders WHERE o_orderkey NOT IN (SELECT id FROM ids)
    UNION ALL SELECT 'lineitem', l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM ids)""",
)
def k15(t: Tables):
    ids = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    out = k.cascade_delete(
        {"orders": t.orders.select("o_orderkey", "o_custkey"), "lineitem": t.lineitem.select("l_orderkey", "l_partkey")},
        {"orders": "o_orderkey", "lineitem": "l_orderkey"}, ids, "id",
    )
    return out["orders"].toDF("id", "other").withColumn("tab", F.lit("orders")).unionByName(
        out["lineitem"].toDF("id", "other").withColumn("tab", F.lit("lineitem"))
    )


@query(
    "k16_delete_guard",
    """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR
      c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'blocked' ELSE 'deletable' END AS status FROM customer""",
)
def k16(t: Tables):
    return k.guard_delete(
        t.customer.select("c_custkey"), "c_custkey",
        [(t.orders.filter("o_orderstatus = 'P'"), "o_custkey"), (t.events.filter("event_type = 'error'"), "user_id")],
    )


@query(
    "k17_replace_links",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""",
)
def k17(t: Tables):
    building = t.customer.filter("c_mktsegment = 'BUILDING'")
    new = building.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("bigint").alias("o_orderkey"))
    owners = building.select(F.col("c_custkey").alias("o_custkey"))
    return k.replace_links(t.orders.select("o_custkey", "o_orderkey"), owners, new, "o_custkey")


@query(
    "k18_copy_entity",
    "SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT c_custkey, 99 FROM customer WHERE c_nationkey = 7",
)
def k18(t: Tables):
    return k.copy_entity(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", 7, 99)


@query(
    "k19_rename_cascade",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN l_partkey ELSE l_partkey + 1000000 END AS l_partkey,
      CASE WHEN p_partkey IS NULL THEN l_returnflag ELSE lower(l_returnflag) END AS l_returnflag
    FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') ON p_partkey = l_partkey AND l_returnflag = 'R'""",
)
def k19(t: Tables):
    renames = t.part.filter("p_type = 'PROMO'").select(
        F.col("p_partkey").alias("l_partkey"), F.lit("R").alias("l_returnflag"),
        (F.col("p_partkey") + 1000000).alias("new_l_partkey"), F.lit("r").alias("new_l_returnflag"),
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return k.rename_cascade(rows, renames, ["l_partkey", "l_returnflag"], ["new_l_partkey"])


_POLICY = "SELECT l_returnflag AS role, concat('/part/', l_partkey) AS path, l_linestatus AS method FROM lineitem"


@query(
    "k20_replace_policies",
    f"SELECT * FROM (SELECT DISTINCT * FROM ({_POLICY})) WHERE role <> 'R' UNION ALL"
    " SELECT DISTINCT 'R', concat('/supp/', l_suppkey), l_linestatus FROM lineitem WHERE l_returnflag = 'A'",
)
def k20(t: Tables):
    flags = t.lineitem.select(
        F.col("l_returnflag").alias("role"), F.concat(F.lit("/part/"), F.col("l_partkey")).alias("path"), F.col("l_linestatus").alias("method")
    )
    new = t.lineitem.filter("l_returnflag = 'A'").select(
        F.lit("R").alias("role"), F.concat(F.lit("/supp/"), F.col("l_suppkey")).alias("path"), F.col("l_linestatus").alias("method")
    )
    owners = flags.filter("role = 'R'").select("role").distinct()
    return k.replace_policies(flags.distinct(), owners, new)


@query("k21_retention_by_age", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-10-03 00:00:00'")
def k21(t: Tables):
    return k.retain_since(t.orders, "o_orderdate", datetime(1999, 1, 1), timedelta(hours=2160)).select("o_orderkey")


@query(
    "k22_retention_by_day",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ingest_date FROM events WHERE ts >= TIMESTAMP '2024-01-21'",
)
def k22(t: Tables):
    path = t.scratch("retention")
    daily.overwrite_daily(dated_events(t), path)
    kept = k.retain_days(t.spark.read.parquet(path), "ingest_date", "2024-01-31", 10)
    return kept.select("event_id", F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"))


@query(
    "k23_find_or_create",
    """WITH files AS (SELECT doc_id AS id, md5(text) AS file_md5, source AS file_name, lang = 'en' AS is_finish, concat('/store/', doc_id) AS file_path,
        n_chars AS chunk_total FROM documents WHERE lang <> 'es'),
      want AS (SELECT md5(text) AS file_md5, source AS file_name, max(n_chars + 1) AS chunk_total FROM documents GROUP BY ALL),
      done AS (SELECT file_md5, arg_min(file_path, id) AS file_path FROM files WHERE is_finish GROUP BY file_md5),
      live AS (SELECT file_md5, file_name, arg_min(file_path, id) AS file_path, arg_min(chunk_total, id) AS chunk_total FROM files WHERE NOT is_finish GROUP BY ALL)
    SELECT w.file_md5, w.file_name, CASE WHEN d.file_md5 IS NOT NULL THEN w.chunk_total ELSE coalesce(l.chunk_total, w.chunk_total) END AS chunk_total,
      CASE WHEN d.file_md5 IS NOT NULL THEN d.file_path ELSE l.file_path END AS file_path, d.file_md5 IS NOT NULL AS is_finish,
      CASE WHEN d.file_md5 IS NOT NULL THEN 'reused' WHEN l.file_md5 IS NOT NULL THEN 'found' ELSE 'created' END AS outcome
    FROM want w LEFT JOIN done d ON d.file_md5 = w.file_md5 LEFT JOIN live l ON l.file_md5 = w.file_md5 AND l.file_name = w.file_name""",
)
def k23(t: Tables):
    docs = t.documents.withColumns({"file_md5": F.md5("text"), "file_name": F.col("source")})
    files = docs.filter("lang <> 'es'").select(
        F.col("doc_id").alias("id"), "file_md5", "file_name", (F.col("lang") == "en").alias("is_finish"),
        F.concat(F.lit("/store/"), F.col("doc_id")).alias("file_path"), F.col("n_chars").alias("chunk_total"),
    )
    wanted = docs.select("file_md5", "file_name", (F.col("n_chars") + 1).alias("chunk_total"))
    return k.find_or_create(files, wanted)


@query(
    "k24_reassembled_chunks",
    """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE NOT (role = 'system'))
    SELECT conv_id, turn AS chunk_number, text AS content,
      count(*) OVER (PARTITION BY conv_id) = (SELECT count(*) FROM conversations a WHERE a.conv_id = c.conv_id)
        AND min(turn) OVER (PARTITION BY conv_id) = 0 AS complete
    FROM c""",
)
def k24(t: Tables):
    chunks = t.conversations.select(
        "conv_id", F.col("turn").alias("chunk_number"), F.col("text").alias("content"),
        F.when(F.col("role") == "system", F.lit("broken")).otherwise(F.md5("text")).alias("chunk_md5"),
    )
    totals = t.conversations.groupBy("conv_id").agg(F.count("*").alias("chunk_total"))
    # A repeated chunk, as a retried upload sends it, counts once.
    repeated = chunks.unionByName(chunks.filter("chunk_number = 1"))
    return k.reassemble(repeated, totals, "conv_id")


@query(
    "k24_whole_files",
    """WITH whole AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0)
    SELECT conv_id, octet_length(encode(body)) AS n_bytes, md5(body) AS file_md5, cast(greatest(ceil(octet_length(encode(body)) / 1000.0), 1) AS BIGINT) AS segments
    FROM whole""",
)
def k24_whole(t: Tables):
    chunks = t.conversations.select(
        "conv_id", F.col("turn").alias("chunk_number"), F.col("text").alias("content"),
        F.when(F.col("role") == "system", F.lit("broken")).otherwise(F.md5("text")).alias("chunk_md5"),
    )
    totals = t.conversations.groupBy("conv_id").agg(F.count("*").alias("chunk_total"))
    parts = k.assemble(chunks.unionByName(chunks.filter("chunk_number = 1")), totals, "conv_id", 1000)
    return parts.groupBy("conv_id").agg(F.max("n_bytes").alias("n_bytes"), F.max("file_md5").alias("file_md5"), F.count("*").alias("segments"))


@query(
    "k24_leftover_chunks",
    """SELECT conv_id, turn AS chunk_number FROM conversations a WHERE EXISTS
      (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'system')""",
)
def k24_leftover(t: Tables):
    chunks = t.conversations.select(
        "conv_id", F.col("turn").alias("chunk_number"), F.col("text").alias("content"),
        F.when(F.col("role") == "system", F.lit("broken")).otherwise(F.md5("text")).alias("chunk_md5"),
    )
    totals = t.conversations.groupBy("conv_id").agg(F.count("*").alias("chunk_total"))
    done = k.reassemble(chunks, totals, "conv_id")
    return k.leftover_chunks(chunks, done, "conv_id").select("conv_id", "chunk_number")
