"""Sort, limit and paging (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators import paging as o
from logharbor.operators.aggregates import fingerprint_buckets, top_buckets
from logharbor.operators.ranking import rank_within
from logharbor.plans.catalog.base import DOCS_SQL, Tables, query, slow_docs

COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
LIST = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def orders(t: Tables):
    return t.orders.select(*COLUMNS)


@query(
    "o01_checked_order",
    f"SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM ({LIST})",
)
def o01(t: Tables):
    df = orders(t)
    return rank_within(df, [], o.checked_order(df, "o_totalprice desc", "o_custkey", tie=["o_orderkey"]))


@query(
    "o02_lenient_order",
    f"SELECT 'known' AS how, *, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS rank FROM ({LIST})"
    f" UNION ALL SELECT 'unknown', *, row_number() OVER (ORDER BY o_orderkey) FROM ({LIST})",
)
def o02(t: Tables):
    df = orders(t)
    known = rank_within(df, [], o.lenient_order(df, "o_custkey", True, "o_orderkey"))
    unknown = rank_within(df, [], o.lenient_order(df, "no_such", True, "o_orderkey"))
    return known.withColumn("how", F.lit("known")).unionByName(unknown.withColumn("how", F.lit("unknown")))


@query("o03_default_orders", f"{LIST} ORDER BY o_orderkey DESC")
def o03(t: Tables):
    return o.page_of(orders(t), 1, 0, [F.desc("o_orderkey")])


@query("o04_page", f"{LIST} ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 75")
def o04(t: Tables):
    return o.page_of(orders(t), 4, 25, ["o_totalprice", "o_orderkey"])


@query("o05_clamped_page", f"{LIST} ORDER BY o_orderkey LIMIT 100")
def o05(t: Tables):
    return o.page_of(orders(t), *o.clamp_page(0, 500), ["o_orderkey"])


@query("o06_request_window", f"{LIST} ORDER BY o_orderkey LIMIT 40 OFFSET 15")
def o06(t: Tables):
    return o.window_of(orders(t), ["o_orderkey"], None, 15, default_limit=40)


@query(
    "o07_top_buckets",
    f"""WITH {DOCS_SQL} SELECT "checkSum" AS check_sum, count(*) AS doc_count FROM docs GROUP BY 1
    ORDER BY doc_count DESC, check_sum LIMIT 25""",
)
def o07(t: Tables):
    return top_buckets(fingerprint_buckets(slow_docs(t)), 25).select(F.col("checkSum").alias("check_sum"), "doc_count")
