"""Set operations (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators import setops as s
from logharbor.operators.tree import managed_by
from logharbor.plans.catalog.base import CLOSURE_SQL, Tables, nodes, query

NUMBERED = "SELECT l_partkey AS path, l_suppkey AS method, l_returnflag AS flag, l_linestatus AS state FROM lineitem"


def keyed(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("method"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
    )


@query(
    "x01_aligned_union",
    "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, cast(NULL AS BIGINT) AS supplier FROM customer"
    " UNION ALL SELECT s_name, s_nationkey, NULL, s_suppkey FROM supplier",
)
def x01(t: Tables):
    one = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    two = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier"))
    return s.aligned_union(one, two)


@query(
    "x02_concatenated_pages",
    "SELECT event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id FROM events WHERE value > 10",
)
def x02(t: Tables):
    e = t.events
    return s.aligned_union(
        e.filter("event_type = 'click'").select("event_id", "user_id"), e.filter("value > 10").select("event_id", "user_id")
    )


_DIFF = f"""src AS (SELECT DISTINCT path, method FROM ({NUMBERED}) WHERE flag <> 'A'),
  tab AS (SELECT DISTINCT path, method FROM ({NUMBERED}) WHERE flag <> 'N'),
  ign AS (SELECT DISTINCT path, method FROM ({NUMBERED}) WHERE flag = 'R' AND state = 'F'),
  live AS (SELECT * FROM src EXCEPT SELECT * FROM ign),
  diff AS (SELECT *, 'new' AS state FROM (SELECT * FROM live EXCEPT SELECT * FROM tab)
    UNION ALL SELECT *, 'stale' FROM (SELECT * FROM tab EXCEPT SELECT * FROM live)
    UNION ALL SELECT *, 'ignored' FROM ign)"""


def diff_sides(t: Tables):
    k = keyed(t)
    return k.filter("flag <> 'A'"), k.filter("flag <> 'N'"), k.filter("flag = 'R' AND state = 'F'")


@query("x03_three_way_diff", f"WITH {_DIFF} SELECT path, method, state FROM diff")
def x03(t: Tables):
    return s.table_diff(*diff_sides(t), ["path", "method"])


@query(
    "k25_apply_diff",
    f"""WITH {_DIFF} SELECT path, method FROM (SELECT * FROM tab WHERE (path, method) NOT IN
      (SELECT (path, method) FROM diff WHERE state = 'stale') UNION ALL SELECT path, method FROM diff WHERE state = 'new')""",
)
def k25(t: Tables):
    source, table, ignored = diff_sides(t)
    keys = ["path", "method"]
    return s.apply_diff(table.select(*keys).distinct(), s.table_diff(source, table, ignored, keys), keys)


@query(
    "x04_intersection",
    f"SELECT path, method FROM ({NUMBERED}) WHERE flag = 'R' AND (path, method) IN (SELECT (path, method) FROM ({NUMBERED}) WHERE flag = 'N')",
)
def x04(t: Tables):
    k = keyed(t)
    return s.intersection(k.filter("flag = 'R'"), k.filter("flag = 'N'"), ["path", "method"]).select("path", "method")


@query(
    "x05_merged_id_lists",
    f"WITH {CLOSURE_SQL} SELECT ancestor, descendant FROM up UNION ALL SELECT id, id FROM nodes WHERE parent_id = 0",
)
def x05(t: Tables):
    return managed_by(nodes(t), "id", "parent_id").select("ancestor", "descendant")
