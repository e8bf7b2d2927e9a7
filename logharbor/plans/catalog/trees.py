"""Hierarchies (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators import tree, treelabels
from logharbor.plans.catalog.base import CLOSURE_SQL, NODES_SQL, Tables, nodes, query


@query("h01_closure", f"WITH {CLOSURE_SQL} SELECT ancestor, descendant, depth FROM up")
def h01(t: Tables):
    return tree.closure(nodes(t), "id", "parent_id").select("ancestor", "descendant", "depth")


@query(
    "h01_descendants",
    f"WITH {CLOSURE_SQL} SELECT ancestor, descendant, depth FROM up WHERE ancestor IN (3, 107)"
    " UNION ALL SELECT 3, 3, 0",
)
def h01_of(t: Tables):
    return tree.descendants(nodes(t), "id", "parent_id", F.col("id").isin(3, 107)).select("ancestor", "descendant", "depth")


# Every tenth customer goes to the next nation, every seventh order is gone, nation 103 is gone too, and a nation without customers is new.
_CHANGED_SQL = f"""SELECT id, CASE WHEN id BETWEEN 1000 AND 999999999999 AND id % 10 = 0 THEN 100 + (parent_id - 99) % 25 ELSE parent_id END AS parent_id
    FROM ({NODES_SQL}) WHERE NOT (id >= 1000000000000 AND id % 7 = 0) AND id <> 103 UNION ALL SELECT 900, 1"""


@query(
    "h01_updated_closure",
    f"""WITH RECURSIVE nodes AS ({_CHANGED_SQL}), up AS (
      SELECT id AS descendant, parent_id AS ancestor, 1 AS depth FROM nodes WHERE parent_id <> 0
      UNION ALL SELECT up.descendant, n.parent_id, up.depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent_id <> 0)
    SELECT ancestor, descendant, depth FROM up""",
)
def h01_updated(t: Tables):
    n = nodes(t).select("id", "parent_id")
    moved = n.filter("id BETWEEN 1000 AND 999999999999 AND id % 10 = 0").selectExpr("id", "100 + (parent_id - 99) % 25 AS parent_id", "false AS deleted")
    gone = n.filter("(id >= 1000000000000 AND id % 7 = 0) OR id = 103").selectExpr("id", "parent_id", "true AS deleted")
    new = t.spark.range(1).selectExpr("900L AS id", "1L AS parent_id", "false AS deleted")
    pairs = tree.closure(n, "id", "parent_id")
    return tree.updated(pairs, *tree.closure_delta(pairs, n, moved.unionByName(gone).unionByName(new), "id", "parent_id"))


_STEP = "concat(sort, ':', id)"


def _spelled(path):
    return F.array_join(F.transform(path, lambda s: F.concat_ws(":", s["sort"], s["id"])), "/").alias("path")


def _walk(kept: str) -> str:
    return f"""RECURSIVE nodes AS ({kept}), walk AS (
      SELECT id, parent_id, 0 AS depth, {_STEP} AS path FROM nodes WHERE parent_id = 0
      UNION ALL SELECT n.id, n.parent_id, w.depth + 1, concat(w.path, '/', {_STEP.replace('sort', 'n.sort').replace(' id', ' n.id')})
      FROM walk w JOIN nodes n ON n.parent_id = w.id)"""


@query("h02_forest", f"WITH {_walk(NODES_SQL)} SELECT id, depth, path, true AS reached FROM walk")
def h02(t: Tables):
    return tree.forest(nodes(t), "id", "parent_id", "sort").select("id", "depth", _spelled("path"), "reached")


@query(
    "h03_linked_forest",
    f"""WITH {_walk(f"SELECT * FROM ({NODES_SQL}) WHERE name <> 'NATION_3' AND name <> 'ASIA' AND name NOT LIKE 'Customer%5'")}
    SELECT id, depth, path FROM walk""",
)
def h03(t: Tables):
    n = nodes(t)
    links = n.filter("name <> 'NATION_3' AND name <> 'ASIA' AND name NOT LIKE 'Customer%5'").select("id")
    return tree.linked_forest(n, links, "id", "parent_id", "sort").select("id", "depth", _spelled("path"))


@query(
    "h04_scope_check",
    f"""WITH {CLOSURE_SQL}, reach AS (SELECT ancestor, descendant FROM up UNION ALL SELECT id, id FROM nodes WHERE parent_id = 0),
    asked AS (SELECT DISTINCT 1 + n_regionkey AS caller, 1000 + o_custkey AS target FROM orders JOIN nation ON n_nationkey = length(o_orderpriority))
    SELECT caller, target FROM asked WHERE (caller, target) IN (SELECT (ancestor, descendant) FROM reach)""",
)
def h04(t: Tables):
    asked = (
        t.orders.join(t.nation, F.col("n_nationkey") == F.length("o_orderpriority"))
        .select((F.col("n_regionkey") + 1).cast("bigint").alias("caller"), (F.col("o_custkey") + 1000).alias("target"))
        .distinct()
    )
    return tree.in_scope(asked, nodes(t), "id", "parent_id")


@query(
    "h05_has_children",
    f"WITH nodes AS ({NODES_SQL}) SELECT id, id IN (SELECT parent_id FROM nodes) AS has_children FROM nodes",
)
def h05(t: Tables):
    return tree.with_child_flag(nodes(t), "id", "parent_id").select("id", "has_children")


@query(
    "h06_parent",
    f"WITH nodes AS ({NODES_SQL}) SELECT n.id, n.parent_id, p.name AS parent_name FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id",
)
def h06(t: Tables):
    return tree.with_parent(nodes(t), "id", "parent_id", "name").select("id", "parent_id", "parent_name")


def _below(ids: str) -> str:
    return f"SELECT descendant AS id FROM up WHERE ancestor IN ({ids})"


@query(
    "h07_visibility",
    f"""WITH {CLOSURE_SQL} SELECT 'strict root' AS mode, id FROM (SELECT 2 AS id UNION ALL {_below('2')})
    UNION ALL SELECT 'strict inner', id FROM ({_below('104')})
    UNION ALL SELECT 'loose', id FROM nodes""",
)
def h07(t: Tables):
    n = nodes(t)

    def seen(mode, caller, strict):
        return tree.visible(n, "id", "parent_id", caller, strict).select(F.lit(mode).alias("mode"), "id")

    return seen("strict root", 2, True).unionByName(seen("strict inner", 104, True)).unionByName(seen("loose", 104, False))


@query(
    "h08_landing",
    "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
    " THEN '1-URGENT' ELSE '404' END AS home FROM customer",
)
def h08(t: Tables):
    owners = t.customer.select("c_custkey", F.lit("1-URGENT").alias("home"))
    links = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return tree.landing(owners, "home", links, "c_custkey", "o_orderpriority")


# --- the same questions answered from interval labels ---------------------------------------

# Paths of zero-padded steps, so that text order is the order of siblings.
_PADDED = "printf('%012d:%020d', {0}sort, {0}id)"
LABELS_SQL = f"""RECURSIVE nodes AS ({NODES_SQL}), walk AS (
      SELECT id, 0 AS depth, {_PADDED.format('')} AS path FROM nodes WHERE parent_id = 0
      UNION ALL SELECT n.id, w.depth + 1, concat(w.path, '/', {_PADDED.format('n.')}) FROM walk w JOIN nodes n ON n.parent_id = w.id),
    up AS (SELECT id AS descendant, parent_id AS ancestor FROM nodes WHERE parent_id <> 0
      UNION ALL SELECT up.descendant, n.parent_id FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent_id <> 0),
    sizes AS (SELECT ancestor AS id, count(*) AS below FROM up GROUP BY ALL)"""


def _labels(t: Tables):
    return treelabels.labels(nodes(t), "id", "parent_id", "sort")


@query(
    "h01_tree_labels",
    f"""WITH {LABELS_SQL}, toured AS (SELECT id, depth, row_number() OVER (ORDER BY path) - 1 AS enter FROM walk)
    SELECT id, depth, enter, enter + coalesce(below, 0) AS leave FROM toured LEFT JOIN sizes USING (id)""",
)
def h01_labels(t: Tables):
    return _labels(t).select("id", "depth", "enter", "leave")


@query("h01_closure_from_labels", f"WITH {CLOSURE_SQL} SELECT ancestor, descendant, depth FROM up")
def h01_from_labels(t: Tables):
    return treelabels.closure_of(_labels(t))


@query(
    "h04_scope_from_labels",
    f"""WITH {CLOSURE_SQL}, reach AS (SELECT ancestor, descendant FROM up UNION ALL SELECT id, id FROM nodes WHERE parent_id = 0),
    asked AS (SELECT cast(1 + c_nationkey % 5 AS BIGINT) AS caller, cast(1000 + o_custkey AS BIGINT) AS target FROM orders JOIN customer ON c_custkey = o_custkey
      UNION ALL SELECT id, id FROM nodes)
    SELECT caller, target FROM asked WHERE (caller, target) IN (SELECT (ancestor, descendant) FROM reach)""",
)
def h04_from_labels(t: Tables):
    asked = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        (F.col("c_nationkey") % 5 + 1).cast("bigint").alias("caller"), (F.col("o_custkey") + 1000).alias("target")
    )
    own = nodes(t).select(F.col("id").alias("caller"), F.col("id").alias("target"))
    return treelabels.in_scope(asked.unionByName(own), _labels(t))


@query(
    "h07_views_from_labels",
    f"""WITH {CLOSURE_SQL} SELECT 'strict root' AS mode, id FROM (SELECT 2 AS id UNION ALL {_below('2')})
    UNION ALL SELECT 'strict inner', id FROM ({_below('104')})
    UNION ALL SELECT 'loose', id FROM nodes""",
)
def h07_from_labels(t: Tables):
    n, labelled = nodes(t), _labels(t)

    def seen(mode, caller, strict):
        return treelabels.visible(n, labelled, "id", caller, strict).select(F.lit(mode).alias("mode"), "id")

    return seen("strict root", 2, True).unionByName(seen("strict inner", 104, True)).unionByName(seen("loose", 104, False))
