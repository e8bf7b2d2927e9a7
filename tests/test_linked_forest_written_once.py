"""How often linked_forest makes its nodes."""

from pyspark.sql import functions as F

from logharbor.operators import tree


def test_the_semi_join_with_the_links_is_in_no_later_plan(spark):
    nodes = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 9, 1)], "id long, parent long, sort int")
    links = nodes.filter("id <> 3").select("id")
    out = tree.linked_forest(nodes, links, "id", "parent", "sort")
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.depth) for r in out.select("id", F.col("depth")).collect()) == [(1, 0), (2, 1)]
