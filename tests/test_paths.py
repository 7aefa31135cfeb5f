import pytest

from factgraph.operators import paths
from factgraph.plans.materialize import bucketed


def test_chain_of_over_100_steps(spark):
    n = 102
    assets = spark.createDataFrame([(i, "table", f"t{i}") for i in range(n + 1)], "id long, kind string, name string")
    edges = spark.createDataFrame([(1000 + i, i, i + 1, "feeds", "declared") for i in range(n)], "id long, from_id long, to_id long, type string, origin string")
    found = paths.shortest_path(edges, assets, 0, n).orderBy("step").collect()
    assert [(r.step, r.from_id, r.to_id) for r in found] == [(i + 1, i, i + 1) for i in range(n)]


def test_levels_do_not_move_the_edges(spark):
    """With joins that cannot broadcast, one exchange a side that is reached or visited, and none of the edges that are scanned."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = bucketed(spark.range(2000).selectExpr("id", "id % 50 AS from_id", "id % 71 AS to_id", "'t' AS type", "'o' AS origin"), "path-edges", "from_id")
        reached = spark.range(20).selectExpr("id", "id AS rank")
        joined = edges.join(reached.selectExpr("id AS from_id", "rank"), "from_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert paths.ahead_of(edges, reached, reached.selectExpr("id")).count() == joined.filter("to_id >= 20").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_path(spark):
    assets = spark.createDataFrame([(i, "table", f"t{i}") for i in range(3)], "id long, kind string, name string")
    edges = spark.createDataFrame([(7, 1, 0, "feeds", "declared"), (8, 1, 2, "feeds", "declared")], "id long, from_id long, to_id long, type string, origin string")
    with pytest.raises(LookupError):
        paths.shortest_path(edges, assets, 0, 2)
    assert paths.shortest_path(edges, assets, 0, 0).count() == 0
