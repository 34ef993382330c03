"""Tables that cut lineage."""

import os

from cadence.operators import coordination as co
from cadence.plans.lineage import cut, scratch
from tests.test_meeting import CONFIG, SCHEMA, planted


def test_a_cut_table_is_not_broadcast(spark):
    """By the size of its compressed file it would be, and its rows would fill the driver."""
    rows = cut(spark.range(1000).selectExpr("id AS k"))
    joined = spark.range(1000, numPartitions=2).selectExpr("id AS k", "id AS v").join(rows.select("k"), "k")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_the_null_model_leave_no_table_and_change_nothing(spark, monkeypatch):
    records = cut(spark.createDataFrame(planted(300, 40), SCHEMA).filter("account_id is not null and fingerprint is not null"))
    for strategy in ("shift", "shuffle"):
        want = co.null_model(records, CONFIG, 3, strategy).orderBy("perm").collect()
        monkeypatch.setattr(co, "ROUND", 1)
        assert co.null_model(records, CONFIG, 3, strategy).orderBy("perm").collect() == want and sum(r["edges"] for r in want)
        monkeypatch.undo()
    with scratch(spark):
        (path,) = {os.path.dirname(f) for f in cut(spark.range(3)).inputFiles()}
    assert not os.path.exists(path.removeprefix("file://"))


def test_clusters_and_their_members_are_not_broadcast(spark):
    """Lists of all members of all communities went through the driver where they were small enough compressed."""
    names = [f"a{k:02d}" for k in range(12)]
    ends = [(a, b) for k in range(0, 12, 4) for i, a in enumerate(names[k : k + 4]) for b in names[k + i + 1 : k + 4]]
    graph = cut(spark.createDataFrame([(a, b, 2, 1.0, 3.0, [(5, b, a)]) for a, b in ends], "src string, dst string, weight long, mean_similarity double, median_lag_seconds double, examples array<struct<at long, later string, earlier string>>"))
    members = cut(spark.createDataFrame([(n, names[k // 4 * 4]) for k, n in enumerate(names)], "account_id string, community string"))
    found = co.numbered_clusters(graph, members, CONFIG)
    assert [(r["cluster_id"], r["size"], r["n_edges"]) for r in found.sort("cluster_id").collect()] == [(f"c00{k}", 4, 6) for k in range(3)]
    (rows := found.select("cluster_id")).collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join [community" in plan and "BroadcastHashJoin [community" not in plan
