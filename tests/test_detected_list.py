"""From detection to evidence: the list is in the order of risk and tells each community's share of modularity."""

import pytest

from ringweave.operators import communities
from ringweave.plans import queries_directory
from ringweave.plans.network import Network

SF = "/root/testdata/sf0.001"


def test_the_list_is_in_order_and_tells_shares_of_modularity(spark, monkeypatch):
    net = Network(spark, SF)
    monkeypatch.setattr(communities, "detect", lambda *_, **__: net.membership)
    listed = queries_directory.QUERIES["detected_evidence"](spark, SF)
    assert listed._jdf.queryExecution().optimizedPlan().toString().startswith("Sort [risk_rank")
    rows = listed.collect()
    assert [r.risk_rank for r in rows] == list(range(1, len(rows) + 1))
    whole = communities.modularity(net.membership, queries_directory.edges_of(net)).first()[0]
    assert sum(r.modularity_share for r in rows) == pytest.approx(whole, abs=1e-9)
    assert all(r.mean_edge_weight is None or r.mean_edge_weight > 0 for r in rows) and all(r.total_transaction_amount > 0 and r.tx_per_member > 0 for r in rows)


def test_shares_of_a_small_partition(spark):
    own = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)], "account_id string, community_id long")
    edges = spark.createDataFrame([("a", "b", 2.0, 0), ("c", "d", 1.0, 1), ("b", "c", 1.0, None)], "src string, dst string, weight double, community_id long")
    found = {r.community_id: r.modularity_share for r in communities.shares(own, edges, edges.filter("community_id IS NOT NULL")).collect()}
    assert found == pytest.approx({0: 4 / 8 - (5 / 8) ** 2, 1: 2 / 8 - (3 / 8) ** 2, 2: 0.0})
    assert {r.modularity_share for r in communities.shares(own, edges.limit(0), edges.limit(0)).collect()} == {0.0}
