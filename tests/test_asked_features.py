"""Queries make the features that they show, and evidence those that it reads."""

import pytest

from ringweave.operators import features
from ringweave.plans import queries_directory, queries_graph, queries_marts
from ringweave.plans.network import Network

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def net(spark):
    return Network(spark, SF)


@pytest.fixture
def structure_only(monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("not asked for")

    for name in ("stats_of", "entropy", "shared_counts"):
        monkeypatch.setattr(features, name, refuse)


def test_evidence_needs_no_activity(spark, structure_only):
    assert queries_graph.evidence_of(Network(spark, SF)).count() == 295


@pytest.mark.parametrize("name", ["directory_sorted"])
def test_a_directory_by_density_needs_no_activity(spark, structure_only, name):
    assert queries_directory.QUERIES[name](spark, SF).count() == 5


def test_asked_features_equal_those_of_the_matrix(net):
    parts = (net.membership, queries_graph.inside_of(net), queries_graph.ledger_of(net), net.merchants)
    whole = {r.community_id: r for r in features.community_features(*parts).collect()}
    for only in (["density"], ["total_transaction_amount", "unique_shared_devices"], ["merchant_category_entropy", "unique_active_hours"], ["temporal_overlap_mean"]):
        found = features.community_features(*parts, only=only)
        assert set(found.columns) == {"community_id", *only}
        rows = found.collect()
        assert len(rows) == len(whole)
        assert all(r[c] == pytest.approx(whole[r.community_id][c], nan_ok=True) for r in rows for c in only)


def test_a_community_hub_and_its_sums(spark, monkeypatch):
    monkeypatch.delattr(features, "entropy")
    assert queries_marts.QUERIES["community_actions"](spark, SF).count() == 5
