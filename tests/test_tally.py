"""Searches read a row for each type of a community's evidence; what several steps read is made once."""

import pytest
from pyspark.sql import functions as F

from ringweave.operators import directory, evidence, graph
from ringweave.plans import queries_directory, queries_graph
from ringweave.plans.network import Network

SF = "/root/testdata/sf0.001"
ITEM = "evidence_id string, entity_type string, entity_id string, type string, severity string, points int, title string, supporting_entities array<string>"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("e1", "COMMUNITY", "1", "TEMPORAL_BURST", "HIGH", 25, "9 transactions", ["tx_1"]),
        ("e1", "COMMUNITY", "1", "TEMPORAL_BURST", "HIGH", 25, "9 transactions", ["tx_1"]),
        ("e2", "COMMUNITY", "1", "HUB_ACCOUNT", "LOW", 5, "acc_7 has 3 links", ["acc_7"]),
        ("e3", "COMMUNITY", "2", "HUB_ACCOUNT", "LOW", 5, None, ["acc_BURST", None]),
        ("e4", "COMMUNITY", "3", "HUB_ACCOUNT", "LOW", 5, "acc_9 has 3 links", None),
        ("e5", "COMMUNITY", "3", "HUB_ACCOUNT", "MEDIUM", 12, "acc_8 has 5 links", ["acc_8"]),
    ]
    return spark.createDataFrame(rows, ITEM).coalesce(1)


def test_a_tally_counts_an_item_once(items):
    got = {(r.entity_id, r.type): (r.points, r.hit) for r in directory.tally(items, " Burst ").collect()}
    assert got == {("1", "TEMPORAL_BURST"): (25, True), ("1", "HUB_ACCOUNT"): (5, False), ("2", "HUB_ACCOUNT"): (5, True), ("3", "HUB_ACCOUNT"): (17, False)}


def test_a_tally_finds_what_items_find(items):
    once = evidence.distinct_items(items)
    rows = directory.signals(once).withColumn("risk_level", F.lit("LOW"))
    for text in ("burst", "acc_8", "links", "low", "none of these", ""):
        found = [sorted(r.community_id for r in directory.communities(rows, text, None, given).collect()) for given in (once, directory.tally(items, text))]
        assert found[0] == found[1]


@pytest.mark.parametrize("name", ["triage_search", "community_search"])
def test_a_search_stores_no_items(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("items aren't stored for a search")

    for module in (queries_directory, queries_directory.more, queries_graph):
        monkeypatch.setattr(module, "evidence_of", refuse)
    assert queries_directory.QUERIES[name](spark, SF).count() == 5


def test_inside_edges_read_stored_days(spark, tmp_path):
    net = Network(spark, SF)
    net.transactions.write.parquet(f"{tmp_path}/ledger")
    found = graph.project(net.accounts, net.links, spark.read.parquet(f"{tmp_path}/ledger"), net.membership)
    assert not any("ledger" in f for f in found.inputFiles())


def test_classes_of_one_account_are_not_gathered(spark, monkeypatch):
    moves = spark.createDataFrame([(f"a{k}", f"m{k}", None) for k in range(9)] + [("a1", "m0", None)], "account_id string, entity_id string, day date")
    links = spark.createDataFrame([], "kind string, entity_id string, account_id string")
    gathered = []
    monkeypatch.setattr(graph.F, "collect_list", lambda c, old=F.collect_list: gathered.append(1) or old(F.when(F.assert_true(F.col("place").isNotNull() & ((F.col("place") > 1) | F.col("next").isNotNull())).isNull(), c)))
    found = graph._placed(moves, links, moves.select("account_id").distinct(), ["kind", "entity_id", "day"]).collect()
    assert gathered and [(r.entity_id, r.a.account_id, [x.account_id for x in r.after]) for r in found] == [("m0", "a0", ["a1"])]
