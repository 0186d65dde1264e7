"""Paths over classes: the same accounts, parents and relations as over pairs, without making these."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.operators import graph, incidence, slices


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    names = [f"a{k:02d}" for k in range(60)]
    links = [("devices", a, f"d{k // 4}") for k, a in enumerate(names)] + [("ips", rng.choice(names[b : b + 9]), f"i{b // 3}") for b in range(0, 51) for _ in range(2)]
    moved = [("t1", 1, None, "a00", "a01", "m"), ("t2", 2, None, "a02", "a00", None)]
    rows = spark.createDataFrame(moved, "transaction_id string, row_seq long, timestamp timestamp, src_account_id string, dst_account_id string, merchant_id string").withColumn("amount", F.lit(1.0)).withColumn("transaction_status", F.lit("settled"))
    return spark.createDataFrame([(a,) for a in names], "account_id string"), spark.createDataFrame(sorted(set(links)), "kind string, account_id string, entity_id string"), rows


@pytest.mark.parametrize("few", [0, 200_000])
def test_classes_give_the_paths_of_pairs(tables, monkeypatch, few):
    monkeypatch.setattr(slices, "FEW", few)
    edges, classes = graph.project(*tables).cache(), incidence.memberships(*tables)
    assert sorted(slices.reach(edges, "a00", None).collect(), key=str) == sorted(slices.reach(classes, "a00", None).collect(), key=str)
    want = slices.shortest_path(edges, "a00", "a29", tables[2]).collect()
    assert len(want) > 2 and slices.class_path(classes, "a00", "a29", *tables).collect() == want


def test_a_hot_class_makes_no_pairs(spark):
    """20,000 accounts at one address are 200 million pairs."""
    classes = spark.range(20_000).select(F.lit("ips||x").alias("class_id"), F.concat(F.lit("a"), "id").alias("account_id"))
    assert slices.shortest_path(classes, "a3", "a17000").collect() == [(1, "a3", "a17000")]


def test_classes_of_one_account_are_no_ways(spark):
    rows = [("ips||x", "a1"), ("ips||x", "a2"), ("devices||d1", "a1"), ("devices||d2", "a2"), ("ips||y", "a2"), ("ips||y", "a3")]
    ways = slices._ways(spark.createDataFrame(rows, "class_id string, account_id string"))
    assert sorted(map(tuple, ways.collect())) == [("ips||x", "a1"), ("ips||x", "a2"), ("ips||y", "a2"), ("ips||y", "a3")]


def test_starts_and_paths_need_no_python_worker(spark):
    classes = spark.range(3).select(F.lit("ips||x").alias("class_id"), F.concat(F.lit('a"\\'), "id").alias("account_id"))
    path = slices.shortest_path(classes, 'a"\\0', 'a"\\2')
    for table in (slices._start(classes, 'a"\\0'), path):
        assert "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert path.collect() == [(1, 'a"\\0', 'a"\\2')]
    assert slices._start(classes, "a").collect() == [("a", 0, None)]
    assert slices.shortest_path(classes, 'a"\\0', "b").collect() == []
