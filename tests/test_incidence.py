"""The incidence form against pairs, on networks with hot entities."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.operators import graph, incidence

TX = "transaction_id string, timestamp string, src_account_id string, dst_account_id string, merchant_id string"


def network(spark, n, shared, moves, unknown=3):
    """shared: (kind, entity, accounts); moves: (day, src, dst, merchant). The last `unknown` accounts aren't in the catalog."""
    accounts = spark.createDataFrame([(f"a{k:05}",) for k in range(n - unknown)], "account_id string")
    links = spark.createDataFrame([(kind, f"a{k:05}", e) for kind, e, own in shared for k in own], "kind string, account_id string, entity_id string")
    rows = [(f"t{k}", f"2024-01-{d:02} 10:00:00", f"a{a:05}", f"a{b:05}", m) for k, (d, a, b, m) in enumerate(moves)]
    return accounts, links, spark.createDataFrame(rows, TX).withColumn("timestamp", F.to_timestamp("timestamp"))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    pick = lambda k: rng.sample(range(90), k)
    shared = [("ips", "hot", range(60)), ("ips", "hot|2", range(30, 75)), ("devices", "d|1", pick(25)), *(("devices", f"d{k}", pick(3)) for k in range(20)), *(("instruments", f"i{k}", pick(2)) for k in range(25)), ("ips", "alone", [5])]
    moves = [(rng.randrange(1, 9), *pick(2), rng.choice(["m1", "m2", "m3", None])) for _ in range(160)]
    return network(spark, 90, shared, moves)


@pytest.mark.parametrize("hot", [1, 4, 20, 1000])
def test_degrees_and_counts(mixed, spark, hot):
    edges = graph.project(*mixed)
    rows = incidence.memberships(*mixed)
    want = {r.account_id: r["count"] for r in graph.mirrored(edges.select("src", "dst")).groupBy("account_id").count().collect()}
    assert {r.account_id: r.degree for r in incidence.degrees(rows, hot).collect()} == want
    assert incidence.edge_counts(rows, hot).first().edges == edges.count()
    membership = mixed[0].withColumn("community_id", F.crc32(F.col("account_id").cast("binary")) % 4)
    inside = {r.community_id: r["count"] for r in graph.internal(edges, membership).groupBy("community_id").count().collect()}
    assert {r.community_id: r.edges for r in incidence.edge_counts(incidence.memberships(*mixed, membership), hot).collect()} == inside


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_strongest(mixed, k):
    want = graph.top_edges(graph.project(*mixed), k).collect()
    got = incidence.strongest(*mixed, k).select(want[0].__fields__).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_all_candidates_are_found(mixed):
    """With every bound, and accounts combined or not, all edges of that weight are among the candidates."""
    edges = graph.project(*mixed).select("src", "dst", "weight").collect()
    rows = incidence.shared(incidence.memberships(*mixed))
    profile = incidence.profiles(rows, mixed[2])
    counts = F.struct(*(F.size(incidence._merchants(F.col(c)) if c == "merchants" else F.col(c)).alias(c) for c in graph.KINDS), F.greatest(F.lit(0), F.coalesce(F.size("days"), F.lit(0))).alias("days"))
    sized = rows.join(profile.select("account_id", counts.alias("n")), "account_id")
    own = lambda kind: incidence._bound({x: F.col(f"n.{x}") for x in graph.KINDS}, F.col("n.days"), kind)
    bounded = sized.select("class_id", "members", "kind", "account_id", "n", incidence._by_kind(own).alias("bound")).cache()
    for least in (3.0, 6.0, 9.5, 13.0):
        for long in (0, 5, 48):
            found = {tuple(r) for r in incidence.candidates(bounded, least, long).collect()}
            assert {(r.src, r.dst) for r in edges if r.weight >= least} <= found
    bounded.unpersist()


def test_weighed_pairs_are_the_edges(mixed):
    edges = graph.project(*mixed)
    again = incidence.weighed(edges.select("src", "dst"), incidence.profiles(incidence.shared(incidence.memberships(*mixed)), mixed[2]))
    assert sorted(map(str, again.select(edges.columns).collect())) == sorted(map(str, edges.collect()))


def test_hot_entity_of_many_accounts(spark):
    """100 000 accounts at one address: results without their five thousand million pairs."""
    n = 100_000
    accounts = spark.range(n).select(F.format_string("a%05d", "id").alias("account_id"))
    links = accounts.select(F.lit("ips").alias("kind"), "account_id", F.lit("hot").alias("entity_id")).unionByName(
        spark.range(n).select(F.lit("devices").alias("kind"), F.format_string("a%05d", "id").alias("account_id"), F.concat(F.lit("d"), F.floor(F.col("id") / 3)).alias("entity_id"))
    )
    moves = spark.createDataFrame([("t1", "2024-01-01 10:00:00", "a00001", "a00002", "m")], TX).withColumn("timestamp", F.to_timestamp("timestamp"))
    rows = incidence.memberships(accounts, links, moves)
    found = incidence.degrees(rows).agg(F.count("*").alias("n"), F.min("degree").alias("a"), F.max("degree").alias("b")).first()
    assert tuple(found) == (n, n - 1, n - 1)
    assert incidence.edge_counts(rows).first().edges == n * (n - 1) // 2
    split = incidence.memberships(accounts, links, moves, accounts.withColumn("community_id", F.col("account_id").substr(2, 1).cast("long")))
    assert {r.edges for r in incidence.edge_counts(split).collect()} == {10_000 * 9_999 // 2}
    assert [(r.src, r.dst, r.weight) for r in incidence.strongest(accounts, links, moves, 1).collect()] == [("a00001", "a00002", 7.5)]
    sizes = incidence.blocks(rows).filter("class_id = 'ips||hot'").agg(F.sum(F.size("accounts")).alias("n"), F.max(F.size("accounts")).alias("most")).first()
    assert sizes.n == n and sizes.most < 3 * incidence.HOT


def test_empty(spark):
    none = network(spark, 5, [("ips", "x", [1])], [(1, 1, 2, None)])
    rows = incidence.memberships(*none)
    assert incidence.classes(rows).count() == incidence.degrees(rows).count() == incidence.strongest(*none, 3).count() == 0
    assert incidence.edge_counts(rows).first().edges == 0
    with pytest.raises(ValueError):
        incidence.memberships(none[0], none[1], none[2].withColumn("is_ring_member", F.lit(True)))


def test_edges_of_given_pairs(mixed, spark):
    """Pairs in either order, repeated, of one account, of unknown accounts, without an end."""
    edges = graph.project(*mixed)
    names = [f"a{k:05}" for k in range(0, 90, 2)]
    pairs = [(a, b) for a in names for b in names] + [("a00001", "a00003"), ("a00003", "a00001"), ("a00001", "nobody"), (None, "a00001"), ("a00001", None)]
    given = spark.createDataFrame(pairs, "a string, b string")
    got = incidence.of_pairs(given, *mixed).select(edges.columns).collect()
    either = {(min(p), max(p)) for p in pairs if None not in p}
    want = [tuple(r) for r in edges.collect() if (r.src, r.dst) in either]
    assert want and sorted(map(tuple, got)) == sorted(want)
    assert incidence.of_pairs(given.limit(0), *mixed).count() == 0
