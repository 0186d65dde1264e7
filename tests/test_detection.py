"""Detection: exact optima of small graphs, connected communities, one modularity whatever way it is counted."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ringweave.operators import communities, stored


def partitions(n):
    def grow(own, k):
        if len(own) == n:
            yield own
            return
        for c in range(k + 1):
            yield from grow([*own, c], max(k, c + 1))

    yield from grow([], 0)


def quality(edges, own, resolution=1.0):
    m2, k, inside, total = 2 * sum(w for *_, w in edges), {}, 0.0, {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += 2 * w if own[a] == own[b] else 0
    for x, d in k.items():
        total[own[x]] = total.get(own[x], 0) + d
    return inside / m2 - resolution * sum((t / m2) ** 2 for t in total.values())


def clique(nodes, w=1.0):
    return [(a, b, w) for a in nodes for b in nodes if a < b]


def detected(spark, n, edges, **k):
    nodes = spark.createDataFrame([(f"n{x}",) for x in range(n)], "account_id string")
    rows = spark.createDataFrame([(f"n{a}", f"n{b}", float(w)) for a, b, w in edges], "src string, dst string, weight double")
    found = {int(r.account_id[1:]): r.community_id for r in communities.detect(nodes, rows, **k).collect()}
    return [found[x] for x in range(n)], rows


SMALL = {
    "two triangles": (6, clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3, 1.0)]),
    "ring of triangles": (9, clique([0, 1, 2]) + clique([3, 4, 5]) + clique([6, 7, 8]) + [(2, 3, 1.0), (5, 6, 1.0), (8, 0, 1.0)]),
    "weights": (8, clique(range(4), 2.0) + clique(range(4, 8), 3.0) + [(a, b, 0.3) for a in range(4) for b in range(4, 8)]),
    "a star and a pair": (7, [(0, k, 1.0) for k in range(1, 5)] + [(5, 6, 2.0), (4, 5, 0.5)]),
}


@pytest.mark.parametrize("name", SMALL)
def test_small_optima(spark, name):
    n, edges = SMALL[name]
    got, rows = detected(spark, n, edges)
    assert quality(edges, got) == pytest.approx(max(quality(edges, own) for own in partitions(n)), abs=1e-9)
    membership = spark.createDataFrame([(f"n{x}", c) for x, c in enumerate(got)], "account_id string, community_id long")
    assert communities.modularity(membership, rows).first()[0] == pytest.approx(quality(edges, got))


def test_communities_are_connected(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.choice([0.5, 1.0, 3.0])) for b in range(70) for a in range(b) if rng.random() < (0.35 if a // 14 == b // 14 else 0.01)]
    got, _ = detected(spark, 70, edges)
    assert quality(edges, got) >= quality(edges, [x // 14 for x in range(70)]) - 0.01
    parent = list(range(70))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        if got[a] == got[b]:
            parent[root(a)] = root(b)
    assert len({root(x) for x in range(70)}) == len(set(got))


def test_refinement_splits_what_no_edge_joins(spark):
    """Two triangles in one community are two parts, and stay one community of the level above."""
    edges = clique([0, 1, 2]) + clique([3, 4, 5])
    state = spark.createDataFrame([(f"n{k}", "one", 2.0, 0.0) for k in range(6)], "node string, comm string, k double, loop double")
    both = spark.createDataFrame([(f"n{a}", f"n{b}", w) for x, y, w in edges for a, b in ((x, y), (y, x))], "node string, peer string, weight double")
    parts = communities._refined(state, both, 12.0, 1.0, "s", rounds=8)
    by = parts.groupBy("comm").agg(F.array_sort(F.collect_list("node")).alias("own")).collect()
    assert all(set(r.own) <= {"n0", "n1", "n2"} or set(r.own) <= {"n3", "n4", "n5"} for r in by)
    level, _, above = communities._contracted(parts, both)
    assert {r.comm for r in above.collect()} == {"n0"} and above.agg(F.sum("k")).first()[0] == 12.0
    assert level.count() == 6


def test_edges_lie_by_peer_and_move_once_a_round(spark):
    edges = clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3, 1.0)]
    both = stored.dealt(spark.createDataFrame([(x, y, w) for a, b, w in edges for x, y in ((a, b), (b, a))], "node long, peer long, weight double"), "louvain-both", "peer")
    state = stored.cut(spark.createDataFrame([(k, k, 2.0 + (k in (2, 3)), 0.0) for k in range(6)], "node long, comm long, k double, loop double"), "louvain-state")
    moves = communities._weighed_moves(state, both, 14.0, 1.0, 1)
    plan = moves._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, \d+\), (\w+)", plan)
    # the state goes to the edges' peers, and what comes of edges to the nodes
    assert sum(by == "peer" for by, _ in moved) == 1 and sum(how == "REPARTITION_BY_COL" for _, how in moved) == 1, moved
    assert {r.node: r.target for r in moves.collect() if r.node in (0, 5)} == {0: 1, 5: 4}


def test_loops_strangers_and_accounts_alone(spark):
    edges = clique([0, 1, 2]) + clique([3, 4, 5]) + [(2, 3, 1.0), (6, 6, 2.0), (0, 9, 0.5), (9, 9, 1.0)]
    got, _ = detected(spark, 8, edges)
    assert len({*got[:3]}) == len({*got[3:6]}) == 1 and len(set(got)) == 4 and sorted(set(got)) == list(range(4))
