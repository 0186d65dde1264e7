"""Exact values on hand-made networks."""

import math

import pytest
from pyspark.sql import functions as F

from ringweave.functions import hashing, rules
from ringweave.operators import cases, communities, contracts, enrich, evidence, features, filters, graph, labels, marts, scoring, slices

TX = "transaction_id string, timestamp timestamp, src_account_id string, dst_account_id string, amount double, merchant_id string, transaction_status string, payment_method string, row_seq long"
EDGE = "src string, dst string, instruments array<string>, devices array<string>, ips array<string>, merchants array<string>, temporal_overlap int, weight double"


def stamps(spark, rows, schema):
    return spark.createDataFrame(rows, schema.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp"))


def tx(spark, rows):
    return stamps(spark, [(i, t, a, b, float(v), m, s, p, k) for k, (i, t, a, b, v, m, s, p) in enumerate(rows)], TX)


@pytest.fixture(scope="module")
def net(spark):
    accounts = spark.createDataFrame([(f"acc_{i}",) for i in range(13)], "account_id string")
    own = {}
    for kind, prefix, pair in (("instruments", "ins", (1, 2)), ("devices", "dev", (3, 4)), ("ips", "10.0.0.", (5, 6))):
        for i in range(13):
            own[kind, i] = f"{prefix}_shared" if i in pair else f"{prefix}{i}"
    links = spark.createDataFrame([(k, f"acc_{i}", e) for (k, i), e in own.items()], "kind string, account_id string, entity_id string")
    moves = [
        ("tx_1", "2024-01-05T10:00:00", 7, 0, 100, "mch_M"), ("tx_2", "2024-01-05T11:00:00", 0, 8, 120, "mch_M"), ("tx_3", "2024-03-03T09:00:00", 9, 0, 140, "mch_N"), ("tx_4", "2024-03-03T10:00:00", 0, 10, 160, "mch_N"),
        ("tx_5", "2024-01-01T08:00:00", 11, 0, 180, "mch_P"), ("tx_6", "2024-02-01T08:00:00", 0, 12, 200, "mch_P"), ("tx_7", "2024-01-02T08:00:00", 5, 0, 220, "mch_Q"), ("tx_8", "2024-01-03T08:00:00", 6, 0, 240, "mch_R"),
    ]
    moved = tx(spark, [(i, t, f"acc_{a}", f"acc_{b}", v, m, "settled", "card") for i, t, a, b, v, m in moves])
    return accounts, links, moved


def test_projection(net):
    accounts, links, moved = net
    e = {(r.src, r.dst): r for r in graph.project(accounts, links, moved).collect()}
    assert e["acc_1", "acc_2"].instruments == ["ins_shared"] and e["acc_1", "acc_2"].weight == 4.0
    assert e["acc_3", "acc_4"].devices == ["dev_shared"] and e["acc_5", "acc_6"].ips == ["10.0.0._shared"]
    assert e["acc_7", "acc_8"].merchants == ["mch_M"] and e["acc_7", "acc_8"].temporal_overlap == 1 and e["acc_7", "acc_8"].weight == 2.5
    assert ("acc_11", "acc_12") not in e and ("acc_1", "acc_5") not in e
    with pytest.raises(ValueError):
        graph.project(accounts, links, moved.withColumn("is_ring_member", F.lit(True)))


def test_projection_does_not_depend_on_partitions(net):
    accounts, links, moved = net
    a = graph.project(accounts, links, moved).collect()
    b = graph.project(accounts.repartition(7), links.repartition(3), moved.orderBy(F.rand())).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_typed_graph(net):
    accounts, links, moved = net
    merchants = moved.select("merchant_id").distinct()
    n = {r.type: r["count"] for r in graph.typed_nodes(accounts, merchants, links, moved).groupBy("type").count().collect()}
    assert n["Account"] == 13 and n["Transaction"] == 8 and n["Merchant"] == 5
    n = {r.type: r["count"] for r in graph.typed_edges(links, moved).groupBy("type").count().collect()}
    assert n == {"USES_DEVICE": 13, "USES_INSTRUMENT": 13, "USES_IP": 13, "FROM_ACCOUNT": 8, "TO_ACCOUNT": 8, "AT_MERCHANT": 8}


def test_merchant_blocking_bounds_pairs(spark):
    accounts = spark.createDataFrame([(f"a{i:03d}",) for i in range(500)], "account_id string")
    moved = tx(spark, [(f"tx_{i}", f"2024-01-{1 + i // 5 % 28:02d}T10:00:00", f"a{i:03d}", f"a{i:03d}", 1, "m", "settled", "card") for i in range(500)])
    none = spark.createDataFrame([], "kind string, account_id string, entity_id string")
    assert graph.project(accounts, none, moved).count() < 5000


def test_weights(spark):
    one = spark.range(1)
    w = lambda i, d, m, p, days: one.select(rules.evidence_weight({"instruments": F.lit(i), "devices": F.lit(d), "merchants": F.lit(m), "ips": F.lit(p)}, F.lit(days))).first()[0]
    assert (w(1, 0, 0, 0, 0), w(0, 1, 0, 0, 0), w(0, 0, 0, 1, 0), w(0, 1, 0, 0, 2), w(1, 0, 0, 0, 100)) == (4.0, 3.0, 1.0, 4.5, 8.0)


def triangles(spark):
    rows = [("a1", "a2", 10.0), ("a1", "a3", 10.0), ("a2", "a3", 10.0), ("b1", "b2", 8.0), ("b1", "b3", 8.0), ("b2", "b3", 8.0), ("a1", "b1", 0.5)]
    return spark.createDataFrame([(a, b, [], [], [], [], 0, w) for a, b, w in rows], EDGE)


def test_detection(spark):
    edges = triangles(spark)
    nodes = spark.createDataFrame([(n,) for n in ("a1", "a2", "a3", "b1", "b2", "b3", "solo")], "account_id string")
    got = {r.account_id: r.community_id for r in communities.detect(nodes, edges).collect()}
    assert got == {"a1": 0, "a2": 0, "a3": 0, "b1": 1, "b2": 1, "b3": 1, "solo": 2}
    assert got == {r.account_id: r.community_id for r in communities.detect(nodes.repartition(5), edges.repartition(3)).collect()}
    alone = communities.detect(nodes, edges.limit(0))
    assert sorted(r.community_id for r in alone.collect()) == list(range(7))
    m = spark.createDataFrame(list(got.items()), "account_id string, community_id long")
    s = {r.community_id: r for r in communities.structure(m, graph.internal(edges, m)).collect()}
    assert (s[0].member_count, s[0].internal_edges, s[0].total_weight, s[0].density) == (3, 3, 30.0, 1.0) and (s[2].internal_edges, s[2].density) == (0, 0.0)
    k, m2 = {0: 60.5, 1: 48.5}, 109.0
    want = (60 / m2 - (k[0] / m2) ** 2) + (48 / m2 - (k[1] / m2) ** 2)
    assert communities.modularity(m, edges).first()[0] == pytest.approx(want)


def test_planted_partition(spark):
    import random

    rng = random.Random(0)
    rows = {(f"n{min(a, b):03d}", f"n{max(a, b):03d}") for a in range(60) for b in range(60) if a != b and rng.random() < (0.5 if a // 15 == b // 15 else 0.02)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(rows)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i:03d}", i // 15) for i in range(60)], "account_id string, community_id long")
    got = communities.detect(nodes.select("account_id"), edges)
    assert communities.modularity(got, edges).first()[0] >= communities.modularity(nodes, edges).first()[0] - 0.01


def test_temporal_statistics(spark):
    m = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "account_id string, community_id long")
    rows = [("a", "2024-01-05T10:00:00"), ("a", "2024-01-05T10:20:00"), ("a", "2024-01-05T10:40:00"), ("b", "2024-01-01T00:00:00"), ("b", "2024-01-02T12:00:00"), ("c", "2024-01-01T08:30:00")]
    s = {r.community_id: r for r in communities.activity_stats(m, tx(spark, [(f"tx_{k}", t, a, "x", 1, None, "settled", "card") for k, (a, t) in enumerate(rows)])).collect()}
    assert (s[0].tx_count, s[0].active_hours, s[0].median_gap_hours, s[0].compression) == (3, 1, pytest.approx(1 / 3), pytest.approx(3 / (3 + 2 / 3)))
    assert (s[1].tx_count, s[1].active_hours, s[1].median_gap_hours, s[1].span_hours, s[1].compression) == (2, 2, 36.0, 36.0, pytest.approx(2 / 38))
    assert (s[2].tx_count, s[2].median_gap_hours, s[2].span_hours, s[2].compression) == (1, None, 0.0, 1.0)


def test_community_features(spark):
    m = spark.createDataFrame([("a1", 0), ("a2", 0), ("a3", 0), ("b1", 1), ("c1", 2), ("c2", 2)], "account_id string, community_id long")
    edges = spark.createDataFrame(
        [("a1", "a2", ["ins_1", "ins_2"], ["dev_1"], ["ip_1"], ["mch_1"], 2, 6.0), ("a1", "a3", ["ins_1"], ["dev_2"], ["ip_2"], ["mch_1", "mch_2"], 1, 4.0), ("a2", "a3", [], [], [], ["mch_2"], 0, 2.0), ("c1", "c2", [], [], [], [], 0, 1.0)], EDGE
    )
    t = "2024-01-01T10:00:00"
    moved = tx(spark, [("1", t, "a1", "x", 100, "mch_1", "settled", "card"), ("2", t, "a2", "a3", 200, "mch_2", "declined", "upi"), ("3", "2024-01-01T11:00:00", "a3", "a1", 150, "mch_1", "settled", "card"), ("4", t, "c1", "c2", 300, "mch_1", "settled", "card"), ("5", t, "x", "y", 999, "mch_3", "settled", "netbanking")])
    shops = spark.createDataFrame([("mch_1", "grocery"), ("mch_2", "electronics"), ("mch_3", "travel")], "merchant_id string, category string")
    inside = graph.internal(edges, m)
    f = {r.community_id: r for r in features.community_features(m, inside, moved, shops).collect()}
    a, b, c = f[0], f[1], f[2]
    assert (a.member_count, a.density, a.mean_edge_weight, a.weight_per_member) == (3, 1.0, 4.0, 4.0)
    assert (a.unique_shared_instruments, a.unique_shared_devices, a.unique_shared_ips, a.unique_shared_merchants) == (2, 2, 2, 2)
    assert (a.temporal_overlap_mean, a.total_transaction_amount, a.mean_tx_amount, a.amount_cv) == (1.0, 450, 150, pytest.approx(1 / 3))
    assert (a.declined_rate, a.unique_payment_methods, a.merchant_category_entropy) == (pytest.approx(1 / 3), 2, pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)))
    assert (b.mean_edge_weight, b.weight_per_member, b.mean_tx_amount, b.declined_rate, b.merchant_category_entropy, b.unique_payment_methods) == (None, 0.0, None, None, None, 0)
    assert (c.mean_tx_amount, c.amount_cv, c.merchant_category_entropy) == (300, None, 0.0)
    bare = features.community_features(m, inside, moved.drop("transaction_status", "payment_method", "merchant_id")).collect()
    assert all(r.declined_rate is None and r.merchant_category_entropy is None and r.unique_payment_methods is None for r in bare)
    assert features.community_features(m.limit(0), inside, moved, shops).columns == ["community_id", *features.FEATURES]
    with pytest.raises(ValueError):
        features.community_features(m, inside, moved.withColumn("pattern_id", F.lit("")))


def test_ring_labels(spark):
    rings = spark.createDataFrame([("ring_1", 0, "f1|f2| f3|f4|"), ("ring_2", 1, "g1|g2|g3|g4|g5"), ("ring_3", 2, None)], "pattern_id string, ring_order long, involved_accounts string")
    sets = {0: ["f1", "c1", "c2"], 1: ["f2", "f3", "c3"], 2: ["g1", "g2", "g3", "g4", "c4"], 3: ["c5", "c6", "c7"]}
    m = spark.createDataFrame([(a, c) for c, own in sets.items() for a in own], "account_id string, community_id long")
    got = {r.community_id: r for r in labels.community_labels(m, labels.ring_members(rings)).collect()}
    assert [(got[c].max_ring_coverage, got[c].primary_ring_id, got[c].is_positive, got[c].fraud_account_count, got[c].fraud_purity) for c in range(4)] == [
        (0.25, "ring_1", 0, 1, 0.333333), (0.5, "ring_1", 1, 2, 0.666667), (0.8, "ring_2", 1, 4, 0.8), (0.0, None, 0, 0, 0.0),
    ]
    both = spark.createDataFrame([(a, 0) for a in ("f1", "g1", "g2", "g3", "c")], "account_id string, community_id long")
    r = labels.community_labels(both, labels.ring_members(rings)).first()
    assert (r.max_ring_coverage, r.primary_ring_id, r.num_rings_intersected, r.is_positive) == (0.6, "ring_2", 2, 1)
    with pytest.raises(ValueError):
        labels.community_labels(m, labels.ring_members(rings), 0)


@pytest.mark.parametrize(("kind", "n", "severity"), [("instruments", 5, "HIGH"), ("instruments", 3, "MEDIUM"), ("devices", 2, "LOW"), ("ips", 8, "HIGH"), ("ips", 4, "MEDIUM"), ("ips", 2, "LOW"), ("merchants", 6, "HIGH"), ("merchants", 3, "MEDIUM")])
def test_sharing(spark, kind, n, severity):
    rows = [("a0", f"a{i}", *([["e"] if k == kind else [] for k in ("instruments", "devices", "ips", "merchants")]), 0, 1.0, 7) for i in range(1, n)]
    inside = spark.createDataFrame(rows, EDGE + ", community_id long")
    found = evidence.sharing(inside, kind).collect()
    assert [r.severity for r in found] == [severity] and found[0].metrics["account_count"] == str(n)


@pytest.mark.parametrize(("times", "want"), [([60 * i for i in range(15)], ("HIGH", 15)), ([60 * i for i in range(8)], ("MEDIUM", 8)), ([0, 3 * 3600, 8 * 3600, 11 * 3600], ("LOW", 4)), ([0, 60], None), ([*range(7), 3600], ("MEDIUM", 8)), ([*range(7), 3607], ("LOW", 8))])
def test_bursts(spark, times, want):
    rows = [("k", 1704067200 + 3000 + s, f"tx_{j}") for j, s in enumerate(times)]
    df = spark.createDataFrame(rows, "community_id string, s long, transaction_id string").select("community_id", F.timestamp_seconds("s").alias("timestamp"), "transaction_id")
    found = evidence.bursts(df, "community_id", "COMMUNITY").collect()
    assert [(r.severity, int(r.metrics["transaction_count"])) for r in found] == ([want] if want else [])


@pytest.mark.parametrize(("gap", "n", "severity"), [(300, 10, "HIGH"), (3600, 5, "MEDIUM"), (3 * 3600, 5, "LOW"), (86400, 5, None), (1, 1, None), (1800, 5, "MEDIUM"), (7200, 4, "LOW"), (6 * 3600, 4, None)])
def test_rapid(spark, gap, n, severity):
    df = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * gap).alias("timestamp"))
    assert [r.severity for r in evidence.rapid(df, "k", "COMMUNITY").collect()] == ([severity] if severity else [])


def test_hubs_and_layers(spark):
    rows = [("hub", f"s{i:02d}", ["i"] if i < 3 else [], ["d"] if i < 2 else [], ["p"] if i < 1 else [], [], 0, 1.0) for i in range(20)]
    edges = spark.createDataFrame(rows, EDGE)
    m = spark.createDataFrame([("hub", 0), *((f"s{i:02d}", 0) for i in range(20))], "account_id string, community_id long")
    inside = graph.internal(edges, m)
    found = evidence.hubs(m, inside).collect()
    assert [(r.metrics["account_id"], r.severity) for r in found] == [("hub", "HIGH")]
    assert evidence.hubs(m, inside.limit(0)).count() == 0
    assert sorted(r.severity for r in evidence.multi_layer(inside).collect()) == ["HIGH", "MEDIUM"]
    score = evidence.scores(spark.createDataFrame([("A", "1", f"e{i}", "HIGH", 25) for i in range(6)], "entity_type string, entity_id string, evidence_id string, severity string, points int")).first()
    assert (score.evidence_score, score.raw_score, score.high_count) == (100, 150, 6)


@pytest.mark.parametrize(("w", "severity"), [(10.1, "HIGH"), (10.0, "MEDIUM"), (3.0, "LOW"), (0.5, None)])
def test_density(spark, w, severity):
    df = spark.createDataFrame([(1, w, 1.0, 0.1, 3.0)], "community_id long, weight_per_member double, mean_edge_weight double, density double, member_count double")
    assert [r.severity for r in evidence.density(df).collect()] == ([severity] if severity else [])


def test_hashes(spark):
    import hashlib

    keys = [f"acc_{i}" for i in range(200)] + [""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    parts = hashing.halves(F.col("k"), "s")
    rows = df.select("k", hashing.stable_int(F.col("k"), "s").alias("i"), *(hashing.slice_ratio(parts, s, b).alias(f"r{s}") for s, b in ((0, 16), (16, 16), (32, 16), (48, 16), (3, 8), (27, 8)))).collect()
    for r in rows:
        v = int.from_bytes(hashlib.sha256(f"s|{r.k}".encode()).digest()[:8], "big")
        assert int(r.i) == v and all(getattr(r, f"r{s}") == (v >> s & (1 << b) - 1) / (1 << b) for s, b in ((0, 16), (16, 16), (32, 16), (48, 16), (3, 8), (27, 8)))


def test_enrichment_properties(spark):
    accounts = spark.range(200).select(F.concat(F.lit("acc_"), "id").alias("account_id"), F.lit("2023-06-01").cast("date").alias("creation_date"))
    raw = spark.range(600).select(F.concat(F.lit("tx_"), "id").alias("tx_id"), F.concat(F.lit("acc_"), F.col("id") % 200).alias("src_id"), F.concat(F.lit("acc_"), F.col("id") * 7 % 200).alias("dst_id"), (F.col("id") * 1.5).alias("amount"), F.to_timestamp(F.lit("2023-01-01")).alias("timestamp"))
    rings = spark.createDataFrame([("pat_0", "|".join(f"acc_{i}" for i in range(180, 190)))], "pattern_id string, involved_accounts string")
    members = labels.ring_members(rings)
    patterns, profiles = enrich.first_patterns(members), enrich.ring_profiles(rings, 200)
    run = lambda df, seed=42: enrich.enrich(df, accounts, enrich.assignments(accounts, 200, profiles, patterns, seed), 200, profiles, patterns)
    a = sorted(map(str, run(raw).collect()))
    assert a == sorted(map(str, run(raw.repartition(9)).collect())) and a != sorted(map(str, run(raw, 7).collect()))
    out = run(raw)
    assert out.columns == list(contracts.OBSERVABLE) and out.filter("account_age_days <> 0").count() == 0
    labelled = contracts.ordered(enrich.attach_labels(out, enrich.account_patterns(members)))
    assert labelled.columns[-2:] == ["pattern_id", "is_ring_member"]
    assert sorted(map(str, labelled.drop("pattern_id", "is_ring_member").collect())) == a
    assert labelled.filter("is_ring_member").count() > 0


def test_scoring(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 21))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    m = spark.createDataFrame(rows, "community_id long, " + ", ".join(f"{f} double" for f in features.FEATURES)).withColumn("density", F.when(F.col("community_id") > 3, F.col("density")))
    y = spark.createDataFrame([(i, int(x[i, 0] + 0.3 * x[i, 5] > 0.4)) for i in range(60)], "community_id long, is_positive int")
    s = scoring.score(m, y).collect()
    assert len(s) == 60 and all(0 <= r.risk_score <= 100 and r.risk_tier == ("HIGH" if r.probability >= 0.6 else "MEDIUM" if r.probability >= 0.35 else "LOW") for r in s)
    z = scoring.standardised(m)
    model = scoring.logistic(scoring.balanced(scoring._vectors(scoring.labelled(z, y))))
    a = np.array([[r[f] for f in features.FEATURES] for r in z.orderBy("community_id").collect()])
    t = np.array([r.is_positive for r in y.orderBy("community_id").collect()])
    sw = np.where(t == 1, 60 / (2 * t.sum()), 60 / (2 * (60 - t.sum())))
    w, b = np.zeros(21), 0.0  # Newton on the regularised, weighted loss
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w + b)))
        g = np.r_[a.T @ (sw * (p - t)) + w, (sw * (p - t)).sum()]
        ab = np.c_[a, np.ones(60)]
        h = ab.T @ (ab * (sw * p * (1 - p))[:, None]) + np.diag([1.0] * 21 + [0.0])
        step = np.linalg.solve(h, g)
        w, b = w - step[:21], b - step[21]
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-5)
    cv = scoring.cross_validate(m, y, 2, 1, 5)
    assert cv.count() == 10 and cv.filter("mean < 0 OR mean > 1").count() == 0
    with pytest.raises(ValueError):
        scoring.score(m, y.filter("community_id > 1000"))
    with pytest.raises(ValueError):
        scoring.imputed(m.withColumn("fraud_purity", F.lit(0.0)))


def test_folds_are_fitted_together(spark):
    """Every model of 3 x 3 folds is the one that a fit of its own gives; folds hold each row once a repeat, classes evenly."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) * [1, 3, 0.1, 1, 1] + [0, 5, 0, 0, 2]
    x[:, 3] = 1.5  # constant
    rows = spark.createDataFrame([(i, float(v[0] + v[1] / 3 - 1.5 + rng.normal() > 0), v.tolist()) for i, v in enumerate(x)], "community_id long, label double, x array<double>").cache()
    dealt = scoring.dealt_repeats(rows, 3, 3, 7).cache()
    models, held_out = scoring.logistic_folds(dealt, 3)
    assert len(models) == 9 and held_out.count() == 270
    sizes = dealt.groupBy("repeat", "label", "fold").count().groupBy("repeat", "label").agg((F.max("count") - F.min("count")).alias("spread")).collect()
    assert len(sizes) == 6 and all(r.spread <= 1 for r in sizes)
    data = {(r.repeat, r.community_id): (r.fold, r.label, r.x) for r in dealt.collect()}
    assert len(data) == 270
    for (repeat, fold), (mean, scale, weight, w) in models.items():
        own = [(y, v) for (q, _), (f, y, v) in data.items() if q == repeat and f != fold]
        y, v = np.array([a for a, _ in own]), np.array([b for _, b in own])
        assert np.allclose(mean, v.mean(axis=0)) and np.allclose(scale[[0, 1, 2, 4]], v.std(axis=0)[[0, 1, 2, 4]]) and np.isinf(scale[3])
        z = np.c_[(v - mean) / scale, np.ones(len(v))]
        sw = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        p = 1 / (1 + np.exp(-(z @ w)))
        assert np.abs(z.T @ (sw * (p - y)) + np.r_[w[:-1], 0]).max() < 1e-7  # where the gradient is zero is the fit
    rows.unpersist()


def test_ranking_metrics(spark):
    rows = [(1.0, 0.9), (0.0, 0.9), (1.0, 0.7), (0.0, 0.4), (1.0, 0.4), (0.0, 0.1)]
    r = scoring.ranking_metrics(spark.createDataFrame([("m", *x) for x in rows], "model string, label double, p double"), ["model"]).first()
    auc = sum((a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z) / 9
    assert r.roc_auc == pytest.approx(auc)
    assert r.average_precision == pytest.approx((1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))
    assert (r.precision, r.recall, r.f1) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_marts(net, spark):
    _, _, moved = net
    s = {r.account_id: r for r in marts.account_stats(moved).collect()}
    assert (s["acc_0"].sent_count, s["acc_0"].received_count, s["acc_0"].sent_amount) == (3, 5, 480.0)
    loop = tx(spark, [("tx_1", "2024-01-01T00:00:00", "a", "a", 5, None, "declined", "card")])
    r = marts.account_stats(loop).first()
    assert (r.sent_count, r.received_count, r.declined_count) == (1, 1, 2) and marts.ledger(loop).count() == 1
    p = marts.pairs(moved).agg(F.sum(F.col("forward_count") + F.col("reverse_count"))).first()[0]
    assert p == 8


def test_peers_bounded_join(spark):
    n = 160
    rows = [(f"a{i:03d}", 0, i, float(i * 10), i % 3, i % 7) for i in range(n)]
    df = spark.createDataFrame(rows, "account_id string, community_id long, tx_count long, tx_volume double, declined_count long, connections long")
    got = {r.account_id: r for r in marts.peers(df, 150).collect()}
    import statistics

    for i in (0, 5, 149, 150, 151, 159):
        own = [r for k, r in enumerate(rows) if k != i][:150]
        assert got[f"a{i:03d}"].peer_sample_size == 150
        assert got[f"a{i:03d}"].peer_median_tx_count == round(statistics.median(r[2] for r in own), 1)


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "e", 1.0), ("d", "e", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    assert [(r.hop, r.src, r.dst) for r in slices.shortest_path(edges, "a", "d").orderBy("hop").collect()] == [(1, "a", "e"), (2, "e", "d")]
    assert slices.shortest_path(edges, "a", "y").count() == 0


def test_paths_from_both_ends(spark):
    """Hops, ties and reach against a search in Python."""
    import random

    rng = random.Random(12)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(46)} | {(50 + k, 51 + k) for k in range(8)}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(f"n{a}", set()).add(f"n{b}")
        near.setdefault(f"n{b}", set()).add(f"n{a}")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs], "src string, dst string, weight double").cache()

    def levels(start):
        out, seen = [{start}], {start}
        while out[-1]:
            out.append({y for x in out[-1] for y in near.get(x, ())} - seen)
            seen |= out[-1]
        return out[:-1]

    starts = sorted(near)
    for start, end in [(rng.choice(starts), rng.choice(starts)) for _ in range(4)] + [("n50", "n58"), ("n50", "n1"), ("n3", "n3")]:
        by = levels(start)
        at, want = end, []
        if any(end in x for x in by):
            for level in by[: next(k for k, x in enumerate(by) if end in x)][::-1]:
                before = min(level & near[at])
                want.append((before, at))
                at = before
        got = [(r.src, r.dst) for r in slices.shortest_path(edges, start, end).orderBy("hop").collect()]
        assert got == want[::-1]
    found = {(r.account_id, r.hops) for r in slices.reach(edges, "n50", 5).collect()}
    assert found == {(x, k) for k, level in enumerate(levels("n50")[:6]) for x in level}
    edges.unpersist()


def test_stream_restarts(spark, tmp_path):
    """A second run from the same checkpoint takes only new files, and joins the static tables as they are then."""
    from ringweave.streaming.ledger import append

    def raw(ids):
        return spark.createDataFrame([(i, i % 3, float(i)) for i in ids], "tx_id long, account long, amount double")

    def run(names):
        static = spark.createDataFrame(list(names.items()), "account long, name string")
        stream = spark.readStream.schema("tx_id long, account long, amount double").parquet(f"file://{tmp_path}/raw").join(static, "account", "left")
        append(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination()
        return {(r.tx_id, r.name) for r in spark.read.schema("account long, tx_id long, amount double, name string").parquet(f"file://{tmp_path}/out").collect()}

    first, then = {0: "a", 1: "b"}, {0: "A", 1: "b", 2: "c"}
    raw(range(10)).repartition(3).write.parquet(f"file://{tmp_path}/raw")
    one = run(first)
    assert one == {(i, first.get(i % 3)) for i in range(10)}
    raw(range(10, 17)).write.mode("append").parquet(f"file://{tmp_path}/raw")
    want = one | {(i, then[i % 3]) for i in range(10, 17)}
    assert run(then) == want and run(then) == want


def test_filters(spark):
    df = spark.createDataFrame([("tx_1", 5.0, 0.7), ("TX_2", 10.0, None), ("acc_1", 15.0, 0.4)], "id string, amount double, risk_score double")
    assert filters.between(df, "amount", 5, 10).count() == 2 and filters.prefix(df, " Tx_", ["id"]).count() == 2
    assert filters.risk(df, level="LOW").first().id == "TX_2" and filters.substring(df, None, ["id"]).count() == 3
    assert [r.v for r in df.select(filters.is_transaction_id(F.col("id")).alias("v")).collect()] == [True, True, False]


def test_cases(spark):
    schema = "case_id string, status string, source_community_id long, targets array<struct<type:string,id:string>>, decision struct<disposition:string,rationale:string,snapshot:struct<n:int>>, sar_exported boolean"
    rows = [("1", "OPEN", 1, [("ACCOUNT", "Acc_1")], ("MONITOR", "because", (1,)), True), ("2", "CLOSED", 2, [("ACCOUNT", "acc_2")], ("MONITOR", " ", (1,)), False), ("3", "OPEN", None, [], None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.case_id: r for r in cases.readiness(df).collect()}
    assert got["1"].dossier_status == "READY" and got["1"].open_checks == 0
    assert got["2"].outstanding == "rationale,export" and got["3"].open_checks == 6
    n = {(r.measure, r.key): r.n for r in cases.register(df).collect()}
    assert n == {("status", "OPEN"): 2, ("status", "CLOSED"): 1, ("disposition", "MONITOR"): 2, ("disposition", "PENDING"): 1, ("sar", "exported"): 1, ("dossier", "READY"): 1}
    ids = spark.createDataFrame([("acc_1",), ("acc_2",)], "id string")
    assert [r.id for r in cases.in_open_case(ids, df).collect()] == ["acc_1"]


def test_sources(spark, tmp_path):
    from ringweave.sources import io

    (tmp_path / "a.csv").write_text("account_id,customer_name,balance,risk_score,creation_date\nacc_1,Ann,1.5,0.2,2023-01-02\n")
    assert io.read_accounts(spark, f"{tmp_path}/a.csv").first().creation_date.isoformat() == "2023-01-02"
    head = "tx_id,src_id,dst_id,amount,timestamp,description,embedding\n"
    (tmp_path / "m.csv").write_text(head + "".join(f"tx_{i},a,b,{i},2024-01-01T00:00:0{i},x,0.1|0.2\n" for i in range(5)))
    (tmp_path / "f.csv").write_text(head + "tx_9,a,b,9,2024-01-01T00:00:09,x,0.1\n")
    rows = io.read_ledger(spark, f"{tmp_path}/m.csv", f"{tmp_path}/f.csv", limit=2)
    assert sorted(r.tx_id for r in rows.collect()) == ["tx_0", "tx_1", "tx_9"] and "embedding" not in rows.columns
    (tmp_path / "e.json").write_text('{"4": [{"source": "a", "target": "b", "weight": 2.0, "temporal_overlap": 1, "shared_devices": ["d"], "shared_payment_instruments": [], "shared_ips": [], "shared_merchants": []}]}')
    assert sorted((r.account_id, r.peer, r.community_id) for r in io.read_community_edges(spark, f"{tmp_path}/e.json").collect()) == [("a", "b", 4), ("b", "a", 4)]
    spark.createDataFrame([(1, True)], "community_id long, is_positive boolean").write.parquet(f"{tmp_path}/l")
    assert io.read_labels(spark, f"{tmp_path}/l").first().is_positive == 1
    with pytest.raises(ValueError):
        io.read_features(spark, f"{tmp_path}/l")


def test_queries_have_stable_names():
    import __spark_entry__ as entry
    from ringweave.plans import registry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 60
