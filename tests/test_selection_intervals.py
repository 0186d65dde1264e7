"""Exact medians and the binned interval join against plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.operators import evidence, intervals, selection


def rows_of(rng):
    rows = [("hot", rng.gauss(0, 1)) for _ in range(20_001)] + [("ties", float(rng.randrange(3))) for _ in range(3000)]
    rows += [("even", float(k)) for k in range(4000)] + [("two", 1.0), ("two", 4.0), ("one", 7.5), ("same", 2.0), ("same", 2.0), ("none", None), ("some", None), ("some", 3.0), (None, 1.0)]
    rows += [("far", 10.0**rng.randrange(-200, 200)) for _ in range(2000)] + [("gap", 0.0)] * 500 + [("gap", 9.0)] * 500
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_medians(spark, few):
    df = spark.createDataFrame(rows_of(random.Random(1)), "k string, v double").repartition(9)
    want = {r.k: r.m for r in df.filter("v IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r.k: r.median for r in selection.medians(df, "k", "v", few_keys=few).collect()}
    assert got == want
    assert {r.k: r.median for r in selection.ranked_medians(df.filter("v IS NOT NULL AND k IS NOT NULL"), "k", "v").collect()} == want


@pytest.mark.parametrize("few", [0, 3000])
def test_medians_of_small_and_large_keys(spark, few):
    """Keys up to `few` values are ranked, the others found by their ranges."""
    df = spark.createDataFrame(rows_of(random.Random(2)), "k string, v double").repartition(5)
    want = {r.k: r.m for r in df.filter("v IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.median for r in selection.medians(df, "k", "v", few=few).collect()} == want
    assert {r.k: r.median for r in selection.medians(df, "k", "v", around=-0.3, few=few).collect()} == want


def test_small_keys_need_no_sketch(spark):
    df = spark.range(1000).selectExpr("id % 50 AS k", "double(id) AS v")
    assert "percentile_approx" not in selection.medians(df, "k", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert selection.medians(df, "k", "v").filter("median <> k + 475").isEmpty()


def test_medians_whose_range_misses(spark):
    """A range that can't hold the middle is noticed, and its key ranked in whole."""
    df = spark.createDataFrame([("a", float(k)) for k in range(1000)] + [("b", 5.0)], "k string, v double")
    assert {r.k: r.median for r in selection.medians(df, "k", "v", around=-0.3).collect()} == {"a": 499.5, "b": 5.0}


def test_only_the_middle_is_ranked(spark):
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.xxhash64("id").cast("double").alias("v")).cache()
    low, high = df.agg(F.percentile_approx("v", F.array(F.lit(0.5 - selection.AROUND), F.lit(0.5 + selection.AROUND)), selection.ACCURACY)).first()[0]
    assert df.filter(F.col("v").between(low, high)).count() < 1000
    assert selection.medians(df, "k", "v").first().median == df.agg(F.median("v")).first()[0]


def at(x):
    return F.timestamp_micros((F.lit(1_700_000_000_000_000) + x).cast("long"))


def test_intervals(spark):
    rng = random.Random(2)
    spans = [0, 1, 999_999, 10**6, 3_600_000_000, 86_400_000_000, 40 * 86_400_000_000]
    windows = [(k, rng.choice(["a", "b", "c"]), s := rng.randrange(-(10**11), 10**12), s + rng.choice(spans) + rng.randrange(2)) for k in range(400)] + [(900, "a", 50, 10), (901, None, 0, 10)]
    events = [(f"t{k}", rng.choice(["a", "b", "d"]), rng.randrange(-(10**11), 10**12)) for k in range(1500)] + [(f"e{k}", w[1], w[2 + k % 2]) for k, w in enumerate(windows[:200])] + [("n", None, 5)]
    w = spark.createDataFrame(windows, "id long, key string, a long, b long").select("id", "key", at(F.col("a")).alias("from"), at(F.col("b")).alias("to"))
    e = spark.createDataFrame(events, "event string, key string, t long").select("event", "key", at(F.col("t")).alias("when"))
    got = sorted((r.id, r.event) for r in intervals.within(w, e, "key", ("from", "to"), "when").collect())
    assert got == sorted((i, x) for i, k, a, b in windows for x, q, t in events if k == q and k is not None and a <= t <= b)
    assert intervals.within(w.limit(0), e, "key", ("from", "to"), "when").count() == 0


def test_a_thousand_windows_of_one_entity(spark):
    """Events meet the windows of their bins, not all windows of their entity."""
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200)
    items = spark.range(1000).select(
        F.lit("COMMUNITY").alias("entity_type"), F.lit("7").alias("entity_id"), F.concat(F.lit("ev_"), "id").alias("evidence_id"), F.array().cast("array<string>").alias("supporting_entities"), start.alias("observed_at"),
        F.create_map(F.lit("end"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200 + 3600), "yyyy-MM-dd HH:mm:ss")).alias("metrics"),
    )
    moves = spark.range(12_000).select(F.lit("7").alias("entity_id"), F.concat(F.lit("tx_"), "id").alias("transaction_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("timestamp"))
    found = evidence.matches(items, moves)
    assert found.count() == 7000 and found.groupBy("evidence_id").count().agg(F.min("count")).first()[0] == 7
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bin#" in plan.split("SortMergeJoin")[1].split("\n")[0]
