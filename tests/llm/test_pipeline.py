"""The pipeline's stages on small tables: what goes, what stays, what is changed."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringweave.llm import common, decontaminate, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(5)
    good = {i: words(rng, 120) for i in range(150)}
    bad = {200 + i: " ".join(w.upper() + "!!" for w in words(rng, 90).split()) for i in range(50)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in {**good, **bad}.items()]
    item = words(rng, 25)
    rows += [(300, good[3], "en", "s0", 1), (301, good[3], None, None, None), (3, good[3], "en", "s0", 1)]  # copies, and a repeated row
    rows += [(310, words(rng, 50) + ". " + item + ". " + words(rng, 50), "en", "s1", 1)]
    rows += [(320 + i, words(rng, 60) + f' token = "{rng.getrandbits(160):040x}" ' + words(rng, 60), "en", "s2", 1) for i in range(6)]
    rows += [(330, None, None, None, None), (331, "", "en", "s0", 0), (None, words(rng, 70), "en", "s1", 5)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*good, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs, seen = common.table(spark, corpus, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, corpus), name)
        seen[name] = docs
        if name != "mix_sources":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    ids = {n: sorted((r[0] for r in d.select("doc_id").collect()), key=str) for n, d in seen.items()}
    assert not {*ids["quality"]} & {*range(200, 250)} and {*range(150)} <= {*ids["quality"]}
    assert ids["near_duplicates"].count(3) == 1 and not {300, 301, 331} - {331} & {*ids["near_duplicates"]}
    assert {*range(150), None} <= {*ids["near_duplicates"]}
    assert {*ids["near_duplicates"]} - {*ids["decontamination"]} == {310}
    assert ids["secrets"] == ids["decontamination"] == ids["mix_sources"]
    kept = {r.doc_id: r for r in seen["secrets"].collect()}
    assert all("[SECRET]" in kept[320 + i].text and kept[320 + i].n_chars == len(kept[320 + i].text) for i in range(6))
    assert sum("[SECRET]" in (r.text or "") for r in kept.values()) == 6
    mixed = seen["mix_sources"].collect()
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)


def test_run_and_empty(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 150
    for t in ("documents", "benchmark", "labels"):
        common.table(spark, corpus, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns(spark, corpus):
    docs = common.table(spark, corpus, "documents").withColumns({c: F.lit("x") for c in ("id", "key", "score", "label", "size", "value", "name", "at", "fp", "words", "item_id", "root", "_id", "_key", "_values", "_text_key", "row", "stays", "of", "named", "found")})
    assert decontaminate.without(docs, decontaminate.contaminated(docs, common.table(spark, corpus, "benchmark"))).columns == docs.columns
    assert secrets.redacted(docs, secrets.scan(docs)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() > 0
