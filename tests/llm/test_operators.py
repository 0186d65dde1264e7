"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringweave.llm import ann, chat, decontaminate, langid, mixing, quality, secrets, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = words(rng, 60)
    out = [(i, words(rng, rng.choice([1, 5, 19, 20, 21, 90, 300]))) for i in range(60)]
    out += [(100 + i, words(rng, 30) + "\n" + passage + "\t" + words(rng, rng.randrange(40))) for i in range(8)]
    whole = words(rng, 200)
    out += [(200 + i, whole) for i in range(6)] + [(200, whole)]  # copies, one of them a repeated row
    out += [(300, None), (301, ""), (302, " \n\t "), (303, None), (None, words(rng, 40)), (None, passage)]
    out += [(310, "same " * 70), (311, "same " * 45), (312, "a b " * 40), (313, "b a " * 33), (7, words(rng, 25) + " " + passage), (320, words(rng, 30000))]
    out += [(330, "été " * 25 + "\x1c x y " * 20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    sources = ["a", "b", None, "c", "ä"]
    rows = [(i, t, ["en", "de", None][k % 3], sources[k % 5], 1, 0.5, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 -----------------------------------------------------------------------------


def test_mix(docs, empty):
    m = mixing.mix(docs)
    rows = m.documents.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(next(iter(v)).target for v in by.values()) - 1.5 * total) < 1e-6
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].source_size == sum(r.size for r in own) and own[0].target <= 2 * own[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).documents.collect()))
    parts = m.pieces.collect()
    assert sum(p.to_word - p.from_word for p in parts) == sum(r.taken for r in rows)
    assert mixing.mixed(empty).count() == 0


def test_mix_follows_weights(spark):
    rows = [(i, "x " * 10, s) for i, s in enumerate("aaaabbbbcccc" * 20)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.4)
    got = {r.source: r.target for r in m.sources.collect()}
    assert got["a"] == pytest.approx(960 * 5 / 8) and got["b"] == pytest.approx(960 * 2 / 8)
    order = [r.source for r in m.pieces.orderBy("slot").collect()]
    half = order[: len(order) // 2]  # any stretch of the schedule has the sources in proportion
    assert abs(half.count("a") / len(half) - 5 / 8) < 0.1


# 2, 5, 6 ------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, words(rng, 80) if i % 3 else "".join(f"{w.upper()}!! " for w in words(rng, 80).split()), int(i % 3 > 0)) for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(data.filter("doc_id < 300"))
    got = quality.score(data.filter("doc_id >= 300").select("doc_id", "label", "text"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in got]) > 0.98
    odd = {r.text: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert odd[None] == odd[""] == model[2] and all(0 <= s <= 1 for s in odd.values())
    none = quality.learn(empty.withColumn("label", F.lit(1)))
    assert {r.score for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {1.0}
    assert quality.score(empty.select("doc_id", "text"), model).count() == 0


def test_quality_mean_is_the_learned_vectors():
    data = np.frombuffer(b"one two one", np.uint8)
    found = quality.features(data, np.array([0, 11]))
    assert [len(f) for f, _ in found] == [3, 9, 8]
    two = quality.features(np.frombuffer(b"one twoone two", np.uint8), np.array([0, 7, 14]))
    for f, s in two:
        assert sorted(f[s[0] : s[1]]) == sorted(f[s[1] : s[2]])


def test_toxicity(spark, docs):
    rng = random.Random(2)
    bad = ["grobnak", "zulfwex"]
    rows = []
    for i in range(600):
        own = words(rng, 60).replace("w", "th").split()
        if i % 4 == 0:
            own[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "o", "ish", "en"])
        rows.append((str(i).zfill(4), " ".join(own), i % 4 == 0, i % 5 > 0))
    data = spark.createDataFrame(rows, "place string, text string, toxic boolean, counted boolean")
    scorer = toxicity.Scorer(data.filter("place < '0500'"))
    got = scorer.score(data.filter("place >= '0500'").select("toxic", "text")).collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in got]) > 0.95
    odd = scorer.score(docs.select("doc_id", "text")).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    one = toxicity.Scorer(data.filter("NOT toxic")).score(docs.select("doc_id", "text")).collect()
    assert {r.score for r in one} == {0.0}
    # a model too large to be sent is joined, with the same scores
    far = toxicity.Scorer(data.filter("place < '0500'"), known=0)
    assert scorer.sent is not None and far.sent is None
    score = lambda by, rows: sorted((repr(r[:-1]), r.score) for r in by.score(rows).collect())
    for rows in (data.filter("place >= '0500'").select("place", "toxic", F.lit(1).alias("mean"), "text"), docs.select("doc_id", "text"), docs.filter("text IS NULL").select("doc_id", "text")):
        near, joined = score(scorer, rows), score(far, rows)
        assert [r[0] for r in near] == [r[0] for r in joined] and np.allclose([r[1] for r in near], [r[1] for r in joined], atol=1e-5)


def test_toxicity_model_is_a_distribution(spark):
    rows = [("ab abc abd", True), ("abc ac b", False), ("bca", False), ("cab a", True)]
    model, shared = toxicity.tables(spark.createDataFrame(rows, "text string, toxic boolean"))
    total = np.zeros(2)
    for last in range(256):
        data = np.array([97, 98, 32, 97, last], np.uint8)
        key = sum(int(b) << 8 * (4 - k) for k, b in enumerate(data))
        key = np.array([key], np.uint64)
        total += toxicity.chances(key, shared, toxicity.looked_up(key, *toxicity.gathered(model)))[0]
    assert np.allclose(total, 1, atol=1e-3)


def test_language(spark, docs, empty):
    en, de = "the quick brown fox and the lazy dog that was there", "der schnelle braune fuchs und der faule hund war nicht dort"
    rng = random.Random(5)
    mixed = lambda base: " ".join(rng.sample(base.split(), 7))
    rows = [(i, mixed(en if i % 2 else de), "en" if i % 2 else "de") for i in range(80)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(data)
    got = langid.predict(data.select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    # brute force: n-grams of words with their edges marked
    def grams(text):
        out = []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f" {w} "
            out += [*w] + [p[k : k + 2] for k in range(len(p) - 1)] + [p[k : k + 3] for k in range(len(p) - 2)]
        return out

    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    text = "Das ist 3x ein\nkleiner Test, der Fuchs!"
    data_, at = np.frombuffer(text.lower().encode(), np.uint8), np.array([0, len(text.encode())])
    found, _ = langid.ngrams(data_, at)
    assert sorted(np.concatenate(found).tolist()) == sorted(key(g) for g in grams(text))
    odd = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    assert odd[300].lang_pred == odd[301].lang_pred == odd[302].lang_pred == "und" and odd[300].score == 0
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), langid.learn(empty)).collect()} == {"und"}


def test_language_distances(spark):
    rng = random.Random(12)
    rows = [(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(60)), lang) for lang, letters in (("aa", "abcde"), ("bb", "abcfg"), ("cc", "hij")) for _ in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"), size=40)
    languages, grams, begins, owners, ranks = model
    profiles = {name: {} for name in languages}
    for k, g in enumerate(grams.tolist()):
        for e in range(begins[k], begins[k + 1]):
            profiles[languages[owners[e]]][g] = int(ranks[e])
    assert languages == ["aa", "bb", "cc"] and all(sorted(p.values()) == list(range(40)) for p in profiles.values())
    for text, lang in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        found, _ = langid.ngrams(data, np.array([0, len(data)]))
        own = langid.own_profile(np.concatenate(found))
        want = [sum(abs(p[g] - k) if g in p else 40 for k, g in enumerate(own.tolist())) for p in (profiles[x] for x in languages)]
        assert langid.distances(own, model, 40).tolist() == want and languages[int(np.argmin(want))] == lang


def test_quality_scores_against_brute_force():
    rng = np.random.default_rng(4)
    odds = rng.normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["one two", "", "été  x", "a", "long " * 200]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = quality.scores(data, offsets, (odds, 0.25, 0.4))
    for k, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        found = np.concatenate([f for f, _ in quality.features(own, np.array([0, len(own)]))]) if t else []
        want = 1 / (1 + np.exp(-(np.mean(odds[found].astype(float)) + 0.25))) if len(found) else 0.4
        assert abs(got[k] - want) < 1e-6


def test_toxicity_with_repeated_labels_and_no_rows(spark, tmp_path):
    for name, docs, labels in (("some", [(i, f"text {i % 7} grob" if i % 3 else "plain words") for i in range(60)], [(i % 60, i % 2, i % 3 % 2) for i in range(120)]), ("none", [], [])):
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for op in (toxicity, quality):
            rows = op.query(spark, f"{tmp_path}/{name}").collect()
            assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)


# 3 -----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l \\b\\", "<|im_end|>\n", "<|im_start|>user\nx", "<<<SYS>> <s>", "a\nb", "", None, "<", "[INST", "<|im_sep|>", "é\U0001f600"]
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice(odd)))
    rows += [(None, 1, "user", "x"), (40, None, "assistant", "late"), (40, 1, "assistant", "a"), (40, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is None, t or 0, role or "", text or ""))
    for c, own in groups.items():
        own.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [x[2:] for x in own], c
        assert back[c].loss_text == "".join(x[3] for x in own if x[2] == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


# 4 -----------------------------------------------------------------------------


def simhash_of(text, width=3):
    own = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + width]) for i in range(len(own) - width + 1)] if len(own) >= width else [" ".join(own)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints, radius=3):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("shard", [simhash.SHARD, 2])
def test_simhash(docs, texts, shard):
    rows = simhash.near_duplicates(docs, shard=shard).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert any(i == r.id and simhash_of(t) == r.fp % (1 << 64) for i, t in texts)
    prints = [simhash_of(t) for _, t in texts]
    root = components_of(prints)
    least = defaultdict(lambda: None)
    for (i, _), c in zip(texts, root):
        least[c] = i if least[c] is None else least[c] if i is None else min(least[c], i)
    want = sorted((str(i), str(least[c])) for (i, _), c in zip(texts, root))
    assert sorted((str(r.id), str(r.component_id)) for r in rows) == want
    kept = simhash.deduplicated(docs, simhash.near_duplicates(docs, shard=shard)).collect()
    assert len(kept) == len(set(root))


@pytest.mark.parametrize("shard", [simhash.SHARD, 3])
def test_links_and_chains(spark, shard):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:
        for _ in range(12):  # chains of steps of up to three bits
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                b ^= 1 << bit
            prints.add(b)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    reach = {r.node: r.root for r in simhash.components(simhash.links(df, shard=shard)).collect()}
    want = components_of(prints)
    got = [reach.get(signed(p), signed(p)) for p in prints]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got))


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


# 7 -----------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    item = "Tom Baker buys 12 apples for 3 dollars and then Tom Baker sells 4 apples to his friend in the market"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three"), (5, "we know Anna runs 7 km each morning")], "item_id long, text string")
    other = item.replace("Baker", "Smith").replace("12", "15").replace("4", "9")
    broken = "so Tom Baker buys 12 apples for 3 dollars and then Ann Miller sells 4 apples to his friend in the market"
    rows = [(1, "Text before. " + item + " and after"), (2, "well " + other + "."), (3, broken), (4, "nothing here " * 30), (5, None), (6, "Say we know Lena runs 9 km each morning again"), (7, item), (7, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    hits = {(r.id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(hits) == {(1, 1), (2, 1), (6, 5), (7, 1)}
    assert hits[1, 1].exact and hits[7, 1].exact and not hits[2, 1].exact and not hits[6, 5].exact
    left = decontaminate.without(df, decontaminate.contaminated(df, bench))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == df.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0


# 8 -----------------------------------------------------------------------------


def repeats_by_force(texts, n=20):
    tokens = [(-(1 << 63) if i is None else i, WORD.findall(t or "")) for i, t in texts]
    first = {}
    for i, own in tokens:
        for p in range(len(own) - n + 1):
            k = tuple(own[p : p + n])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, own in tokens:
        gone = set()
        for p in range(len(own) - n + 1):
            if first[tuple(own[p : p + n])] < (i, p):
                gone |= set(range(p, p + n))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((str(None if i == -(1 << 63) else i), len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_force(texts)


def test_substrings_short_alphabet(spark, tmp_path):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("ab" if i % 2 else "abc") for _ in range(rng.randrange(0, 120)))) for i in range(40)] + [(50, "x " * 500), (51, "x " * 30 + "y " + "x " * 40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_force(texts)


def test_substrings_with_words_that_fool_polynomials(spark, tmp_path):
    """Thue-Morse words and their complements have equal polynomial hashes for any odd base."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    around = " ".join(f"w{k}" for k in range(10))
    alike = [f"{around} {w} {around}" for w in (one, two)]
    words = [" ".join(letters[b] for b in bits) for letters in ("ab", "ba")]  # the same as sequences of words
    texts = list(enumerate([*alike, *words]))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_force(texts)
    assert {r.doc_id: r.n_removed for r in got}[1] == 0


def test_substrings_of_rows_that_share_an_id(spark, tmp_path):
    """5 000 rows without an id and as many of one id, some of equal words in other white space: what is written grows with the rows."""
    rng = random.Random(12)
    shared = [words(rng, 30, 9000) for _ in range(5)]
    texts = [(i, rng.choice(shared) + f" t{k} " + words(rng, 12, 9000)) for i in (None, 5) for k in range(5000)]
    texts += [(None, texts[0][1].replace(" ", "\n")), texts[1], (7, texts[6000][1]), (4, texts[6001][1])]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_force(texts)


def test_twins_are_numbered_by_parts(spark):
    texts = spark.range(20000).select(F.lit(1).cast("long").alias("id"), F.xxhash64("id").alias("t"), F.col("id").alias("one")).union(spark.range(9).selectExpr("id + 2", "id", "id"))
    got = substrings.numbered(texts.union(texts)).collect()
    assert sorted((r.id, r.twin) for r in got) == [(1, k) for k in range(20000)] + [(k + 2, 0) for k in range(9)]


def test_substrings_empty(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert substrings.query(spark, str(tmp_path)).count() == 0


# 9 -----------------------------------------------------------------------------


def test_secret_candidates(spark):
    rows = [
        (1, '{"api_key":"sk-abcdefghij0123456789","x":1}', {"sk-abcdefghij0123456789"}),
        (2, "see postgres://user:S3cretPassw0rd99x@db.host/x", {"S3cretPassw0rd99x"}),
        (3, "https://h.io/x?api_key=abcd1234abcd1234abcd&y=2", {"abcd1234abcd1234abcd"}),
        (4, "key1=aaaabbbb11112222;key2=ccccdddd33334444", {"aaaabbbb11112222", "ccccdddd33334444"}),
        (5, "password=Ab1!cdEf2$ghIj3klmnop.", {"Ab1!cdEf2$ghIj3klmnop"}),
        (6, "password: hunter22x and more", {"hunter22x"}),
        (7, "the year 2024 and room12345 of it", set()),
        (8, None, set()),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = defaultdict(set)
    for r in secrets.candidates(df).collect():
        found[r.id].add(r.value)
    for i, _, want in rows:
        assert want <= found[i] and (want or not found[i]), (i, found[i])


def test_secrets(spark, docs, empty):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        own = words(rng, 30).split()
        if i % 3 == 0:
            s = hexes(40)
            own.insert(9, f'token = "{s}"' if i % 2 else f"password={s}")
            want[i] = s
        elif i % 3 == 1:
            own.insert(5, rng.choice(["4785380592391139", f"ann.{i}@mail7.example.com", "https://example.com/a/very/long/path1"]))
        rows.append((i, " ".join(own)))
    rows += [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit(1))
    found = secrets.scan(df)
    assert {r.id: r.value for r in found.collect()} == want
    clean = {r.doc_id: r.text for r in secrets.redacted(df, found).collect()}
    assert len(clean) == len(rows) and clean[500] is None
    for i, t in rows:
        assert clean[i] == (t.replace(want[i], "[SECRET]") if i in want else t)
    assert secrets.scan(empty).count() == 0
    assert secrets.scan(docs).count() == 0


# 10 ----------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    v = (centers[rng.integers(40, size=4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    v[1000:1500] = v[7]  # a large group of equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist())]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [1.0] * 3), (9500, [float("inf")] + [1.0] * 15), (9600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 100 == 0, part=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w, hit = v.astype(float), 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        d[q] = np.inf
        best = sorted(zip(d.tolist(), range(4000)))[:10]
        hit += len({i for _, i in best} & {i for i, _ in got[q]})
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0])) and len(got[q]) == 10
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert hit / 400 >= 0.9 and set(got) == set(range(0, 4000, 100))
    few = ann.nearest(df.filter("vec_id < 4"), F.col("id") == 0).collect()
    assert [r.rank for r in sorted(few)] == [1, 2, 3]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_nearest_with_hundreds_of_lists(spark):
    v = np.random.default_rng(5).normal(size=(4000, 32))
    v = (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)  # distances hardly differ
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 100 == 0, per_list=10, part=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    w = v.astype(float)
    for q in range(0, 4000, 100):
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == np.argsort(d, kind="stable")[:10].tolist()


def test_nearest_far_from_the_origin(spark):
    v = 1e7 + np.random.default_rng(8).normal(size=(600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "vec", "list", "score", "rank")})
    for r in ann.nearest(df, F.col("id") % 100 == 0).filter("rank = 10").collect():
        d = np.sqrt(((v - v[r.query_id]) ** 2).sum(1))
        assert r.vec_id == np.argsort(d, kind="stable")[10] and r.score == pytest.approx(np.sort(d)[10])


def test_nearest_on_centroids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 10 == 0, per_list=1).orderBy("query_id", "rank").collect():  # each vector is a centroid
        got[r.query_id].append(r.vec_id)
    for q in range(0, 40, 10):
        assert got[q] == sorted((i for i in range(40) if i != q), key=lambda i: (abs(i - q), i))[:10]


def test_decontamination_verbatim_against_brute_force(spark):
    """Every item that a text holds word for word is found, in any capitals, whatever the item is made of."""
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "Ann", "Bob", "12", "7", "km", "market", "seven", "Paris", "runs"])
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 6, 8, 12, 25])))) for i in range(30)] + [(90, "12 + 7 = 19 ; 3 * 4 = 12 ; 5 - 1 = 4 ; 8 / 2 = 4")]
    rows = []
    for k, (i, text) in enumerate(items):
        text = [text, text.lower(), text.upper()][k % 3]
        rows.append((100 + i, " ".join(f"w{rng.randrange(999)}x" for _ in range(9)) + " " + text + " " + " ".join(f"w{rng.randrange(999)}x" for _ in range(9))))
    hits = {(r.id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    tokens = lambda t: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
    held = {(d, i) for d, t in rows for i, x in items if tokens(x) in tokens(t)}
    assert held <= hits and len(held) >= 31


def test_decontamination_despite_one_conflict(spark):
    item = "the baker sells 5 loaves of dark bread every morning and keeps some of the rest for the evening when 5 friends come over to eat with the whole family"
    two = "the baker sells 5 loaves of dark bread every morning and keeps some of the rest for the evening when 7 friends come over to eat with the whole family"
    bench = spark.createDataFrame([(1, item), (2, two.replace("baker", "tailor").replace("bread", "cloth"))], "item_id long, text string")
    copies = [(10, item.replace("when 5", "when 6")), (12, item.replace("baker", "tailor").replace("bread", "cloth")), (13, "nothing of it here at all"), (14, item)]
    hits = decontaminate.contaminated(spark.createDataFrame(copies, "doc_id long, text string"), bench).collect()
    exact = {(r.id, r.item_id): r.exact for r in hits}
    assert {(10, 1), (12, 2), (14, 1)} <= set(exact) and 13 not in {i for i, _ in exact}
    assert exact[14, 1] and not exact[10, 1] and not exact[12, 2]
