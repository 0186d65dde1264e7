"""Near copies by shingle similarity against brute force."""

import random

import pytest

from ringweave.llm import simhash, simhash_texts


def shingles(text, width=5):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def classes(rows):
    sets, above = {k: shingles(t) for k, (_, t) in enumerate(rows)}, list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] == sets[b] or both * 5 >= union * 4:
                above[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, least[top(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))
    texts = [" ".join(word() for _ in range(rng.choice([3, 8, 40, 120, 400]))) for _ in range(40)]
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(25)]  # half of the text in common
    for t in texts[:30]:
        for _ in range(rng.randrange(4)):
            words = t.split()
            for _ in range(max(1, len(words) // rng.choice([25, 40, 60, 200]))):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    chain = [word() for _ in range(150)]
    for k in range(12):  # each is near the one before, the ends are far apart
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [texts[0], texts[1].upper(), texts[2].replace(" ", "\n"), "", None, "   ", "one two", "One  two"]
    order = rng.sample(range(1000), len(texts))
    return list(zip(order, texts))


@pytest.mark.parametrize("seed,shard", [(1, 2048), (2, 3)])
def test_against_brute_force(spark, seed, shard):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash_texts.similar_texts(docs, shard=shard).select("id", "component_id").collect()
    assert sorted(map(tuple, got)) == classes(rows)


def test_one_star_is_enough(spark, monkeypatch):
    """What the rounds of stars leave is found by trees alone."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash_texts, "SPREAD", 2)
    got = simhash_texts.similar_texts(docs, stars=1).select("id", "component_id").collect()
    assert sorted(map(tuple, got)) == classes(rows)


def test_edges(spark):
    schema = "doc_id long, text string, key string, whole string, fp string, root string"
    empty = spark.createDataFrame([], schema)
    assert simhash_texts.similar_texts(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, text, *"abcd"), (5, text, *"abcd"), (None, text, *"abcd"), (4, text + " end", *"abcd"), (None, None, *"abcd"), (6, "", *"abcd"), (7, "other words of a short text", *"abcd")]
    docs = spark.createDataFrame(rows, schema)
    near = simhash_texts.similar_texts(docs)
    assert sorted(((r.id, r.component_id) for r in near.collect()), key=str) == sorted([(5, 4), (5, 4), (None, 4), (4, 4), (None, 6), (6, 6), (7, 7)], key=str)
    kept = simhash.deduplicated(docs, near)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7] and kept.columns == docs.columns


def test_differences_lose_no_pair():
    """Similar texts that aren't both near their centre share one of the differences that are looked at."""

    rng, found = random.Random(7), 0
    for _ in range(300):
        centre = set(rng.sample(range(400), rng.randrange(20, 90)))
        texts = []
        for _ in range(12):
            s = {x for x in centre if rng.random() > rng.choice([0.02, 0.1, 0.2, 0.4])} | set(rng.sample(range(400), rng.randrange(25)))
            texts += [s, {x for x in s if rng.random() > 0.05} | set(rng.sample(range(400), rng.randrange(4)))]
        rows = []
        for s in texts:
            gained, lost = sorted(s - centre), sorted(centre - s)
            near = 5 * len(s & centre) >= 4 * len(s | centre)
            head, most = simhash_texts.prefixes(len(gained) + len(lost), len(s), len(centre), near, 0.8)
            rows.append((s, near, gained + lost, head, most))
        for i, x in enumerate(rows):
            for y in rows[:i]:
                if 5 * len(x[0] & y[0]) < 4 * len(x[0] | y[0]) or x[1] and y[1] or not x[0]:
                    continue
                small, large = (x, y) if len(x[2]) < len(y[2]) else (y, x)
                assert {*small[2][: small[3]]} & {*large[2][: large[4]]}
                if len(x[2]) == len(y[2]):  # either may be taken as the one with fewer
                    assert {*large[2][: large[3]]} & {*small[2][: small[4]]}
                found += 1
    assert found > 1000
