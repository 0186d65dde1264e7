"""Periodic runs against brute force: whole query, tiles and fragments on their own, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ringweave.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """(start, period, length) of all runs, from the definition."""
    number: dict = {}
    x = np.array([number.setdefault(v, len(number)) for v in w], np.int64)
    found: dict = {}
    for q in range(1, len(w) // 4 + 1):
        step = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if j - i + q >= max(6, 4 * q):
                found.setdefault((int(i), int(j - i + q)), q)
    return sorted((s, q, n) for (s, n), q in found.items())


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = np.zeros(n, bool)
    for s, q, size in runs:
        gone[s + q : s + size] = True
    best = min(((-size, s, q) for s, q, size in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{size},{q}\n" for s, q, size in runs)), sha(" ".join(v for v, k in zip(w, gone) if not k)))


def in_tiles(docs):
    """Runs by tiles and fragments, without Spark."""
    of, ids = np.cumsum([0, *map(len, docs)]), np.array([x for d in docs for x in d], np.int32)
    parts: list = [{} for _ in docs]
    for k, p, first, words, anchors in periodic.tiles(ids, of):
        for q, own in periodic.fragments(words.tolist(), anchors.tolist(), p).items():
            parts[k].setdefault(q, []).extend((first + a, first + b) for a, b in own)
    out = []
    for by in parts:
        found: dict = {}
        for q in sorted(by):
            joined: list = []
            for a, b in sorted(by[q]):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                if b - a + q >= max(6, 4 * q):
                    found.setdefault((int(a), int(b - a + q)), q)
        out.append(sorted((s, q, n) for (s, n), q in found.items()))
    return out


def some_words(rng):
    out: list = []
    for _ in range(rng.randrange(8)):
        if rng.random() < 0.4:
            out += [rng.randrange(3 if rng.random() < 0.5 else 500) for _ in range(rng.randrange(60))]
        else:
            unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40, 100]))]
            out += (unit * rng.randrange(2, 12))[: rng.randrange(1, len(unit) * 12)]
    return out


def test_tiles_find_all_runs():
    rng = random.Random(5)
    for _ in range(120):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        assert in_tiles(docs) == [brute_runs(d) for d in docs]


def test_runs_over_many_tiles():
    rng = random.Random(6)
    unit = [rng.randrange(10**6) for _ in range(700)]
    long = [*range(-50, 0), *(unit * 9)[:6000], *[7] * 5000, *range(-90, -50)]
    fibonacci, nxt = [0], [0, 1]
    while len(nxt) < 1500:
        fibonacci, nxt = nxt, nxt + fibonacci
    assert in_tiles([long, nxt]) == [brute_runs(long), brute_runs(nxt)]


def test_tiles_stay_few():
    """Words in tiles grow as n log n, even where every word is the same."""
    for n in (5000, 40000):
        ids = np.zeros(n, np.int32)
        assert sum(len(w) for _, _, _, w, _ in periodic.tiles(ids, np.array([0, n]))) < 2 * n * np.log2(n)


@pytest.mark.parametrize("text,words", [("a  b\n\tc\x0b\x0cd\re", 5), ("", 0), (" \n", 0), ("\x1cé x y", 1), ("x\x00y z", 2)])
def test_words(text, words):
    import pyarrow as pa

    ids, of = periodic.words_of(pa.array(["a b a", text, None, "b"]))
    assert of.tolist() == [0, 3, 3 + words, 3 + words, 4 + words]
    assert ids[0] == ids[2] != ids[1] == ids[-1]


def test_query(spark, tmp_path):
    rng = random.Random(7)
    mutated = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    some = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    rows = [(i, some(rng.choice([0, 1, 5, 6, 9, 200, 700]))) for i in range(40)]
    rows += [(i, some(rng.choice([1, 3, 7, 50, 900]))) for i in mutated[:40]] + [(mutated[41], None), (mutated[42], ""), (mutated[43], "same " * 90)]
    rows += [(5000 + k, " ".join(f"v{x}" for x in some_words(rng))) for k in range(60)]
    rows += [(6000, "a b " * 4000 + "c"), (6001, "ha " * 6), (6002, "ha " * 5), (6003, "x y z " * 4), (6004, "x y z " * 3 + "x y"), (6005, "é è\x1c " * 9)]
    rows += [(None, "no no no no no no yes"), (None, None), (7, "twice " * 8), (7, "twice " * 8), (7, "thrice " * 8), (6006, some(30000))]
    docs = spark.createDataFrame([(i, t, "x", "y", 0, "k") for i, t in rows], "doc_id long, text string, key string, words string, first long, id string").repartition(5)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = periodic.query(spark, f"file://{tmp_path}").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted((expected(i, t) for i, t in rows), key=order)


def test_empty_tables_and_other_ids(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert periodic.query(spark, f"file://{tmp_path}").count() == 0
    docs = spark.createDataFrame([("a", "x " * 7), ("", "x " * 7), (None, "y " * 3)], "name string, body string")
    cut = periodic.exploded(docs, id_col="name", text_col="body")
    found = {r.id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.collapsed(cut, periodic.stitched(periodic.solved(cut))).collect()}
    assert found == {"a": ("x", [(0, 1, 7)]), "": ("x", [(0, 1, 7)])}
