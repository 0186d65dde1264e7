"""Substring dedup by recompression: remove words under windows of n words that also start earlier.

Recompression names pairs of neighbouring symbols in rounds: each symbol falls
on the left or the right side by its name, and a left symbol joins a right one
that follows it. A pair's name is a hash of its two names, so it is the same
everywhere in the corpus without a table of names; runs of one symbol stay
apart, as equal symbols are on the same side. After two rounds a boundary
between symbols depends on four words around it, and symbols have four words at
most, so equal windows have equal interior boundaries. The name of the eight
words around a boundary is a high-level symbol; of those in the interior of a
window the smallest is the window's key.

Spark then counts keys (1), and for documents that hold a repeated key it names
the windows under it with all their words (2), finds where each first starts
(3) and removes the others' words (4). Keys only choose which windows are
compared: two equal windows always have the same key.

Defined results: a null text has no words; a document id that is null comes
before all others; rows with the same id and words are the same document, rows
with the same id and other words are compared by their start; copies of a whole
text are settled at once. Work is keyed by (id, text), so any number of rows may
share an id or have none. Windows are verified by names of 96 bits, made of two
independent hashes of each word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import forget, pieces, stored, utf8
from .words import U, Words, joined, mix, windows

WINDOW, AROUND = 20, 4
MOST = np.iinfo(np.uint64).max
PIECE = 1 << 20
PARTS = 4096
NONE = -(1 << 63)


def boundaries(names: np.ndarray, begins: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Positions of the words at which symbols start after some rounds of naming pairs. begins: words that start a text."""
    at = np.arange(len(names))
    for k in range(rounds):
        if len(at) < 2:
            break
        right = mix(names + U(k + 1)) >> U(63) == 1
        pair = np.zeros(len(at), bool)  # symbols that join the one before
        pair[1:] = right[1:] & ~right[:-1] & ~begins[at[1:]]
        named = names.copy()
        second = np.flatnonzero(pair)
        named[second - 1] = joined(names[second - 1], names[second])
        at, names = at[~pair], named[~pair]
    return at


def sliding(x: np.ndarray, n: int, least=np.minimum) -> np.ndarray:
    """The least (or most) of each n consecutive values."""
    have, out = 1, x
    while have * 2 <= n:
        out, have = least(out[:-have], out[have:]), have * 2
    return least(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1]) if have < n else out


class Keys:
    """The keys of all windows of some texts. value: by word, its high-level symbol if it is a boundary, else MOST; least: by window, its key; inside: windows that lie in one text."""

    def __init__(self, words: Words, window: int = WINDOW, around: int = AROUND):
        n = len(words.hash)
        self.value, self.least, self.inside = np.full(n, MOST, U), np.zeros(0, U), np.zeros(0, bool)
        self.range = window - 2 * around + 1
        if n < window:
            return
        begins = np.zeros(n + 1, bool)
        begins[words.of] = True
        at = boundaries(words.hash, begins[:n])
        at = at[(at >= around) & (at <= n - around)]
        self.value[at] = np.minimum(words.windows(2 * around)[at - around], MOST - U(1))
        self.least = sliding(self.value[around : n - around + 1] if around else self.value, self.range)
        count = np.cumsum(begins[:n])
        self.inside = count[: n - window + 1] == count[window - 1 :]

    def chosen(self) -> np.ndarray:
        """Words at which the key of some window stands."""
        n, r = len(self.value), self.range
        if not len(self.least):
            return np.zeros(0, np.int64)
        around = (n - len(self.least) - r + 2) // 2
        most = np.zeros(len(self.least) + 2 * (r - 1), U)
        most[r - 1 : r - 1 + len(self.least)] = np.where(self.inside, self.least, 0)
        best = sliding(most, r, np.maximum)
        here = self.value[around : around + len(best)]
        return np.flatnonzero((here == best[: len(here)]) & (here != MOST)) + around

    def repeated(self, marked: np.ndarray) -> np.ndarray:
        """Windows whose key stands at a marked word."""
        n, around = len(self.value), 0
        if not len(self.least):
            return np.zeros(0, np.int64)
        around = (n - len(self.least) - self.range + 2) // 2
        value = np.where(marked, self.value, MOST)
        return np.flatnonzero((sliding(value[around : n - around + 1], self.range) == self.least) & self.inside & (self.least != MOST))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batches):
    """Some texts' ids, buffer, words and row numbers in their batch, a piece at a time."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column("text"))
        for a, b in pieces(offsets, PIECE):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield batch, ids[a:b], part, at, Words(part, at), range(a, b)


def _whole(batches):
    for batch, ids, data, at, words, rows in _texts(batches):
        one, two, t = words.texts(), words.texts(1), batch.column("t").slice(rows.start, len(rows))
        sha = [hashlib.sha256(b" ".join(data[at[k] : at[k + 1]].tobytes().split())).hexdigest() for k in range(len(ids))]
        yield pa.RecordBatch.from_arrays([pa.array(ids), t, _signed(one), _signed(two), pa.array(np.diff(words.of)), pa.array(sha)], ["id", "t", "one", "two", "n_words", "sha"])


def _anchors(batches):
    for _, ids, _, _, words, _ in _texts(batches):
        keys = Keys(words)
        at = keys.chosen()
        text = np.searchsorted(words.of, at, "right") - 1
        yield pa.RecordBatch.from_arrays([_signed(keys.value[at]), pa.array(ids[text]), _signed(words.texts()[text]), pa.array((at - words.of[text]).astype(np.int32))], ["key", "id", "one", "at"])


def _own(batch, words, rows):
    """Of each row that was marked for its own words: its place among the texts, and its row. A hash of the text brought the rows together, the words decide."""
    one, expected = words.texts().view(np.int64), batch.column("one").to_numpy(zero_copy_only=False)[rows.start : rows.stop]
    return [(k, rows[k]) for k in np.flatnonzero(one == expected).tolist()]


def _windows(batches):
    for batch, ids, _, _, words, rows in _texts(batches):
        marked, own = np.zeros(len(words.hash), bool), np.zeros(len(ids), bool)
        for k, row in _own(batch, words, rows):
            at = np.asarray(batch.column("marks")[row].values)
            own[k], marked[words.of[k] + at[at < words.of[k + 1] - words.of[k]]] = True, True
        at = Keys(words).repeated(marked)
        text = np.searchsorted(words.of, at, "right") - 1
        at, text = at[own[text]], text[own[text]]
        twins = batch.column("twin").to_numpy(zero_copy_only=False)[rows.start : rows.stop].astype(np.int32)
        name, proof = words.windows(WINDOW)[at], windows(words.hashed(1), WINDOW)[at]
        yield pa.RecordBatch.from_arrays([_signed(name), pa.array((proof >> U(32)).astype(np.uint32).view(np.int32)), pa.array(ids[text]), pa.array(twins[text]), pa.array((at - words.of[text]).astype(np.int32))], ["name", "proof", "id", "twin", "at"])


def _kept(batches):
    for batch, ids, data, at, words, rows in _texts(batches):
        one = words.texts().view(np.int64)
        out = {"id": [], "one": [], "removed": [], "kept": []}
        for k, row in _own(batch, words, rows):
            n = int(words.of[k + 1] - words.of[k])
            own = np.asarray(batch.column("starts")[row].values)
            gone = np.zeros(n + WINDOW + 1, np.int64)
            np.add.at(gone, own, 1)
            np.add.at(gone, own + WINDOW, -1)
            stays = np.cumsum(gone)[:n] == 0
            found = data[at[k] : at[k + 1]].tobytes().split()
            for name, x in zip(out, (ids[k], int(one[k]), int(n - stays.sum()), b" ".join([w for w, s in zip(found, stays.tolist()) if s]).decode())):
                out[name].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["one"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["kept"], pa.string())], list(out))


def numbered(texts: DataFrame) -> DataFrame:
    """id, t, one and twin: a text's number among those with its id, from 0. Parts by hash are counted first, so that no task numbers all texts of an id."""
    each = texts.select("id", "t", "one").distinct().withColumn("part", F.pmod("t", F.lit(PARTS)).cast("int"))
    before = each.groupBy("id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("id").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(W.partitionBy("id", "part").orderBy("t", "one")) - 1
    return each.withColumn("own", own).join(before.hint("merge"), ["id", "part"]).select("id", "t", "one", (F.col("before") + F.col("own")).cast("int").alias("twin"))


def repeats(docs: DataFrame, *, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(all, changed): id, one, n_words, sha, copy for each row; id, one, removed, kept (the words that stay) for each text that loses some but not all words."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    whole = stored(texts.mapInArrow(_whole, "id long, t long, one long, two long, n_words long, sha string"), "repeats-texts")
    first = whole.groupBy("one", "two").agg(F.min("id").alias("first"))
    every = whole.join(first.hint("merge"), ["one", "two"]).withColumn("copy", F.col("id") > F.col("first")).drop("first")
    # texts that come first; those that share an id are twins
    firsts = numbered(every.filter(~F.col("copy")))
    anchors = stored(texts.select("id", "text").mapInArrow(_anchors, "key long, id long, one long, at int"), "repeats-keys")
    place = F.xxhash64("one", "at")  # the same in all copies of a text
    again = anchors.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("key")
    marks = anchors.join(again.hint("merge"), "key").groupBy("id", "one").agg(F.collect_set("at").alias("marks"))
    marks = stored(marks.join(firsts.hint("merge"), ["id", "one"]), "repeats-marks")
    some = stored(texts.join(marks.hint("shuffle_hash"), ["id", "t"]), "repeats-some")
    forget(anchors, marks)
    named = stored(some.mapInArrow(_windows, "name long, proof int, id long, twin int, at int"), "repeats-windows")
    earliest = named.groupBy("name", "proof").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last")).filter("first < last").select("name", "proof", "first")
    later = named.join(earliest.hint("merge"), ["name", "proof"]).filter(F.struct("id", "at") > F.col("first"))
    starts = later.groupBy("id", "twin").agg(F.collect_set("at").alias("starts"))
    changed = some.select("id", "twin", "one", "text").join(starts.hint("shuffle_hash"), ["id", "twin"]).mapInArrow(_kept, "id long, one long, removed long, kept string")
    return every, changed


def query(spark, sf_dir: str) -> DataFrame:
    every, changed = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    changed = changed.groupBy("id", "one").agg(F.max("removed").alias("removed"), F.first(F.sha2("kept", 256)).alias("kept_sha"))
    all_gone = F.col("copy") & (F.col("n_words") >= WINDOW)
    return every.join(changed.hint("merge"), ["id", "one"], "left").select(
        F.when(F.col("id") != NONE, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).when(F.col("copy"), F.col("sha")).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k FROM i),
f AS (SELECT k, min((doc_id, p)) AS f FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(h.p, h.p + 20)) AS q FROM h JOIN f ON h.k = f.k WHERE (h.doc_id, h.p) > f.f),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM d),
y AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.q) AS t, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.q = c.q WHERE c.q IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(y.n, 0))::BIGINT AS n_removed, sha256(coalesce(y.t, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""
