"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled texts each get a byte n-gram model with interpolated
Kneser-Ney smoothing. Orders ORDER down to SHARED + 1 belong to the class; below
that both classes back off to the same continuation counts, so an expression that
neither has seen says nothing for either. Per text, the two log-likelihoods are
compared: over the whole text, normalised by its length, and over each
expression (a run of letters, with the space after it). A logistic curve over
the mean, the strongest expression and the mean of the three strongest gives the
score; it is fitted on a fold of the labelled texts that is not counted.

Counts cover all labelled texts of the counting folds and are made by Spark
from exact n-grams. The model is a table with a row for each n-gram, so it grows
with the corpus. Up to KNOWN rows it is broadcast; beyond, texts are dealt in
chunks, the chunks' distinct n-grams are joined to the table, and each chunk gets
the ratios of its own. Both ways give the same scores.

Defined results: a null or empty text has the ratio 0 everywhere and gets the
curve's value there; without labelled rows of both classes in both parts every
score is the share of toxic rows among the labelled, or 0 where there are none;
repeated rows count as often as they occur; of labels with the same id the largest
counts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import fold, forget, pieces, stored, utf8

U = np.uint64
ORDER, SHARED, DISCOUNT = 5, 2, 0.75
CALIBRATION, KNOWN = 20000, 1 << 22
PIECE = 1 << 20
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not (97 <= b <= 122 or 65 <= b <= 90)]] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes that end there, as a number; texts are preceded by spaces."""
    letters = _KEEP[data].astype(U)
    key = letters.copy()
    for k in range(1, ORDER):
        back = np.full(len(data), U(32))
        back[k:] = letters[:-k]
        for j in range(min(k, 8)):  # bytes before a text's start are spaces
            edge = offsets[:-1] + j
            back[edge[edge < offsets[1:]]] = U(32)
        key |= back << U(8 * k)
    return key


def mask(order: int) -> int:
    return (1 << 8 * order) - 1


def place(order: int, backoff: bool = False) -> int:
    """What is added to an n-gram of `order` bytes, or to the context of one, for its key in the model."""
    return (2 * order + backoff) << 8 * ORDER


#: For each order of the classes, how a gram of ORDER bytes is shifted and cut, and what is added, for the keys of its backoff weight and its probability.
SLOTS = [x for n in range(SHARED + 1, ORDER + 1) for x in ((8, mask(n - 1), place(n, True)), (0, mask(n), place(n)))]


def _count(batches):
    for batch in batches:
        data, offsets = utf8(pc.utf8_lower(batch.column("text")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        parts = []
        for a, b in pieces(offsets, PIECE):
            at = offsets[a : b + 1] - offsets[a]
            key = grams(data[offsets[a] : offsets[b]], at) << U(1) | np.repeat(toxic[a:b], np.diff(at)).astype(U)
            parts.append(np.unique(key, return_counts=True))
        if parts:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            hit = (keys & U(1)).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> U(1)).view(np.int64)), pa.array(np.where(hit, n, 0)), pa.array(np.where(hit, 0, n))], ["gram", "t", "o"])


def tables(labelled: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(model, shared) from rows (text, toxic): a stored table (key, t, o) of the classes' probabilities and backoff weights, and P(byte | byte before)."""
    counts = stored(labelled.mapInArrow(_count, "gram long, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), f"kn-{ORDER}")
    made, parts, low = [counts], [], {}
    for order in range(ORDER, 0, -1):
        context = F.shiftrightunsigned("gram", 8)
        if order > SHARED:
            sums = counts.groupBy(context.alias("context")).agg(*(f(c).alias(n + c) for c in "to" for n, f in (("c", F.sum), ("n", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
            part = counts.withColumn("context", context).join(sums.hint("shuffle_hash"), "context")
            alpha = (F.coalesce(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.nullif(F.col("c" + c), F.lit(0)), F.lit(0.0)).cast("float").alias(c) for c in "to")
            gamma = (F.coalesce(DISCOUNT * F.col("n" + c) / F.nullif(F.col("c" + c), F.lit(0)), F.lit(1.0)).cast("float").alias(c) for c in "to")
            parts += [part.select((F.col("gram") + place(order)).alias("key"), *alpha), sums.select((F.col("context") + place(order, True)).alias("key"), *gamma)]
        else:
            low[order] = counts.select("gram", (F.col("t") + F.col("o")).alias("n")).collect()  # 256 ** SHARED at most
        # continuation counts: how many bytes stand before the shorter n-gram
        keep = F.col("gram").bitwiseAND(mask(order - 1)).alias("gram")
        counts = counts.groupBy(keep).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in "to"))
        if order > 1:
            counts = stored(counts, f"kn-{order - 1}")
            made.append(counts)
    model = parts[0]
    for part in parts[1:]:
        model = model.union(part)
    model = stored(model, "kn-model")
    forget(*made)
    one = np.full(256, 1.0)
    for g, n in low[1]:
        one[g] += n
    one /= one.sum()
    two = np.zeros((256, 256))
    for g, n in low[2]:
        two[g >> 8, g & 255] = n
    total, kinds = two.sum(axis=1, keepdims=True), (two > 0).sum(axis=1, keepdims=True)
    two = np.where(total > 0, (np.maximum(two - DISCOUNT, 0) + DISCOUNT * kinds * one) / np.maximum(total, 1), one)
    return model, two.astype(np.float32).ravel()


def gathered(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The whole model as (keys in order, values): for models of KNOWN rows at most."""
    rows = model.toArrow()
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], np.stack([rows.column(c).to_numpy() for c in "to"], axis=1)[order]


def chances(gram: np.ndarray, shared: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """P(last byte | bytes before) for each gram under both classes. found: by slot, what the model holds for its keys, where it holds nothing (1, 1) for a weight and (0, 0) for a probability."""
    p = np.repeat(shared[(gram & U(mask(SHARED))).astype(np.int64)][:, None], 2, axis=1).astype(np.float64)
    for gamma, alpha in zip(found[::2], found[1::2]):
        p = p * gamma + alpha
    return p


def looked_up(gram: np.ndarray, keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    out = []
    for k, (shift, cut, add) in enumerate(SLOTS):
        key = ((gram >> U(shift)) & U(cut)).astype(np.int64) + add
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out.append(np.where((keys[at] == key)[:, None], values[at], 1 - k % 2))
    return out


def log_ratio(p: np.ndarray) -> np.ndarray:
    p = np.log(p)
    return p[:, 0] - p[:, 1]


def ratios(data: np.ndarray, offsets: np.ndarray, known) -> np.ndarray:
    """log P(byte | toxic) - log P(byte | ordinary) for each byte. known: the ratios of distinct grams."""
    distinct, at = np.unique(grams(data, offsets), return_inverse=True)
    return known(distinct)[at]


def strengths(data: np.ndarray, offsets: np.ndarray, known) -> np.ndarray:
    """By text: ratio per byte over the whole text, strongest expression, mean of the three strongest."""
    out = np.zeros((len(offsets) - 1, 3))
    for a, b in pieces(offsets, PIECE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            continue
        r = ratios(part, at, known)
        sums = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
        space = _KEEP[part] == 32
        last = space.copy()  # an expression ends with the space behind it, or with its text
        last[1:] &= ~space[:-1]
        last[at[1:][at[1:] > at[:-1]] - 1] = True
        end = np.flatnonzero(last) + 1
        begin = np.concatenate([[0], end[:-1]])
        value = sums[end] - sums[begin]
        of = np.searchsorted(end, at[1:], "right")
        of = np.concatenate([[0], of])
        for k in range(b - a):
            own = value[of[k] : of[k + 1]]
            if len(own):
                top = np.sort(own[np.argpartition(own, -3)[-3:]]) if len(own) > 3 else np.sort(own)
                out[a + k] = (sums[at[k + 1]] - sums[at[k]]) / (at[k + 1] - at[k]), top[-1], top.sum() / 3
    return out


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge, over bounded features."""
    x = np.hstack([squash(x), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.01 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def squash(x: np.ndarray) -> np.ndarray:
    return np.stack([np.clip(x[:, 0] * 20, -5, 5), np.clip(x[:, 1], -5, 25) / 5, np.clip(x[:, 2], -5, 25) / 5], axis=1)


def _measured(rows: pa.Array, texts: pa.Array, known) -> list[pa.Array]:
    got = strengths(*utf8(pc.utf8_lower(texts)), known)
    return [rows, *(pa.array(got[:, k]) for k in range(3))]


MEASURED = ["row", "mean", "most", "three"]


def _strengths(sent):
    def run(batches):
        keys, values, shared = sent.value
        for batch in batches:
            known = lambda gram: log_ratio(chances(gram, shared, looked_up(gram, keys, values)))
            yield pa.RecordBatch.from_arrays(_measured(batch.column("row"), batch.column("text"), known), MEASURED)

    return run


def _chunks(batches):
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for a, b in pieces(offsets, PIECE):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([uuid.uuid4().int >> 65] * (b - a))], [*part.schema.names, "chunk"])


def _distinct(batches):
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        data, offsets = utf8(pc.utf8_lower(batch.column("text")))
        for own in np.unique(chunk):
            rows = np.flatnonzero(chunk == own)
            found = [grams(data[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k]) for k in rows]
            found = np.unique(np.concatenate(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array(found)], ["chunk", "gram"])


def _chances(shared):
    def run(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            found = [np.stack([batch.column(f"{c}{k}").to_numpy() for c in "to"], axis=1) for k in range(len(SLOTS))]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(log_ratio(chances(gram.view(U), shared.value, found)))], ["gram", "ratio"])

    return run


def _by_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
    gram, ratio = right.column("gram").to_numpy().view(U), right.column("ratio").to_numpy()
    order = np.argsort(gram)
    gram, ratio = gram[order], ratio[order]
    return pa.Table.from_arrays(_measured(left.column("row"), left.column("text"), lambda found: ratio[np.searchsorted(gram, found)]), MEASURED)


def joined(rows: DataFrame, model: DataFrame, shared) -> DataFrame:
    """`rows` (row, text) measured without a broadcast of the model. A chunk has PIECE bytes, or one text; it is stored, so that its name stays."""
    measured = f"row {rows.schema['row'].dataType.simpleString()}, mean double, most double, three double"
    chunks = stored(rows.mapInArrow(_chunks, f"row {rows.schema['row'].dataType.simpleString()}, text string, chunk long"), "kn-chunks")
    pairs = stored(chunks.select("chunk", "text").mapInArrow(_distinct, "chunk long, gram long").distinct(), "kn-grams")
    keys = F.array(*(F.shiftrightunsigned("gram", shift).bitwiseAND(F.lit(cut)) + F.lit(add) for shift, cut, add in SLOTS))
    wanted = pairs.select("gram").distinct().select("gram", F.posexplode(keys).alias("slot", "key"))
    held = lambda c, k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col(c))), F.lit(1.0 - k % 2).cast("float")).alias(f"{c}{k}")
    found = wanted.join(model.hint("merge"), "key", "left").groupBy("gram").agg(*(held(c, k) for k in range(len(SLOTS)) for c in "to"))
    ratio = found.mapInArrow(_chances(shared), "gram long, ratio double")
    own = pairs.join(ratio.hint("merge"), "gram")
    return chunks.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_by_chunk, measured)


class Scorer:
    """Learned from rows (place, text, toxic, counted): counted rows make the models, the others the curve."""

    def __init__(self, labelled: DataFrame, calibration: int = CALIBRATION, known: int = KNOWN):
        rows = {(r[0], r[1]): r[2] for r in labelled.groupBy("counted", "toxic").count().collect()}
        n = sum(rows.values())
        self.curve, self.sent = None, None
        self.share = sum(v for k, v in rows.items() if k[1]) / n if n else 0.0
        if len(rows) < 4:
            return
        self.model, self.shared = tables(labelled.filter("counted").select("text", "toxic"))
        context = labelled.sparkSession.sparkContext
        if self.model.count() <= known:
            self.sent = context.broadcast((*gathered(self.model), self.shared))
        else:
            self.shared = context.broadcast(self.shared)  # 256 ** SHARED numbers
        held = labelled.filter("NOT counted")
        cut = held.select("place").orderBy("place").limit(calibration).agg(F.max("place")).first()[0]
        got = self.measure(held.filter(F.col("place") <= F.lit(cut)).select("place", "toxic", "text")).orderBy("row.place").limit(calibration).select("row.toxic", *MEASURED[1:]).collect()
        self.curve = [float(w) for w in curve(np.array([[r["mean"], r["most"], r["three"]] for r in got]), np.array([float(r["toxic"]) for r in got]))]

    def measure(self, rows: DataFrame) -> DataFrame:
        """(row, mean, most, three): the columns of `rows` but the last, which is the text, as a struct, and the text's measures."""
        packed = rows.select(F.struct(*rows.columns[:-1]).alias("row"), F.col(rows.columns[-1]).alias("text"))
        if self.sent is None:
            return joined(packed, self.model, self.shared)
        return packed.mapInArrow(_strengths(self.sent), f"row {packed.schema['row'].dataType.simpleString()}, mean double, most double, three double")

    def score(self, rows: DataFrame) -> DataFrame:
        if self.curve is None:
            return rows.drop(rows.columns[-1]).withColumn("score", F.lit(self.share))
        a, b, c, d = self.curve
        clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
        z = clip(F.col("mean") * 20, -5.0, 5.0) * a + clip(F.col("most"), -5.0, 25.0) / 5 * b + clip(F.col("three"), -5.0, 25.0) / 5 * c + d
        return self.measure(rows).select("row.*", (1 / (1 + F.exp(-z))).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter("toxic IN (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold("doc_id", 5)).filter("fold <> 0")
    known = docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("place"), "text", (F.col("toxic") == 1).alias("toxic"), (F.col("fold") != 1).alias("counted"))
    out = Scorer(stored(known, "kn-labelled")).score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
