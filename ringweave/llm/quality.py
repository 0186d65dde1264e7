"""Quality classifier: supervised subword embeddings.

A text is the mean of the vectors of its words and of its byte n-grams, all
hashed to BUCKETS rows; a softmax over two classes reads it. Vectors and output
are learned together by stochastic gradient descent. As nothing stands between
the mean and the output, a learned model is one number for each bucket: how much
a feature moves the log-odds. Scores are means of these over the whole text.

Learning uses at most SAMPLE labelled rows, those with the smallest hash of
their id; scoring covers every text.

Defined results: a text without features, null or empty, gets the share of label
1 among the learned rows; without labelled rows of both classes every score is
that share, or 1 where there are none; of labels with the same id the largest
counts; repeated documents are learned from as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, pieces, stored, utf8
from .words import U, Words

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4)
SAMPLE, EPOCHS, RATE, SEED = 4000, 5, 0.3, 7
PIECE = 1 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text starts) for the words and for each length of byte n-grams; n-grams over the end of a text are not among them."""
    shift = U(64 - BUCKETS.bit_length() + 1)
    words = Words(data, offsets)
    out = [((words.hash >> shift).astype(np.int64), words.of)]
    wide = data.astype(U)
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        key = np.zeros(size, U)
        for k in range(n):
            key = key << U(8) | wide[k : k + size]
        bucket = ((key * U(0x9E3779B97F4A7C15) + U(n)) * U(0xD1342543DE82EF95) >> shift).astype(np.int64)
        inside = np.ones(size, bool)
        for k in range(1, n):
            edge = offsets[1:-1] - k
            inside[edge[(edge >= 0) & (edge < size)]] = False
        out.append((bucket[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, size)]))
    return out


def _sample(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids, weights = [], []
        for a, b in pieces(offsets, PIECE):
            found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for k in range(b - a):
                own, n = np.unique(np.concatenate([f[s[k] : s[k + 1]] for f, s in found]), return_counts=True)
                ids.append(own.astype(np.int32).tobytes())
                weights.append((n / max(1, n.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], ["place", "label", "ids", "weights"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float, float]:
    """(log-odds by bucket, bias, share of label 1) from (label, buckets, weights)."""
    labels = np.array([r[0] for r in rows])
    share = float(labels.mean()) if len(rows) else 1.0
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float("nan"), share
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.log(np.array([1 - share, share])).astype(np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, ids, weights = rows[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            own = vectors[ids]
            mean = weights @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= np.float32(0.1) * rate * p
            # a feature's step grows with its share of the text, as each occurrence adds to the mean
            vectors[ids] = own - (rate * len(ids)) * np.minimum(weights, np.float32(1 / len(ids)) * 4)[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), share


def _train(sample: int):
    """Rows sorted by place: the model of the first `sample` of them."""

    def run(batches):
        found = []
        for batch in batches:
            for label, ids, weights in zip(*(batch.column(c).to_pylist() for c in ("label", "ids", "weights"))):
                if len(found) < sample:
                    found.append((label, np.frombuffer(ids, np.int32), np.frombuffer(weights, np.float32)))
        odds, bias, share = train([x for x in found if len(x[1])])
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([bias]), pa.array([share])], ["odds", "bias", "share"])

    return run


def learn(labelled: DataFrame, *, id_col="doc_id", text_col="text", label_col="label", sample=SAMPLE):
    """The model, learned from `sample` of the labelled rows at most, in one task."""
    rows = labelled.select(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("place"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    cut = rows.select("place").orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    chosen = stored(rows.filter(F.col("place") <= F.lit(cut)).mapInArrow(_sample, "place string, label int, ids binary, weights binary"), "quality-sample")
    got = chosen.repartition(1).sortWithinPartitions("place", "label", "ids", "weights").mapInArrow(_train(sample), "odds binary, bias double, share double").first()
    return (np.frombuffer(got["odds"], np.float32), got["bias"], got["share"]) if got else train([])  # an empty table runs no task


def scores(data: np.ndarray, offsets: np.ndarray, model) -> np.ndarray:
    odds, bias, share = model
    out = np.full(len(offsets) - 1, share)
    if not np.isfinite(bias):
        return out
    for a, b in pieces(offsets, PIECE):
        total, n = np.zeros(b - a), np.zeros(b - a)
        for f, s in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            sums = np.concatenate([[0.0], np.cumsum(odds[f], dtype=np.float64)])
            total += sums[s[1:]] - sums[s[:-1]]
            n += np.diff(s)
        z = total / np.maximum(n, 1) + bias
        out[a:b] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), share)
    return out


def _score(model, text_col, out):
    def run(batches):
        for batch in batches:
            score = scores(*utf8(batch.column(text_col)), model.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(score)], [*batch.schema.names, out])

    return run


def score(rows: DataFrame, model, *, text_col="text", out="score") -> DataFrame:
    """`rows` with the score of their text in a column `out`, which they must not have yet."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # one number for each of BUCKETS
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_score(sent, text_col, out), f"{fields}, `{out}` double")


def learned(spark, docs: DataFrame, sf_dir: str):
    """The model from labels.quality of the documents outside fold 0 of 5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(fold("doc_id", 5) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    return learn(docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id"))


LEAST = 0.3


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), learned(spark, docs, sf_dir))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
