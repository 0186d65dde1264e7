"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, a
word's edges marked) of a language's texts, by rank. A text gets the language
whose profile is nearest to the text's own list by out-of-place distance: the
sum of rank differences, with the profile's length for an n-gram that it lacks.
N-grams are counted over all learning texts.

Defined results: a null text, or one without a letter, is `und` with score 0,
as is every text when there is nothing to learn from; texts without a language
are not learned from; equal n-gram counts rank by code points, equal distances
by the language's name; repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import fold, pieces, stored, utf8

PROFILE, OWN = 400, 300
PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1 to 3 letters: the n-grams of lower-cased texts as numbers, and where each text's begin."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    # edges of words and texts become one mark
    marks = np.insert(np.where(_letters()[points], points, 32), begins, 32)
    begins = begins + np.arange(len(begins))
    letter = marks != 32
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    s, begins = marks[keep], kept[begins]
    text = s != 32
    grams, firsts = [], []
    for key, good in (
        (s, text),
        (s[:-1] << 21 | s[1:], text[:-1] | text[1:]),
        (s[:-2] << 42 | s[1:-1] << 21 | s[2:], text[1:-1]),
    ):
        grams.append(key[good])
        firsts.append(np.concatenate([[0], np.cumsum(good)])[np.minimum(begins, len(good))])
    return grams, firsts


def _lowered(column) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column))


def _count(batches):
    for batch in batches:
        data, offsets = _lowered(batch.column("text"))
        langs, lang = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        parts: list[list] = [[] for _ in langs]
        for a, b in pieces(offsets, PIECE):
            grams, firsts = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for g, f in zip(grams, firsts):
                owner = np.repeat(lang[a:b], np.diff(f))
                g = g[f[0] : f[-1]]
                for k in np.unique(owner):
                    parts[k].append(np.unique(g[owner == k], return_counts=True))
        for k, found in enumerate(parts):
            if found:
                keys, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([y for _, y in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([langs[k]] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, *, text_col="text", lang_col="lang", size=PROFILE) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(languages, n-grams, begins, owners, ranks): which languages' profiles hold an n-gram, and at which rank; `size` entries for each language."""
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = stored(counts.withColumn("rank", rank).filter(F.col("rank") <= size), "langid-profiles")
    rows = top.select("gram", "lang", (F.col("rank") - 1).alias("rank")).orderBy("gram", "lang").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    grams, begins = np.unique(rows.column("gram").to_numpy().astype(np.int64), return_index=True)
    owners = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int32)
    return languages, grams, np.append(begins, len(owners)), owners, rows.column("rank").to_numpy().astype(np.int32)


def own_profile(keys: np.ndarray, size: int = OWN) -> np.ndarray:
    """The most frequent n-grams of one text, by rank."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(new, append=len(keys))
    return keys[new][np.argsort(-counts, kind="stable")[:size]]


def distances(own: np.ndarray, model, size: int) -> np.ndarray:
    """Out-of-place distance of one text's profile to each language's."""
    languages, grams, begins, owners, ranks = model
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    place = np.flatnonzero(grams[at] == own)
    first, n = begins[at[place]], begins[at[place] + 1] - begins[at[place]]
    entry = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    nearer = size - np.abs(ranks[entry] - np.repeat(place, n))
    return size * len(own) - np.bincount(owners[entry], nearer, len(languages))


def _predict(model, size):
    def run(batches):
        found_model = model.value
        languages = found_model[0]
        for batch in batches:
            data, offsets = _lowered(batch.column("text"))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in pieces(offsets, PIECE):
                found, firsts = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    own = own_profile(np.concatenate([g[f[k] : f[k + 1]] for g, f in zip(found, firsts)]))
                    if len(own) and languages:
                        d = distances(own, found_model, size)
                        best = int(d.argmin())
                        lang[a + k], score[a + k] = languages[best], 1 - d[best] / (size * len(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(lang), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(rows: DataFrame, model, *, size=PROFILE) -> DataFrame:
    """The columns of `rows` but the last, which is the text, with lang_pred and score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    sent = rows.sparkSession.sparkContext.broadcast(model)  # PROFILE entries for each language
    return rows.mapInArrow(_predict(sent, size), f"{fields}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), learn(docs.filter("NOT held_out")))
