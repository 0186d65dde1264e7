"""Runs of repeated words in documents, found in tiles whose size goes with the period.

An octave holds the periods from P to 2 P - 1. A word "continues" period q if
the word q places on is the same; a run of period q and length L is a maximal
stretch of L - q such words. For runs of at least four periods that stretch has
3 P words or more, so one of the anchors, every 2 P words, lies in its first
2 P words and continues for P words at least.

1. `exploded` cuts documents into tiles, for each octave on its own: stretches of
   words around anchors, 8 P words more on either side, so neighbours overlap. A
   comparison of short word windows leaves out tiles in which no anchor
   continues; it can't lose a run.
2. `solved` takes each tile alone, on any executor: Z-functions over the words
   behind and before an anchor give, for all periods of the octave at once, how
   far it continues. What reaches the end of the tile is a fragment.
3. `stitched` shuffles fragments by document and period, joins those that
   overlap or touch, and drops runs that have a smaller period.

Words are compared by number within a task's texts, and exactly. A document's
tiles have 1.5 log(n) times its n words at the most, whatever is in it.

Defined results: a null text has no words and no runs; rows with the same id and
text share their result, other rows with the same id (or none) don't mix; empty
tables give empty tables; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, pieces, stored, utf8
from .words import U, mix, windows

TIMES, LEAST = 4, 6  # a run has so many periods, and so many words, at least
REACH, TILE = 8, 1024
PIECE = 1 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal for equal words, and where each text's words begin (and their number)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets)
    solid = np.asarray(pc.binary_length(flat)) > 0
    of = np.concatenate([[0], np.cumsum(solid)])[offsets - offsets[0]]
    return np.asarray(flat.filter(pa.array(solid)).dictionary_encode().indices), of


def tiles(ids: np.ndarray, of: np.ndarray):
    """(text, octave, first word, words, anchors) of each tile in which an anchor continues some period of the octave."""
    longest, p = int(np.diff(of).max(initial=0)), 1
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    short = {k: windows(mix(ids.astype(U)), k) for k in (3, 4, 8)} if longest >= LEAST else {}
    while TIMES * p <= longest and longest >= LEAST:
        names = short[{1: 4, 2: 3, 4: 4}.get(p, 8)]
        blocks = np.concatenate([names, np.zeros(-len(names) % (2 * p), U)]).reshape(-1, 2 * p)
        at = np.flatnonzero((blocks[:, p:] == blocks[:, :1]).any(axis=1)) * 2 * p
        at = at[at + p < of[text[at] + 1]]
        group = np.flatnonzero(np.diff(text[at], prepend=-1).astype(bool) | np.diff(at // max(TILE, 32 * p), prepend=-1).astype(bool))
        for a, b in zip(group, [*group[1:], len(at)]):
            own = text[at[a]]
            first, past = max(of[own], at[a] - REACH * p), min(of[own + 1], at[b - 1] + REACH * p)
            yield own, p, first - of[own], ids[first:past], at[a:b] - first
        p *= 2


def z_function(s: list, most: int) -> list:
    """For i below `most`: how many values from i on equal those from the start."""
    n, z, left, right = len(s), [0] * most, 0, 0
    for i in range(1, most):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def divided(q: int) -> tuple:
    """q by each of its prime factors."""
    out, k, rest = [], 2, q
    while k * k <= rest:
        if rest % k == 0:
            out.append(q // k)
            while rest % k == 0:
                rest //= k
        k += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def fragments(words: list, anchors: list, p: int) -> dict:
    """period: [first, past] of stretches in which each word is the same as the one a period on; only stretches that are long enough for a run, with no smaller period."""
    found: dict = {}
    for c in anchors:
        top = min(2 * p, len(words) - c)  # periods below
        ahead = z_function(words[c : c + REACH * p], top)
        likely = [q for q in range(p, top) if ahead[q] >= p]
        if not likely:
            continue
        back = words[max(0, c - REACH * p + 2 * p) : c][::-1]
        z = z_function([*back, -1, *words[c : c + top][::-1], *back], len(back) + 1 + top)
        behind = lambda q, z=z, at=len(back) + 1 + top: z[at - q]
        for q in likely:
            if ahead[q] + behind(q) < max((TIMES - 1) * q, LEAST - q):
                continue
            if any(d + ahead[d] >= q + ahead[q] and behind(d) >= behind(q) for d in divided(q)):
                continue
            own, first, past = found.setdefault(q, []), c - behind(q), c + ahead[q]
            if own and own[-1][1] >= first:
                own[-1] = [min(own[-1][0], first), max(own[-1][1], past)]
            else:
                own.append([first, past])
    return found


def _lists(parts: list) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


def _explode(batches):
    for batch in batches:
        texts, keys = batch.column("text"), batch.column("key")
        _, offsets = utf8(texts)
        for a, b in pieces(offsets, PIECE):
            part = texts.slice(a, b - a)
            ids, of = words_of(part)
            cut = [*tiles(ids, of)]
            row, octave, first, words, anchors = zip(*cut) if cut else ((),) * 5
            row = np.asarray(row, np.int64)
            whole = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in part.to_pylist()]
            kept = part.take(pa.array(np.arange(b - a), mask=~np.isin(np.arange(b - a), row)))
            nothing = lambda n, kind: pa.nulls(n, kind)
            size, lists = b - a, pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [keys.slice(a, size), batch.column("id").slice(a, size), pa.array(np.diff(of)), pa.array(whole), kept, nothing(size, pa.int32()), nothing(size, pa.int64()), nothing(size, lists), nothing(size, lists)], _COLUMNS
            )
            for x in range(0, len(cut), 4096):
                y = min(len(cut), x + 4096)
                n = y - x
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, size).take(pa.array(row[x:y])), nothing(n, batch.schema.field("id").type), nothing(n, pa.int64()), nothing(n, pa.string()), nothing(n, part.type), pa.array(octave[x:y], pa.int32()), pa.array(first[x:y], pa.int64()), _lists(words[x:y]), _lists(anchors[x:y])], _COLUMNS
                )


_COLUMNS = ["key", "id", "n_words", "whole_sha", "text", "octave", "first", "words", "anchors"]


def _solve(batches):
    for batch in batches:
        out: dict = {"key": [], "period": [], "first": [], "past": []}
        key, octave, first, words, anchors = (batch.column(k) for k in ("key", "octave", "first", "words", "anchors"))
        for k in range(batch.num_rows):
            start = first[k].as_py()
            for q, own in fragments(words[k].values.to_pylist(), anchors[k].values.to_pylist(), octave[k].as_py()).items():
                for a, b in own:
                    for name, x in zip(out, (key[k].as_py(), q, start + a, start + b)):
                        out[name].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.binary()), *(pa.array(out[k], pa.int64()) for k in ("period", "first", "past"))], list(out))


def _collapse(batches):
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for x in runs or []:
                gone[x["start"] + x["period"]] += 1
                gone[x["start"] + x["length"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            out.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s).decode())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), batch.column("n_words"), batch.column("runs"), pa.array(out, pa.string())], ["key", "id", "n_words", "runs", "collapsed"])


def exploded(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Stored: a row for each document (octave is null: key, id, n_words, whole_sha of its words joined by a space, and its text if it has tiles), and a row for each tile."""
    id_ = F.col(id_col)
    name = F.concat(F.when(id_.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), id_.cast("string"))), F.lit("\n"), F.coalesce(text_col, F.lit("")))
    texts = docs.select(F.unhex(F.sha2(name, 256)).alias("key"), id_.alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(texts.mapInArrow(_explode, f"key binary, id {kind}, n_words long, whole_sha string, text string, octave int, first long, words array<int>, anchors array<int>"), "periodic-tiles")


def solved(cut: DataFrame) -> DataFrame:
    """key, period, first, past: fragments, from tiles dealt out anew, so a long document's tiles go to many tasks."""
    dealt = cut.filter("octave IS NOT NULL").select("key", "octave", "first", "words", "anchors").repartition("key", "octave", "first")
    return dealt.mapInArrow(_solve, "key binary, period long, first long, past long")


def stitched(parts: DataFrame) -> DataFrame:
    """key, start, length, period of each run."""
    own = W.partitionBy("key", "period").orderBy("first", "past")
    before = F.max("past").over(own.rowsBetween(W.unboundedPreceding, -1))
    islands = parts.distinct().withColumn("new", F.coalesce(F.col("first") > before, F.lit(True))).withColumn("island", F.sum(F.col("new").cast("long")).over(own))
    found = islands.groupBy("key", "period", "island").agg(F.min("first").alias("start"), (F.max("past") + F.col("period") - F.min("first")).alias("length"))
    found = found.filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))  # a multiple of a run's period has the same stretch


def collapsed(cut: DataFrame, runs: DataFrame) -> DataFrame:
    """key, id, n_words, runs (sorted structs start, period, length), collapsed (the words that stay): a row for each document that has runs."""
    by = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    some = cut.filter("octave IS NULL AND text IS NOT NULL").select("key", "id", "n_words", "text").join(by.hint("merge"), "key")
    kind = cut.schema["id"].dataType.simpleString()
    return some.mapInArrow(_collapse, f"key binary, id {kind}, n_words long, runs array<struct<start:long,period:long,length:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by hash repeats some words up to its end. A row without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        a = F.pmod(g, F.size(w).cast("long"))
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    cut = exploded(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    changed = stored(collapsed(cut, stitched(solved(cut))), "periodic-collapsed")
    best = F.element_at(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("longest"), x["start"].alias("start"), x["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    found = changed.select("id", "key", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.longest")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.longest") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    none = lambda: F.lit(None).cast("long")
    with_runs = changed.select("key").distinct()
    rest = cut.filter("octave IS NULL").select("key", "id", "whole_sha").join(with_runs.hint("merge"), "key", "left_anti").select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_runs"), none().alias("start"), none().alias("length"), none().alias("period"), none().alias("exponent_milli"), F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("whole_sha").alias("collapsed_sha256")
    )
    return found.unionByName(rest)
