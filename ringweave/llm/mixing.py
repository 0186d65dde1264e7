"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule of equal slots is laid out: slot n belongs to the source whose part
of the unit interval holds the golden-ratio point frac(n / phi). The k-th slot
of a source takes the k-th block of that source's stream, which is its
documents in hash order, repeated up to `repeats` times and cut into blocks of
equal numbers of words. Whatever a source lacks because points don't fall
exactly evenly follows after the schedule, so that every source gives its
rounded target.

Defined results: a null text has size 0 and takes no part; null is a source of
its own, the last one; repeated rows are documents of their own; an empty table
gives an empty mix; columns besides those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stored

GOLDEN = 0.6180339887498949
CELLS = 1024
CHUNK = 4096
#: Up to so many sources their table is broadcast; beyond, the joins shuffle.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    #: A row for each document: id, size, source, source_size, target, taken.
    documents: DataFrame
    #: A row for each slot that takes a block: slot, source_id, rank.
    schedule: DataFrame
    #: The mix itself: slot, id, source, from_word, to_word (in the document), pass (0 for its first use).
    pieces: DataFrame
    #: A row for each source: source_id, source, source_size, weight, target, quota.
    sources: DataFrame


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets of the sources: `share` of all words by weight, none above `repeats` times the source; the excess goes to the others by weight."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("source_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))
    cap = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_id")
    everything = W.partitionBy()
    filled = (
        cap.withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("before"))
        .withColumn("full", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    )
    level = F.first(F.when(~F.col("full"), F.struct("left", "weights")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weights"))
    return (
        filled.withColumn("level", level)
        .withColumn("target", target)
        .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).cast("long"))
        .select("source_id", "source", "source_size", "weight", "target", "quota")
        .withColumn("quota_from", F.sum("quota").over(W.orderBy("source_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("quota"))
    )


def streams(sizes: DataFrame, sources: DataFrame, hint: str) -> DataFrame:
    """Each document's place in its source's stream. Sums go over hash buckets first, so no task sorts a whole source."""
    placed = sizes.join(sources.hint(hint), sizes.source.eqNullSafe(sources.source)).select(sizes["*"], "source_id", "source_size", "target", "quota").withColumn("bucket", F.substring("place", 1, 3))
    sums = placed.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source_id", "bucket", (F.sum("n").over(W.partitionBy("source_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("bucket_from"))
    inside = W.partitionBy("source_id", "bucket").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(sums.hint("shuffle_hash"), ["source_id", "bucket"]).withColumn("start", F.col("bucket_from") + F.col("inside")).drop("bucket", "bucket_from", "inside")


def schedule_slots(sources: DataFrame, n_slots: int, words: int, block: int, hint: str) -> DataFrame:
    """(slot, source_id, rank, quota): golden-ratio points through cumulative quotas, ranked within each source."""
    spark = sources.sparkSession
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (point * words).alias("at"), F.floor(point * CELLS).cast("long").alias("cell"))
    edge = lambda c: F.floor(c * F.lit(float(CELLS)) / words)
    cells = sources.filter("quota > 0").withColumn("cell", F.explode(F.sequence(edge(F.col("quota_from")), F.least(edge(F.col("quota_from") + F.col("quota")), F.lit(CELLS)))))
    inside = (F.col("at") >= F.col("quota_from")) & (F.col("at") < F.col("quota_from") + F.col("quota"))
    hit = slots.join(cells.hint(hint), "cell").filter(inside).select("slot", "source_id", (F.col("slot") / CHUNK).cast("long").alias("chunk"))
    sums = hit.groupBy("source_id", "chunk").agg(F.count("*").alias("n"))
    sums = sums.select("source_id", "chunk", (F.sum("n").over(W.partitionBy("source_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("chunk_from"))
    rank = F.row_number().over(W.partitionBy("source_id", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("rank", rank).join(sums.hint("shuffle_hash"), ["source_id", "chunk"]).select("slot", "source_id", (F.col("rank") + F.col("chunk_from")).alias("rank"))
    ranked = ranked.join(sources.select("source_id", "quota").hint(hint), "source_id").filter(F.col("rank") * block < F.col("quota")).drop("quota")
    had = ranked.groupBy("source_id").agg(F.max("rank").alias("last"))
    late = sources.filter("quota > 0").join(had.hint("shuffle_hash"), "source_id", "left")
    first, last = F.coalesce(F.col("last"), F.lit(-1)) + 1, F.floor((F.col("quota") - 1) / block).cast("long")
    late = late.filter(first <= last).select("source_id", F.explode(F.sequence(first, last)).alias("rank")).select((F.col("rank") + n_slots).alias("slot"), "source_id", "rank")
    return ranked.unionByName(late)


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), share=1.5, repeats=2, slots=1 << 20) -> Mix:
    """Mix `docs` by source; see the module's text. `slots`: about how many slots the schedule has; a block is all words of the mix over it."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")).withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    sizes = stored(sizes, "mix-sizes")
    sources = stored(source_targets(sizes, weights, share, repeats), "mix-sources")
    words, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    hint = "broadcast" if n_sources <= BROADCAST_SOURCES else "shuffle_hash"
    block = max(1, -(-words // slots))
    schedule = schedule_slots(sources, -(-words // block), max(words, 1), block, hint)
    placed = stored(streams(sizes, sources, hint), "mix-streams")
    # a document's place in each pass over its source's stream, cut at blocks and at the quota
    used = placed.filter("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(repeats)))))
    used = used.withColumn("begin", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).filter("begin < end")
    cut = used.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)).cast("array<long>")))
    cut = cut.withColumn("from_word", F.greatest(F.col("begin"), F.col("rank") * block) - F.col("begin")).withColumn("to_word", F.least(F.col("end"), (F.col("rank") + 1) * block) - F.col("begin"))
    joined = cut.join(schedule.hint("shuffle_hash"), ["source_id", "rank"])
    taken = joined.groupBy("source_id", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    out = placed.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "at").hint("shuffle_hash"), ["source_id", "at"], "left")
    documents = out.select("id", "size", "source", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
    return Mix(documents, schedule, joined.select("slot", "id", "source", "from_word", "to_word", "pass"), sources)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mixed(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs).documents.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_id FROM g),
w AS (SELECT *, CASE source_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM r),
f AS (SELECT *, sum(cap) OVER a - cap AS before, sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () * 1.5::DOUBLE AS total
      FROM w WINDOW a AS (ORDER BY cap::DOUBLE / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, cap * weights <= (total - before::DOUBLE) * weight AS is_full FROM f),
v AS (SELECT min_by((total - before::DOUBLE), cap::DOUBLE / weight) AS rest, min_by(weights, cap::DOUBLE / weight) AS ws
      FROM (SELECT * FROM l WHERE NOT is_full ORDER BY cap::DOUBLE / weight, source_id LIMIT 1)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE rest * weight / ws::DOUBLE END AS target FROM l LEFT JOIN v ON true),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
p AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.quota,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(start + size, quota % source_size) - start) END::BIGINT AS taken
FROM p
"""
