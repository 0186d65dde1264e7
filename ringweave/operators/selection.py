"""Exact medians without sorting all values of a key: a range around the middle is found first, and only that is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .stored import cut

#: Accuracy of the sketch that proposes the range, and how far from the middle the range goes: some times the sketch's error.
ACCURACY, AROUND = 10_000, 0.0005
#: Keys of at most so many values are ranked in whole, a task holding one such key at a time.
FEW = 100_000


def medians(rows: DataFrame, key: str, value: str, few_keys: bool = False, around: float = AROUND, few: int = FEW, stored: bool = False) -> DataFrame:
    """key, median of the values that aren't null, a mean of the middle two where there are two.

    Keys of up to `few` values are ranked. A sketch of each other key (merged from the tasks' sketches) gives a range that holds
    the middle ranks; rows below it are counted and those in it, about a thousandth,
    are ranked. Should a range miss a rank, as counting tells, that key is ranked
    over all its values, so the result is exact whatever the sketch did.
    `few_keys`: their number has a bound of its own, so their ranges are broadcast.
    `stored`: rows are a table that was written, so they aren't written again."""
    rows = rows.select(key, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    rows = rows if stored else cut(rows, "median-values")
    # each has more than `few` of the rows, so they are few
    large = cut(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > few).select(key), "median-keys")
    if large.isEmpty():
        return placed_medians(rows, key, "v")
    small = placed_medians(rows.join(F.broadcast(large), key, "left_anti"), key, "v") if few else None
    sketched = _sketched_medians(rows.join(F.broadcast(large), key, "left_semi") if few else rows, key, few_keys, around)
    return sketched.unionByName(small) if few else sketched


def _sketched_medians(rows: DataFrame, key: str, few_keys: bool, around: float) -> DataFrame:
    """The same by ranges from sketches; rows of key and v, read several times."""
    range_ = F.percentile_approx("v", F.array(F.lit(0.5 - around), F.lit(0.5 + around)), ACCURACY)
    ranges = rows.groupBy(key).agg(range_.alias("r"), F.count("*").alias("n"))
    n = F.col("n")
    ranges = ranges.select(key, "n", F.col("r")[0].alias("low"), F.col("r")[1].alias("high"), F.floor((n + 1) / 2).alias("first"), (F.floor(n / 2) + 1).alias("second"))
    known = ranges.hint("broadcast" if few_keys else "merge")
    middle = rows.join(known.select(key, "low", "high"), key).filter(F.col("v") <= F.col("high"))
    # one row stands for all below the range: a null value, which sorts first
    counts = middle.groupBy(key, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(key).orderBy(F.asc_nulls_first("v")))
    at = lambda rank: F.min(F.when(F.col("upto") >= F.col(rank), F.struct("upto", "v")))
    found = counts.withColumn("upto", upto).join(ranges.select(key, "first", "second").hint("merge"), key).groupBy(key).agg(at("first").alias("a"), at("second").alias("b"))
    found = cut(found.select(key, F.col("a.v").alias("a"), F.col("b.v").alias("b")), "medians")
    good = found.filter("a IS NOT NULL AND b IS NOT NULL").select(key, ((F.col("a") + F.col("b")) / 2).alias("median"))
    missed = found.filter("a IS NULL OR b IS NULL").select(key)
    if missed.isEmpty():
        return good
    return good.unionByName(ranked_medians(rows.join(missed.hint("merge"), key, "left_semi"), key, "v"))


def ranked_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The same by ranking a key's different values, all of them."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy(key).orderBy(value)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return upto.join(total.hint("merge"), key).groupBy(key).agg(((at(low) + at(high)) / 2).alias("median"))


def placed_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The same for keys of few values, nulls aside: a task holds the values of one key, which move once."""
    of = W.partitionBy(key)
    placed = rows.withColumn("place", F.row_number().over(of.orderBy(value))).withColumn("n", F.count("*").over(of))
    middle = placed.filter(F.col("place").between(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    return middle.groupBy(key).agg(((F.min(value) + F.max(value)) / 2).alias("median")).filter(F.col(key).isNotNull())
