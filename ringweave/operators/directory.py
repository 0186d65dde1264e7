"""Directories of communities and accounts: searches, sorting and the timeline's filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import tier
from .filters import equal, page, risk, substring

#: Orders of a community's accounts: column, what a missing value counts as, descending.
ACCOUNT_ORDERS = {
    "risk_asc": ("risk_score", 0.0, False),
    "risk_desc": ("risk_score", 0.0, True),
    "balance_asc": ("balance", 0.0, False),
    "balance_desc": ("balance", 0.0, True),
    "created_asc": ("creation_date", "", False),
    "created_desc": ("creation_date", "", True),
}


def signals(items: DataFrame) -> DataFrame:
    """community_id, top_signal_1 to 3: the evidence types with most points, '' where there are fewer."""
    points = items.groupBy("entity_id", "type").agg(F.sum("points").alias("points"))
    k = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("points"), "type"))
    top = points.withColumn("k", k).filter("k <= 3")
    name = lambda n: F.coalesce(F.max(F.when(F.col("k") == n, F.col("type"))), F.lit("")).alias(f"top_signal_{n}")
    return top.groupBy(F.col("entity_id").cast("long").alias("community_id")).agg(name(1), name(2), name(3))


def tally(items: DataFrame, text: str | None = None) -> DataFrame:
    """entity_type, entity_id, type, points, hit (whether the text finds one of them): what a directory reads of evidence, a row for each type of an entity. Items that are there twice count once."""
    hit = _told(_text(text)) if _text(text) else F.lit(False)
    each = items.groupBy("evidence_id", "entity_id", "entity_type", "type").agg(F.max("points").alias("points"), F.max(hit).alias("hit"))
    return each.groupBy("entity_type", "entity_id", "type").agg(F.sum("points").alias("points"), F.max("hit").alias("hit"))


def _text(text: str | None) -> str:
    return (text or "").strip().lower()


def _told(text: str) -> Column:
    """Whether an item's type, title or supporting entities hold the text."""
    return F.lower(F.concat_ws("\n", "type", "title", F.array_join("supporting_entities", "\n"))).contains(text)


def _named(text: str) -> Column:
    """Whether a community's number (as such, as #number or as community #number), level or signals hold the text."""
    number = F.col("community_id").cast("string")
    fields = [number, F.concat(F.lit("community #"), number), F.concat(F.lit("community "), number), F.lower("risk_level"), *(F.lower(f"top_signal_{n}") for n in (1, 2, 3))]
    return F.coalesce(F.array_max(F.transform(F.array(*fields), lambda x: x.contains(text))), F.lit(False))


def communities(rows: DataFrame, text: str | None = None, level: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Communities (community_id, risk_level, top_signal_1 to 3, ...) of a level that a text finds.

    With `items`, evidence counts too: its type, title and supporting entities, or what `tally` found of these.
    """
    rows = equal(rows, risk_level=level)
    text = _text(text)
    if not text:
        return rows
    if items is None:
        return rows.filter(_named(text))
    hits = items.filter("hit" if "hit" in items.columns else _told(text)).select(F.col("entity_id").cast("long").alias("community_id"), F.lit(True).alias("hit")).distinct()
    return rows.join(hits.hint("merge"), "community_id", "left").filter(_named(text) | F.coalesce("hit", F.lit(False))).drop("hit")


def order(column: str, ascending: bool = False, last: str = "community_id") -> list[Column]:
    """The order of a directory by any column: nulls count as lowest, ties go by id."""
    by = F.col(column)
    return [by.asc_nulls_first() if ascending else by.desc_nulls_last(), F.col(last)]


def events(timeline: DataFrame, text: str | None = None, status: str | None = None, supporting: DataFrame | None = None) -> DataFrame:
    """Events of a timeline that a text finds, of a status, and among `supporting` (community_id, transaction_id) where their community has any."""
    rows = substring(timeline, text, ["transaction_id", "src_account_id", "dst_account_id", "merchant_id"])
    if status is not None:
        rows = rows.filter(F.lower("transaction_status") == status.lower())
    if supporting is None:
        return rows
    wanted = supporting.select("community_id", "transaction_id").distinct()
    focused = wanted.select("community_id").distinct().withColumn("focused", F.lit(True))
    marked = rows.join(wanted.withColumn("named", F.lit(True)).hint("merge"), ["community_id", "transaction_id"], "left").join(focused.hint("merge"), "community_id", "left")
    return marked.filter("named OR focused IS NULL").drop("named", "focused")


def accounts(rows: DataFrame, text: str | None = None, level: str | None = None, sort: str = "created_desc", partition: str = "community_id") -> DataFrame:
    """The accounts of each community that a text and a tier find, with their place in one of ACCOUNT_ORDERS; an unknown order is created_desc. Ids break ties in the same direction."""
    column, missing, down = ACCOUNT_ORDERS.get(sort, ACCOUNT_ORDERS["created_desc"])
    value = F.coalesce(F.col(column).cast("string" if missing == "" else "double"), F.lit(missing))
    by = [F.desc(value), F.desc("account_id")] if down else [value, F.col("account_id")]
    found = risk(substring(rows, text, ["account_id", "customer_name"]), -float("inf"), float("inf"), level)
    return found.withColumn("place", F.row_number().over(W.partitionBy(partition).orderBy(*by)))


def account_page(placed: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of each community's accounts."""
    number, size = max(1, number), min(100, max(1, size))
    return placed.filter(F.col("place").between((number - 1) * size + 1, number * size))


def top(rows: DataFrame, column: str, ascending: bool = False, number: int = 1, size: int = 25) -> DataFrame:
    """One page of a directory in the order of a column."""
    return page(rows, order(column, ascending), number, size)


def level_of(score: Column) -> Column:
    return tier(score / 100)
