"""Nodes and edges with attributes: maps merged key by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import EDGE_OF, NODE_OF, from_map


def attributes(**values: Column) -> Column:
    """A map of those values, as text, that aren't null."""
    whole = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("string") for v in values.values())))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type) of edges (src, dst, type, seq, attrs): of each attribute the value with the greatest seq, whether or not later edges have that attribute.

    Attributes are aggregated as rows, so an edge that repeats a million times is added up where its rows are."""
    key = ["src", "dst", "type"]
    entries = edges.select(*key, "seq", F.explode_outer("attrs").alias("name", "value"))
    last = entries.groupBy(*key, "name").agg(F.max_by("value", "seq").alias("value"))
    pair = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    return last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("attrs"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id of nodes (id, type, priority, attrs): what has the smallest priority comes first and keeps its type and attributes; ties by type."""
    return nodes.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("type", "attrs"), F.struct("priority", "type")).alias("x")).select("id", "x.type", "x.attrs")


def nodes(accounts: DataFrame, merchants: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """id, type, attrs: catalogs first, then entities and transactions, then the ends of edges that nothing else names."""
    none = F.create_map().cast("map<string,string>")
    has = lambda df, *names: attributes(**{n: F.col(n) for n in names if n in df.columns}) if any(n in df.columns for n in names) else none
    when = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    row = lambda df, id_, kind, priority, attrs: df.select(F.col(id_).alias("id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), F.lit(priority).alias("priority"), attrs.alias("attrs"))
    parts = [
        row(accounts, "account_id", "Account", 0, has(accounts, "customer_name", "creation_date")),
        row(merchants, "merchant_id", "Merchant", 1, has(merchants, "name", "category")),
        row(links, "entity_id", from_map(F.col("kind"), NODE_OF), 2, none),
        row(transactions, "transaction_id", "Transaction", 3, attributes(timestamp=when, **{n: F.col(n) for n in ("payment_method", "transaction_status") if n in transactions.columns})),
        row(links, "account_id", "Account", 4, none),
        row(transactions.select(F.explode(F.array("src_account_id", "dst_account_id")).alias("a")), "a", "Account", 4, none),
        row(transactions, "merchant_id", "Merchant", 4, none),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return first_nodes(every)


def edges(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """src, dst, type, attrs: uses of entities, a transaction's ends, and PAYS from an account to its merchants, which later payments update."""
    none = F.create_map().cast("map<string,string>")
    when = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    seq = F.struct("timestamp", "transaction_id")
    uses = links.select(F.col("account_id").alias("src"), F.col("entity_id").alias("dst"), from_map(F.col("kind"), EDGE_OF).alias("type"), F.struct(F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("transaction_id")).alias("seq"), none.alias("attrs"))
    end = lambda src, dst, kind, attrs: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), attrs.alias("attrs"))
    at, paid = attributes(timestamp=when), attributes(timestamp=when, **{n: F.col(n) for n in ("payment_method", "transaction_status") if n in transactions.columns})
    ends = F.array(end("transaction_id", "src_account_id", "FROM_ACCOUNT", at), end("transaction_id", "dst_account_id", "TO_ACCOUNT", at), end("transaction_id", "merchant_id", "AT_MERCHANT", at), end("src_account_id", "merchant_id", "PAYS", paid))
    moved = transactions.select(seq.alias("seq"), F.explode(ends).alias("e")).select("e.src", "e.dst", "e.type", "seq", "e.attrs").filter("dst IS NOT NULL AND src IS NOT NULL")
    return merged_edges(uses.unionByName(moved))


def of_type(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes or edges of one type, or of all, sorted by id or by (src, dst, type)."""
    found = rows if kind is None else rows.filter(F.col("type") == kind)
    return found.orderBy(*(["id"] if "id" in rows.columns else ["src", "dst", "type"]))


def node(rows: DataFrame, id_: str) -> DataFrame:
    return rows.filter(F.col("id") == id_)


def edge(rows: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return rows.filter((F.col("src") == src) & (F.col("dst") == dst) & (F.col("type") == kind))
