"""Tables that an investigator reads: registries, profiles, pairs, timelines, for all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.rules import tier
from .communities import numbered
from .features import member_transactions
from .graph import mirrored

PEERS = 150
KEEP = 5


def ends(transactions: DataFrame) -> DataFrame:
    """A row for each side of each transaction: account_id, side, counterparty; a self-transfer has both."""
    sides = F.array(F.struct(F.col("src_account_id").alias("account_id"), F.lit("sent").alias("side"), F.col("dst_account_id").alias("counterparty")), F.struct(F.col("dst_account_id").alias("account_id"), F.lit("received").alias("side"), F.col("src_account_id").alias("counterparty")))
    return transactions.withColumn("end", F.explode(sides)).select("*", "end.account_id", "end.side", "end.counterparty").drop("end")


def ledger(transactions: DataFrame) -> DataFrame:
    """Each account's transactions in the order of the source; a self-transfer once. position counts from 1."""
    rows = ends(transactions).dropDuplicates(["account_id", "transaction_id"])
    return rows.withColumn("position", F.row_number().over(W.partitionBy("account_id").orderBy("row_seq")))


def account_stats(transactions: DataFrame) -> DataFrame:
    n = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0))
    return ends(transactions).groupBy("account_id").agg(
        n("sent", F.lit(1)).alias("sent_count"),
        n("received", F.lit(1)).alias("received_count"),
        n("sent", F.col("amount")).alias("sent_amount"),
        n("received", F.col("amount")).alias("received_amount"),
        F.count_if(F.col("transaction_status") == "declined").alias("declined_count"),
        F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"),
    )


def registry(accounts: DataFrame, membership: DataFrame, stats: DataFrame, inside: DataFrame) -> DataFrame:
    """All accounts with community, tier, counts, volume, decline rate and connections."""
    links = mirrored(inside.select("src", "dst")).groupBy("account_id").agg(F.count("*").alias("connections"))
    rows = accounts.join(membership, "account_id", "left").join(stats.hint("merge"), "account_id", "left").join(links.hint("merge"), "account_id", "left")
    n = F.coalesce(F.col("sent_count") + F.col("received_count"), F.lit(0))
    volume = F.coalesce(F.col("sent_amount") + F.col("received_amount"), F.lit(0.0))
    return rows.select(
        "account_id", "customer_name", "balance", "risk_score", "creation_date", "community_id",
        tier(F.col("risk_score")).alias("risk_tier"),
        n.alias("tx_count"),
        F.bround(volume, 2).alias("tx_volume"),
        F.bround(F.coalesce("declined_count", F.lit(0)) / F.greatest(F.lit(1), n), 4).alias("decline_rate"),
        F.coalesce("connections", F.lit(0)).alias("connections"),
        "first_activity", "last_activity",
    )


def peers(accounts: DataFrame, sample: int = PEERS) -> DataFrame:
    """Medians over the first `sample` other members of each account's community.

    `accounts`: account_id, community_id, tx_count, tx_volume, declined_count, connections. Only the first members
    have peers of their own; all others share the first `sample` members' medians."""
    rank = F.row_number().over(W.partitionBy("community_id").orderBy("account_id"))
    rows = accounts.filter("community_id IS NOT NULL").withColumn("rank", rank)
    n = F.greatest(F.lit(1), F.col("tx_count"))
    measured = rows.withColumns({"decline_rate": F.col("declined_count") / n, "avg_amount": F.col("tx_volume") / n})
    values = {"tx_count": 1, "tx_volume": 2, "decline_rate": 4, "connections": 1, "avg_amount": 2}
    medians = [F.bround(F.median(c), d).alias(f"peer_median_{c}") for c, d in values.items()]
    first = measured.filter(F.col("rank") <= sample + 1).select("community_id", F.col("account_id").alias("peer"), F.col("rank").alias("peer_rank"), *values)
    early = rows.filter(F.col("rank") <= sample).select("account_id", "community_id", "rank").join(first.hint("merge"), "community_id").filter("peer <> account_id").groupBy("account_id").agg(F.count("*").alias("peer_sample_size"), *medians)
    shared = first.filter(F.col("peer_rank") <= sample).groupBy("community_id").agg(F.count("*").alias("peer_sample_size"), *medians)
    late = rows.filter(F.col("rank") > sample).select("account_id", "community_id").join(shared.hint("merge"), "community_id").drop("community_id")
    return early.unionByName(late)


def pairs(transactions: DataFrame) -> DataFrame:
    """Flows between two accounts, a <= b: counts and sums each way, first, last, declined."""
    low, high = F.least("src_account_id", "dst_account_id"), F.greatest("src_account_id", "dst_account_id")
    rows = transactions.withColumns({"a": low, "b": high, "forward": F.col("src_account_id") == low})
    n = lambda way, v: F.sum(F.when(F.col("forward") == way, v).otherwise(0))
    return rows.groupBy("a", "b").agg(
        n(True, F.lit(1)).alias("forward_count"), n(False, F.lit(1)).alias("reverse_count"), n(True, F.col("amount")).alias("forward_amount"), n(False, F.col("amount")).alias("reverse_amount"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count_if(F.col("transaction_status") == "declined").alias("declined_count"),
    )


def counterparties(transactions: DataFrame, membership: DataFrame) -> DataFrame:
    """For each transaction, what passed between its two accounts, and whether they are in one community."""
    side = lambda name: membership.select(F.col("account_id").alias(name), F.col("community_id").alias(f"{name}_c"))
    mart = pairs(transactions).join(side("a").hint("merge"), "a", "left").join(side("b").hint("merge"), "b", "left").withColumn("same_community", F.coalesce(F.col("a_c") == F.col("b_c"), F.lit(False))).drop("a_c", "b_c")
    keys = transactions.select("transaction_id", F.least("src_account_id", "dst_account_id").alias("a"), F.greatest("src_account_id", "dst_account_id").alias("b"))
    return keys.join(mart.hint("merge"), ["a", "b"])


def recent_of_pairs(transactions: DataFrame, keep: int = KEEP) -> DataFrame:
    """a, b, recent: the latest transactions of each pair, newest first."""
    rows = transactions.withColumns({"a": F.least("src_account_id", "dst_account_id"), "b": F.greatest("src_account_id", "dst_account_id")})
    k = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("timestamp"), "transaction_id"))
    top = rows.withColumn("k", k).filter(F.col("k") <= keep)
    return top.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "transaction_id"))), lambda x: x["transaction_id"]).alias("recent"))


def timeline(membership: DataFrame, transactions: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Each community's transactions by time, a slice of them, with their total number."""
    rows = member_transactions(membership, transactions)
    place = F.row_number().over(W.partitionBy("community_id").orderBy("timestamp", "transaction_id"))
    totals = rows.groupBy("community_id").agg(F.count("*").alias("total"))
    limit = min(1000, limit)
    shown = rows.withColumn("place", place).filter(F.col("place").between(offset + 1, offset + limit))
    return shown.join(totals.hint("merge"), "community_id").select("community_id", "place", "transaction_id", "timestamp", "amount", "src_account_id", "dst_account_id", "transaction_status", "total")


def details(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    return transactions.join(merchants.select("merchant_id", F.col("name").alias("merchant_name"), F.col("category").alias("merchant_category")), "merchant_id", "left")


def network_summary(accounts: DataFrame, transactions: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of totals; edges: their number, as one row; scores (risk_tier) has a row for each community."""
    one = accounts.agg(F.count("*").alias("accounts")).crossJoin(transactions.agg(F.count("*").alias("transactions"))).crossJoin(edges.select("edges"))
    tiers = scores.agg(F.count("*").alias("communities"), *(F.count_if(F.col("risk_tier") == t).alias(t.lower() + "_communities") for t in ("HIGH", "MEDIUM", "LOW")))
    return one.crossJoin(tiers)


def community_list(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Communities by risk, the highest first, with their rank. scores: community_id, risk_score, probability."""
    rows = scores.join(features, "community_id", "left")
    return numbered(rows, [F.desc("risk_score"), F.desc("probability"), F.col("community_id")], "risk_rank").withColumn("risk_rank", F.col("risk_rank").cast("int")).orderBy("risk_rank")


def community_detail(features: DataFrame, stats: DataFrame) -> DataFrame:
    """community_id, features as a map, what follows from them, and the span of activity."""
    names = [c for c in features.columns if c != "community_id"]
    n = F.col("member_count")
    return features.join(stats.select("community_id", "first_ts", "last_ts", "span_hours"), "community_id", "left").select(
        "community_id",
        F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))).alias("features"),
        F.bround(F.col("weight_per_member") * n, 2).alias("total_internal_weight"),
        F.bround(F.col("density") * n * (n - 1) / 2).cast("long").alias("internal_edge_count"),
        "first_ts", "last_ts", "span_hours",
    )


def behaviour(transactions: DataFrame) -> DataFrame:
    """Per account: count, average amount, decline rate, active days, velocity and a count by method."""
    rows = ends(transactions).dropDuplicates(["account_id", "transaction_id"])
    n = F.count("*")
    base = rows.groupBy("account_id").agg(n.alias("tx_count"), F.avg("amount").alias("avg_amount"), F.sum("amount").alias("volume"), (F.count_if(F.col("transaction_status") == "declined") / n).alias("decline_rate"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    days = F.greatest(F.lit(1), F.ceil((F.unix_micros("last") - F.unix_micros("first")) / F.lit(86400e6))).cast("long")
    methods = rows.groupBy("account_id", "payment_method").count().groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("payment_method", F.lit("?")), F.col("count").cast("string")))), ",").alias("methods"))
    return base.join(methods.hint("merge"), "account_id").withColumn("active_days", days).withColumn("velocity", F.col("tx_count") / F.col("active_days")).drop("first", "last")


def exposure(inside: DataFrame, keep: int = KEEP) -> DataFrame:
    """Per account: distinct shared entities over its connections, and its strongest connections."""
    both = mirrored(inside)
    kinds = ("devices", "instruments", "ips")
    each = both.select("account_id", F.explode(F.concat(*(F.expr(f"transform({k}, x -> named_struct('kind', '{k}', 'id', x))") for k in kinds))).alias("x")).select("account_id", "x.kind", "x.id").distinct()
    counts = each.groupBy("account_id").agg(*(F.count_if(F.col("kind") == k).alias(f"shared_{k}") for k in kinds))
    k = F.row_number().over(W.partitionBy("account_id").orderBy(F.desc("weight"), "peer"))
    top = both.select("account_id", "peer", "weight").withColumn("k", k).filter(F.col("k") <= keep)
    top = top.groupBy("account_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "peer"))), lambda x: x["peer"]).alias("strongest"))
    zero = [F.coalesce(f"shared_{c}", F.lit(0)).alias(f"shared_{c}") for c in kinds]
    return top.join(counts.hint("merge"), "account_id", "left").select("account_id", *zero, "strongest")


def event_tags(transactions: DataFrame) -> DataFrame:
    """account_id, transaction_id, tag: first, declined, large or last; others are left out."""
    rows = ends(transactions).dropDuplicates(["account_id", "transaction_id"])
    place = F.struct("timestamp", "transaction_id")
    limits = rows.groupBy("account_id").agg(F.greatest(F.lit(1000.0), 2.5 * F.avg("amount")).alias("limit"), F.min(place).alias("first"), F.max(place).alias("last"))
    rows = rows.join(limits.hint("merge"), "account_id")
    tag = F.when(place.eqNullSafe(F.col("first")), "first").when(F.lower("transaction_status") == "declined", "declined").when(F.col("amount") >= F.col("limit"), "large").when(place.eqNullSafe(F.col("last")), "last")
    return rows.select("account_id", "transaction_id", tag.alias("tag")).filter("tag IS NOT NULL")


def _told(**rules):
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def explanations(profile: DataFrame) -> DataFrame:
    """account_id, reasons that speak against suspicion. profile: behaviour, exposure, peers and evidence counts of an account."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    return profile.select("account_id", _told(
        decline_like_peers=F.col("decline_rate") <= F.col("peer_median_decline_rate"),
        no_shared_hardware=zero("shared_devices") & zero("shared_instruments"),
        volume_below_peers=F.col("volume") < F.col("peer_median_tx_volume"),
        only_low_evidence=zero("high_count") & zero("medium_count"),
    ).alias("reasons"))


def next_actions(profile: DataFrame) -> DataFrame:
    """account_id, actions. profile also has community_risk_score (0 to 100)."""
    return profile.select("account_id", _told(
        inspect_devices=F.col("shared_devices") > 0,
        inspect_instruments=F.col("shared_instruments") > 0,
        triage_community=F.col("community_risk_score") >= 60,
        inspect_strongest=F.size(F.coalesce("strongest", F.expr("array()"))) > 0,
    ).alias("actions"))


def hypotheses(features: DataFrame) -> DataFrame:
    """Flags on a community's features (fixed thresholds)."""
    return features.select(
        "community_id",
        ((F.col("unique_shared_devices") > 0) | (F.col("unique_shared_instruments") > 0)).alias("shared_hardware"),
        (F.col("temporal_compression_score") > 0.4).alias("coordinated_timing"),
        (F.col("density") > 0.03).alias("dense_cluster"),
        (F.col("temporal_compression_score") >= 0.35).alias("velocity_spike"),
    )


def related(transactions: DataFrame, keep: int = KEEP) -> DataFrame:
    """transaction_id, related: the first other transactions of the same source, in the order of the source."""
    k = F.row_number().over(W.partitionBy("src_account_id").orderBy("row_seq"))
    rows = transactions.select("src_account_id", "transaction_id", "row_seq").withColumn("k", k)
    first = rows.filter(F.col("k") <= keep + 1).groupBy("src_account_id").agg(F.array_sort(F.collect_list(F.struct("k", "transaction_id"))).alias("first"))
    others = F.slice(F.filter(F.transform("first", lambda x: x["transaction_id"]), lambda x: x != F.col("transaction_id")), 1, keep)
    return rows.join(first.hint("merge"), "src_account_id").select("transaction_id", others.alias("related"))


def community_actions(degrees: DataFrame, features: DataFrame) -> DataFrame:
    """community_id, its hub, and what there is to trace and to validate."""
    hub = degrees.groupBy("community_id").agg(F.min(F.struct((-F.col("degree")).alias("d"), "account_id")).alias("hub"))
    return features.join(hub.hint("merge"), "community_id").select("community_id", F.col("hub.account_id").alias("hub_account"), (-F.col("hub.d")).alias("hub_degree"), "total_transaction_amount", "unique_shared_devices", "unique_shared_instruments")
