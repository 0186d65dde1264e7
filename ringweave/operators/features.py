"""21 observable features per community."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .communities import stats_of, structure
from .contracts import require
from .stored import cut

# The features in order.
FEATURES = (
    "member_count density mean_edge_weight weight_per_member unique_shared_instruments unique_shared_devices unique_shared_ips unique_shared_merchants "
    "instrument_sharing_ratio device_sharing_ratio temporal_compression_score unique_active_hours median_inter_transaction_gap_hours tx_per_member temporal_overlap_mean "
    "mean_tx_amount total_transaction_amount amount_cv declined_rate unique_payment_methods merchant_category_entropy"
).split()


def member_transactions(membership: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions with a member at either end, once for each community."""
    ends = transactions.withColumn("account_id", F.explode(F.array_distinct(F.array("src_account_id", "dst_account_id"))))
    return ends.join(membership.hint("merge"), "account_id").drop("account_id").dropDuplicates(["community_id", "transaction_id"])


def shared_counts(inside: DataFrame) -> DataFrame:
    """Distinct shared entities of each kind over a community's internal edges."""
    parts = [F.expr(f"transform({k}, x -> named_struct('kind', '{k}', 'entity', x))") for k in ("instruments", "devices", "ips", "merchants")]
    each = inside.select("community_id", F.explode(F.concat(*parts)).alias("x")).select("community_id", "x.kind", "x.entity").distinct()
    return each.groupBy("community_id").agg(*(F.count_if(F.col("kind") == k).alias(f"unique_shared_{k}") for k in ("instruments", "devices", "ips", "merchants")))


def entropy(rows: DataFrame, merchants: DataFrame) -> DataFrame:
    """Entropy in bits of merchant categories; transactions without a known merchant don't count."""
    n = rows.join(merchants.select("merchant_id", "category").hint("merge"), "merchant_id").groupBy("community_id", "category").count()
    p = F.col("count") / F.sum("count").over(W.partitionBy("community_id"))
    return n.withColumn("p", p).groupBy("community_id").agg(F.abs(F.sum(F.col("p") * F.log2("p"))).alias("merchant_category_entropy"))


#: Features by what they are made from, beside the members and internal edges of a community.
PARTS = {
    "overlap": ("temporal_overlap_mean",),
    "shared": ("unique_shared_instruments", "unique_shared_devices", "unique_shared_ips", "unique_shared_merchants", "instrument_sharing_ratio", "device_sharing_ratio"),
    "activity": ("temporal_compression_score", "unique_active_hours", "median_inter_transaction_gap_hours", "tx_per_member"),
    "money": ("mean_tx_amount", "total_transaction_amount", "amount_cv", "declined_rate", "unique_payment_methods"),
    "entropy": ("merchant_category_entropy",),
}


def community_features(membership: DataFrame, inside: DataFrame, transactions: DataFrame, merchants: DataFrame | None = None, only: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """community_id and FEATURES as doubles; null where a feature isn't defined or its columns are missing.

    With `only`, those of FEATURES that are named, and no work for others. rows: what `member_transactions` gives, where that is stored."""
    require(transactions, ["transaction_id", "timestamp", "src_account_id", "dst_account_id", "amount"])
    names = [c for c in FEATURES if only is None or c in only]
    asks = lambda part: any(c in names for c in PARTS[part])
    n, e = F.col("member_count"), F.col("internal_edges")
    base = structure(membership, inside)
    if asks("overlap"):
        base = base.join(inside.groupBy("community_id").agg(F.avg("temporal_overlap").alias("temporal_overlap_mean")), "community_id", "left")
    if asks("shared"):
        base = base.join(shared_counts(inside).hint("merge"), "community_id", "left")
    if rows is None and (asks("activity") or asks("money") or asks("entropy")):
        # times, sums and categories read these
        wanted = {"transaction_id", "timestamp", "src_account_id", "dst_account_id", "amount"} | ({"merchant_id"} if asks("entropy") else set()) | ({"payment_method", "transaction_status"} if asks("money") else set())
        columns = [c for c in transactions.columns if c in wanted]
        rows = cut(member_transactions(membership, transactions.select(*columns)), "member-rows")
    if asks("activity"):
        base = base.join(stats_of(rows.select("community_id", "timestamp")).hint("merge"), "community_id", "left")
    has = lambda c: c in transactions.columns
    null = F.lit(None).cast("double")
    if asks("money"):
        sums = {
            "mean_tx_amount": F.avg("amount"),
            "total_transaction_amount": F.sum("amount"),
            "amount_cv": F.when(F.count("amount") >= 2, F.stddev_samp("amount") / F.nullif(F.avg("amount"), F.lit(0.0))),
            "declined_rate": F.avg(F.when(F.col("transaction_status") == "declined", 1.0).otherwise(0.0)) if has("transaction_status") else F.max(null),
            "unique_payment_methods": F.countDistinct("payment_method") if has("payment_method") else F.max(null),
        }
        money = rows.groupBy("community_id").agg(*(v.alias(k) for k, v in sums.items() if k in names))
        base = base.join(money.hint("merge"), "community_id", "left")
    if asks("entropy") and merchants is not None and has("merchant_id"):
        base = base.join(entropy(rows, merchants).hint("merge"), "community_id", "left")
    else:
        base = base.withColumn("merchant_category_entropy", null)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {
        "member_count": n,
        "density": F.col("density"),
        "mean_edge_weight": F.when(e > 0, F.col("total_weight") / e),
        "weight_per_member": F.col("total_weight") / n,
        **{f"unique_shared_{k}": zero(F.col(f"unique_shared_{k}")) for k in ("instruments", "devices", "ips", "merchants")},
        "instrument_sharing_ratio": zero(F.col("unique_shared_instruments")) / n,
        "device_sharing_ratio": zero(F.col("unique_shared_devices")) / n,
        "temporal_compression_score": zero(F.col("compression")),
        "unique_active_hours": zero(F.col("active_hours")),
        "median_inter_transaction_gap_hours": F.col("median_gap_hours"),
        "tx_per_member": zero(F.col("tx_count")) / n,
        "unique_payment_methods": zero(F.col("unique_payment_methods")) if has("payment_method") else null,
    }
    return base.select("community_id", *(out.get(c, F.col(c)).cast("double").alias(c) for c in names))


def long_form(features: DataFrame) -> DataFrame:
    """community_id, feature, value."""
    return features.unpivot("community_id", FEATURES, "feature", "value")


def quality_report(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, missing, mean_positive, mean_negative, ratio."""
    rows = long_form(features).join(labels.select("community_id", "is_positive").hint("merge"), "community_id")
    mean = lambda v: F.avg(F.when(F.col("is_positive") == v, F.col("value")))
    out = rows.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing"), mean(1).alias("mean_positive"), mean(0).alias("mean_negative"))
    return out.withColumn("ratio", F.col("mean_positive") / F.nullif(F.col("mean_negative"), F.lit(0.0)))


def class_balance(labels: DataFrame) -> DataFrame:
    """is_positive, n, share of all labels."""
    n = labels.groupBy("is_positive").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("is_positive", "n", (F.col("n") / F.col("total")).alias("share"))
