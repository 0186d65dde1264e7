"""Column contracts: what analysis may see, and in which order tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Evaluation columns, and the order of the enriched ledger.
EVALUATION = ("pattern_id", "is_ring_member", "link_type")
LABEL_COLUMNS = ("is_positive", "max_ring_coverage", "primary_ring_id", "num_rings_intersected", "fraud_account_count", "fraud_purity", "label")
OBSERVABLE = ("transaction_id", "timestamp", "amount", "src_account_id", "dst_account_id", "merchant_id", "device_id", "payment_instrument_id", "ip_address", "payment_method", "account_age_days", "transaction_status")


def require(df: DataFrame, columns, forbidden=EVALUATION) -> DataFrame:
    """df, or ValueError if it holds a forbidden column or lacks a required one; no job runs."""
    found = sorted(set(df.columns) & set(forbidden))
    if found:
        raise ValueError(f"evaluation columns are not allowed here: {found}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def observable(df: DataFrame) -> DataFrame:
    """df without the evaluation columns."""
    return df.drop(*EVALUATION)


def ordered(df: DataFrame) -> DataFrame:
    """The enriched ledger's columns: observable ones first, evaluation columns last."""
    return df.select(*(c for c in OBSERVABLE if c in df.columns), *(c for c in ("pattern_id", "is_ring_member") if c in df.columns))
