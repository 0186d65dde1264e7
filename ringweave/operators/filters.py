"""Registry filters, sorting and paging. Every argument is optional; null means no filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import tier

#: Lenses and the evidence types that they can show (fixed values).
LENSES = {
    "relationship": None,
    "community": None,
    "flow-of-funds": ("TEMPORAL_BURST", "RAPID_INTERACTION"),
    "shared-infrastructure": ("SHARED_INSTRUMENT_CONCENTRATION", "DEVICE_REUSE", "IP_CONCENTRATION", "MULTI_LAYER_EVIDENCE"),
    "temporal": ("TEMPORAL_BURST", "RAPID_INTERACTION", "MERCHANT_TEMPORAL_OVERLAP"),
}


def equal(df: DataFrame, **values) -> DataFrame:
    for column, value in values.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Both ends belong to the range."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    return df if high is None else df.filter(F.col(column) <= high)


def _any(df: DataFrame, tests: list[Column]) -> DataFrame:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return df.filter(out)


def prefix(df: DataFrame, text: str | None, columns) -> DataFrame:
    text = (text or "").strip().lower()
    return _any(df, [F.lower(c).startswith(text) for c in columns]) if text else df


def substring(df: DataFrame, text: str | None, columns) -> DataFrame:
    text = (text or "").strip().lower()
    return _any(df, [F.lower(c).contains(text) for c in columns]) if text else df


def risk(df: DataFrame, low: float = 0.0, high: float = 1.0, level: str | None = None) -> DataFrame:
    """By risk_score, a missing one counting as 0, and by its tier."""
    df = df.filter(F.coalesce("risk_score", F.lit(0.0)).between(low, high))
    return df if level is None else df.filter(tier(F.col("risk_score")) == level)


def direction(df: DataFrame, account: Column, which: str = "all") -> DataFrame:
    sent, received = F.col("src_account_id") == account, F.col("dst_account_id") == account
    return df.filter({"all": sent | received, "sent": sent, "received": received}[which])


def is_transaction_id(text: Column) -> Column:
    return F.lower(text).rlike("^(tx_|txn_)")


def lens_shows(kind: Column, lens: str) -> Column:
    kinds = LENSES[lens]
    return F.lit(True) if kinds is None else kind.isin(*kinds)


def page(df: DataFrame, by: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page in the order of `by`, which should end with an id; at most 100 rows."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


def total_pages(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("long")
