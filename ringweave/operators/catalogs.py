"""Catalogs of devices, instruments, addresses and merchants, whose attributes follow from ids by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import modulo, pick, stable_float, stable_int
from .enrich import pools

# What attributes are picked from; types of instruments by their weights.
OS = ["android-13", "android-14", "ios-16", "ios-17", "windows-11", "macos-14"]
ISPS = ["JioNet", "AirtelBB", "BSNL Fiber", "Vodafone-India", "ACT Fibernet", "Hathway", "Tata Play Fiber"]
NETWORKS = ["visa", "mastercard", "rupay", "amex"]
TYPES = ["card", "card", "card", "upi", "upi", "netbanking", "wallet"]
NETWORK_OF = {"upi": "upi", "wallet": "wallet-provider", "netbanking": "bank-transfer"}
CATEGORIES = ["grocery", "electronics", "travel", "utilities", "restaurants", "apparel", "fuel", "pharmacy", "entertainment", "insurance", "education", "jewellery"]
COUNTRY, MOBILE_SHARE, MEDIUM_SHARE = "IN", 0.35, 0.12
FIRST_SEEN, RING_FIRST_SEEN = "2023-01-01", "2023-06-01"


def _range(spark: SparkSession, n: int, prefix: str, width: int) -> DataFrame:
    """id and number of n entities of one pool."""
    number = F.col("id").cast("string")
    name = F.lpad(number, width, "0") if width else number
    return spark.range(n).select(F.concat(F.lit(prefix), name).alias("id"), number.alias("number"))


def _rings(profiles: DataFrame | None, column: str) -> DataFrame | None:
    return None if profiles is None else profiles.filter(F.col(column).isNotNull()).select(F.col(column).alias("id"), F.col("pattern_id").alias("number"))


def _all(parts: list[DataFrame | None]) -> DataFrame:
    found = [p for p in parts if p is not None]
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


def devices(spark: SparkSession, n_accounts: int, profiles: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """device_id, os, device_type, first_seen: a device for each account, the shared pool, and what rings share."""

    def described(rows: DataFrame | None, salt: str, seen: str, kind: Column | None = None) -> DataFrame | None:
        if rows is None:
            return None
        found = rows.withColumn("os", pick(OS, F.col("number"), f"{seed}|{salt}"))
        mobile = F.when(F.col("os").rlike("^(android|ios)"), "mobile").otherwise("desktop")
        return found.select(F.col("id").alias("device_id"), "os", (mobile if kind is None else kind).alias("device_type"), F.lit(seen).alias("first_seen"))

    return _all([
        described(_range(spark, n_accounts, "dev_", 6), "dev-os", FIRST_SEEN), described(_range(spark, pools(n_accounts)["devices"], "dev_s", 4), "sdev-os", FIRST_SEEN),
        described(_rings(profiles, "ring_device"), "rdev-os", RING_FIRST_SEEN, F.lit("mobile")),
    ])


def instruments(spark: SparkSession, n_accounts: int, profiles: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """instrument_id, instrument_type, network, last4, expiry."""

    def described(rows: DataFrame | None, kind: str) -> DataFrame | None:
        if rows is None:
            return None
        key = F.concat(F.lit(f"{kind}|"), "number")
        of = F.col("instrument_type")
        network = F.coalesce(F.when(of == "card", pick(NETWORKS, F.col("key"), f"{seed}-net")), *(F.when(of == k, v) for k, v in NETWORK_OF.items()))
        digits = lambda salt, n, add, width: F.lpad((modulo(stable_int(F.col("key"), f"{seed}-{salt}"), n) + add).cast("string"), width, "0")
        found = rows.withColumn("key", key).withColumn("instrument_type", pick(TYPES, F.col("key"), f"{seed}-itype"))
        return found.select(F.col("id").alias("instrument_id"), "instrument_type", network.alias("network"), digits("last4", 10_000, 0, 4).alias("last4"), F.concat(digits("expm", 12, 1, 2), F.lit("/"), digits("expy", 4, 2027, 4)).alias("expiry"))

    return _all([described(_range(spark, n_accounts, "ins_", 6), "personal"), described(_range(spark, pools(n_accounts)["instruments"], "ins_s", 4), "shared"), described(_rings(profiles, "ring_instrument"), "ring")])


def addresses(spark: SparkSession, n_accounts: int, profiles: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """ip_address, isp, country, is_mobile_isp."""
    pool = _range(spark, pools(n_accounts)["ips"], "ip_", 0).select(F.col("id").alias("ip_address"), pick(ISPS, F.col("id"), f"{seed}-isp").alias("isp"), F.lit(COUNTRY).alias("country"), (stable_float(F.col("id"), f"{seed}-mob") < MOBILE_SHARE).alias("is_mobile_isp"))
    rings = _rings(profiles, "ring_ip")
    if rings is None:
        return pool
    return pool.unionByName(rings.select(F.col("id").alias("ip_address"), pick(ISPS, F.col("number"), f"{seed}-rip").alias("isp"), F.lit(COUNTRY).alias("country"), F.lit(False).alias("is_mobile_isp")))


def merchants(spark: SparkSession, n_accounts: int, seed: int = 42) -> DataFrame:
    """merchant_id, category, country, risk_tier."""
    rows = _range(spark, pools(n_accounts)["merchants"], "mch_", 5)
    tier = F.when(stable_float(F.col("number"), f"{seed}|tier") < MEDIUM_SHARE, "medium").otherwise("low")
    return rows.select(F.col("id").alias("merchant_id"), pick(CATEGORIES, F.col("number"), f"{seed}|category").alias("category"), F.lit(COUNTRY).alias("country"), tier.alias("risk_tier"))
