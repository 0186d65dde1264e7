"""Ledger enrichment: every choice is a hash of the account or the transaction, so partitions don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import halves, modulo, pick, slice_ratio, stable_float, stable_int, trailing_number

# Shares of pooled entities, chances of switching, ring reuse, status model.
SHARED_DEVICE, SHARED_INSTRUMENT, OTHER_DEVICE, OTHER_INSTRUMENT, PREFERRED = 0.12, 0.08, 0.06, 0.04, 0.82
REUSE = {"device": 0.15, "ip": 0.20, "instrument": 0.12}
DECLINED, DECLINED_RISE, PENDING, LARGE = 0.02, 0.03, 0.03, 50_000.0
INSTRUMENT_TYPES = ["card", "upi", "netbanking", "wallet"]


def pools(n_accounts: int) -> dict[str, int]:
    return {"merchants": max(50, n_accounts // 25), "devices": max(4, n_accounts // 30), "instruments": max(4, n_accounts // 22), "ips": max(8, n_accounts // 2)}


def first_patterns(ring_members: DataFrame) -> DataFrame:
    """account_id, pattern_id: the smallest pattern of each account."""
    return ring_members.groupBy("account_id").agg(F.min("pattern_id").alias("pattern_id"))


def account_patterns(ring_members: DataFrame) -> DataFrame:
    """account_id, patterns: sorted distinct patterns, joined by |."""
    return ring_members.groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_set("pattern_id")), "|").alias("patterns"))


def ring_profiles(patterns: DataFrame, n_accounts: int, seed: int = 42) -> DataFrame:
    """What a ring shares, and how likely its members use it, by hash of the pattern."""
    p = F.col("pattern_id")
    chance = lambda name, low, width: (F.lit(low) + width * stable_float(p, f"{seed}-p-{name}")).alias(f"p_{name}")
    idx = [modulo(stable_int(p, f"{seed}-ring-mch-{k}"), pools(n_accounts)["merchants"]) for k in range(3)]
    return patterns.select(
        "pattern_id",
        F.concat(F.lit("dev_ring_"), p).alias("ring_device"),
        F.concat(F.lit("ip_ring_"), p).alias("ring_ip"),
        F.when(stable_float(p, f"{seed}-has-ins") < 0.5, F.concat(F.lit("ins_ring_"), p)).alias("ring_instrument"),
        F.array(*idx).alias("ring_merchants"),
        chance("device", 0.2, 0.5), chance("ip", 0.3, 0.5), chance("instrument", 0.1, 0.4), chance("merchant", 0.2, 0.6),
    )


def assignments(accounts: DataFrame, n_accounts: int, profiles: DataFrame | None = None, patterns: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """account_id with device, instrument, IP and its preferred and alternate merchant; ring members may adopt what their ring shares."""
    a, n = F.col("account_id"), pools(n_accounts)
    number = trailing_number(a)
    pooled = lambda prefix, size: F.concat(F.lit(prefix), F.lpad((number % size).cast("string"), 4, "0"))
    own = lambda prefix: F.concat(F.lit(prefix), F.lpad((number % max(1, n_accounts)).cast("string"), 6, "0"))
    preferred = modulo(stable_int(a, f"{seed}-pref-mch"), n["merchants"])
    step = 1 + modulo(stable_int(a, f"{seed}-alt-mch"), max(1, n["merchants"] - 1))
    out = accounts.select(
        "account_id",
        F.when(stable_float(a, f"{seed}-share-dev") < SHARED_DEVICE, pooled("dev_s", n["devices"])).otherwise(own("dev_")).alias("device_id"),
        F.when(stable_float(a, f"{seed}-share-ins") < SHARED_INSTRUMENT, pooled("ins_s", n["instruments"])).otherwise(own("ins_")).alias("payment_instrument_id"),
        F.concat(F.lit("ip_"), modulo(stable_int(a, f"{seed}-pick-ip"), n["ips"])).alias("ip_address"),
        preferred.alias("preferred_merchant"),
        ((preferred + step) % n["merchants"]).alias("alternate_merchant"),
    )
    if profiles is None or patterns is None:
        return out
    ringed = out.join(patterns.join(profiles.hint("merge"), "pattern_id").hint("merge"), "account_id", "left")

    def adopt(name: str, salt: str, ring: str, column: str) -> Column:
        chosen = stable_float(a, F.concat(F.lit(f"{seed}-adopt-{salt}|"), "pattern_id")) < F.col(f"p_{name}")
        return F.when(F.col(ring).isNotNull() & chosen, F.col(ring)).otherwise(F.col(column)).alias(column)

    return ringed.select("account_id", adopt("device", "dev", "ring_device", "device_id"), adopt("instrument", "inst", "ring_instrument", "payment_instrument_id"), adopt("ip", "ip", "ring_ip", "ip_address"), "preferred_merchant", "alternate_merchant")


def link_type(entity: Column) -> Column:
    return F.when(entity.rlike("^(dev|ins|ip)_ring_"), "ring_shared").when(entity.rlike("^(dev|ins)_s"), "shared_pool").otherwise("primary")


def enrich(raw: DataFrame, accounts: DataFrame, assigned: DataFrame, n_accounts: int, profiles: DataFrame, patterns: DataFrame) -> DataFrame:
    """Raw transactions (tx_id, src_id, dst_id, amount, timestamp) with the observable columns of the ledger. Stateless: works on streams too."""
    n, r = pools(n_accounts), F.col("r")
    ringed = assigned.join(accounts.select("account_id", "creation_date"), "account_id").join(patterns.join(profiles.hint("merge"), "pattern_id").hint("merge"), "account_id", "left").withColumnRenamed("account_id", "src_id")
    rows = raw.join(ringed.hint("merge"), "src_id", "left").withColumn("r", halves(F.coalesce("tx_id", F.lit("")), "tx"))
    hashed = stable_int(F.coalesce("tx_id", F.lit("")), "tx")
    spare = lambda prefix, size: F.concat(F.lit(prefix), F.lpad(modulo(hashed, size).cast("string"), 4, "0"))
    uses = lambda name, shift: slice_ratio(r, shift, 8) < F.col(f"p_{name}") * 0.6 + REUSE[name]
    merchant = F.when(slice_ratio(r, 32, 16) < PREFERRED, F.col("preferred_merchant")).otherwise(F.col("alternate_merchant"))
    ring_merchant = F.element_at("ring_merchants", (modulo(stable_int(F.col("tx_id"), "ring-mch"), 3) + 1).cast("int"))
    merchant = F.when(slice_ratio(r, 27, 8) < F.col("p_merchant"), ring_merchant).otherwise(merchant)
    instrument = F.when(slice_ratio(r, 16, 16) < OTHER_INSTRUMENT, spare("ins_s", n["instruments"])).otherwise(F.col("payment_instrument_id"))
    rows = rows.withColumn("instrument", F.when(F.col("ring_instrument").isNotNull() & uses("instrument", 19), F.col("ring_instrument")).otherwise(instrument))
    device = F.when(slice_ratio(r, 0, 16) < OTHER_DEVICE, spare("dev_s", n["devices"])).otherwise(F.col("device_id"))
    amount = F.bround(F.col("amount").cast("double"), 2)
    declined = DECLINED + DECLINED_RISE * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(amount) / F.log1p(F.lit(LARGE))))
    chance = slice_ratio(r, 48, 16)
    age = F.floor((F.unix_timestamp("timestamp") - F.unix_timestamp(F.col("creation_date").cast("timestamp"))) / 86400)
    return rows.select(
        F.col("tx_id").alias("transaction_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        amount.alias("amount"),
        F.col("src_id").alias("src_account_id"),
        F.col("dst_id").alias("dst_account_id"),
        F.concat(F.lit("mch_"), F.lpad(merchant.cast("string"), 5, "0")).alias("merchant_id"),
        F.when(uses("device", 3), F.col("ring_device")).otherwise(device).alias("device_id"),
        F.col("instrument").alias("payment_instrument_id"),
        F.when(uses("ip", 11), F.col("ring_ip")).otherwise(F.col("ip_address")).alias("ip_address"),
        F.coalesce(pick(INSTRUMENT_TYPES, F.col("instrument"), "ins-type"), F.lit("card")).alias("payment_method"),
        F.greatest(F.lit(0), age).cast("long").alias("account_age_days"),
        F.when(chance < declined, "declined").when(chance < declined + PENDING, "pending").otherwise("settled").alias("transaction_status"),
    )


def attach_labels(ledger: DataFrame, patterns: DataFrame) -> DataFrame:
    """ledger with pattern_id ('' for none; both sides' patterns, sorted, if they differ) and is_ring_member, for evaluation only."""
    side = lambda name: patterns.select(F.col("account_id").alias(f"{name}_account_id"), F.col("patterns").alias(name))
    both = ledger.join(side("src").hint("merge"), "src_account_id", "left").join(side("dst").hint("merge"), "dst_account_id", "left")
    parts = lambda c: F.coalesce(F.split(F.col(c), r"\|"), F.expr("array()").cast("array<string>"))
    merged = F.array_join(F.array_sort(F.array_union(parts("src"), parts("dst"))), "|")
    return both.withColumn("pattern_id", merged).withColumn("is_ring_member", F.col("pattern_id") != "").drop("src", "dst")


def summary(**tables: DataFrame) -> DataFrame:
    """table_name, row_count."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
