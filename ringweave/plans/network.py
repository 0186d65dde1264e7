"""The payment network that the driver's tables stand for, in Spark and in SQL.

Customers are accounts, orders are transactions, suppliers are merchants; hashes
of the customer key deal out devices, instruments and IP addresses. Rings are
runs of ten accounts, and an account's community is its key modulo the number of
communities, so that SQL can give the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import modulo, stable_float, stable_int

METHODS = {"1": "card", "2": "upi", "3": "netbanking", "4": "wallet", "5": "card"}
STATUSES = {"F": "settled", "O": "pending", "P": "declined"}


@dataclass
class Network:
    spark: SparkSession
    sf_dir: str

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def n(self) -> int:
        return self.read("customer").count()

    @property
    def communities(self) -> int:
        return max(4, self.n // 30)

    @cached_property
    def accounts(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(
            F.concat(F.lit("acc_"), k).alias("account_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_acctbal").alias("balance"),
            ((k % 100) / F.lit(100.0)).alias("risk_score"),
            F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int")).alias("creation_date"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(F.concat(F.lit("acc_"), k).alias("account_id"), (k % self.communities).cast("long").alias("community_id"))

    @cached_property
    def raw(self) -> DataFrame:
        return self.raw_of(self.read("orders"))

    def raw_of(self, orders: DataFrame, *also: Column) -> DataFrame:
        """tx_id, row_seq, src_id, dst_id, amount, timestamp of orders, which may be a stream; and other columns of theirs."""
        o, c, p = F.col("o_orderkey"), F.col("o_custkey"), self.communities
        seconds = (o % 60) * 86400 + (o * 7919) % (3600 * (1 + (c % p) % 6))
        return orders.select(
            F.concat(F.lit("tx_"), o).alias("tx_id"),
            o.alias("row_seq"),
            F.concat(F.lit("acc_"), c).alias("src_id"),
            F.concat(F.lit("acc_"), (c + p * (o % 7) + o % 3) % self.n).alias("dst_id"),
            F.col("o_totalprice").alias("amount"),
            F.timestamp_seconds(F.lit(1704067200) + seconds).alias("timestamp"),
            F.col("o_orderstatus").alias("status_code"),
            F.substring("o_orderpriority", 1, 1).alias("priority"),
            *also,
        )

    @cached_property
    def transactions(self) -> DataFrame:
        """The ledger: transaction_id, row_seq, timestamp, amount, both accounts, merchant_id, payment_method, transaction_status."""
        # numbers are joined, and names made of them afterwards
        merchant = self.read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"))
        orders = self.read("orders").join(merchant, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        named = lambda c, values: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in values.items()))
        return self.raw_of(orders, F.concat(F.lit("mch_"), "suppkey").alias("merchant_id")).select(
            F.col("tx_id").alias("transaction_id"), "row_seq", "timestamp", "amount", F.col("src_id").alias("src_account_id"), F.col("dst_id").alias("dst_account_id"), "merchant_id",
            named("priority", METHODS).alias("payment_method"), named("status_code", STATUSES).alias("transaction_status"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        return self.read("supplier").select(F.concat(F.lit("mch_"), "s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"), F.concat(F.lit("cat_"), "s_nationkey").alias("category"))

    @cached_property
    def links(self) -> DataFrame:
        """kind, account_id, entity_id: the device, instrument and IP address of each account."""
        k, p = F.col("c_custkey"), self.communities
        key = F.concat(F.lit("acc_"), k)
        device = F.when(stable_float(key, "42-share-dev") < 0.12, F.concat(F.lit("dev_s"), k % p)).otherwise(F.concat(F.lit("dev_"), k))
        instrument = F.when(stable_float(key, "42-share-ins") < 0.08, F.concat(F.lit("ins_s"), k % p)).otherwise(F.concat(F.lit("ins_"), k))
        ip = F.when(k % 4 == 0, F.concat(F.lit("ip_s"), k % p)).otherwise(F.concat(F.lit("ip_"), modulo(stable_int(key, "42-pick-ip"), max(8, self.n // 2))))
        kinds = F.array(*(F.struct(F.lit(n).alias("kind"), c.alias("entity_id")) for n, c in (("devices", device), ("instruments", instrument), ("ips", ip))))
        # keys are a small file, which few tasks read, and hashes take time
        return self.read("customer").select("c_custkey").repartition("c_custkey").select(key.alias("account_id"), F.explode(kinds).alias("x")).select("x.kind", "account_id", "x.entity_id")

    @cached_property
    def rings(self) -> DataFrame:
        """pattern_id, ring_order, involved_accounts: ring i has the accounts 50i to 50i + 9."""
        k = F.col("c_custkey")
        ring = F.floor(k / 50).cast("long")
        members = self.read("customer").filter(k % 50 < 10).groupBy(ring.alias("ring_order")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(k)), lambda x: F.concat(F.lit("acc_"), x)), "|").alias("involved_accounts"))
        return members.select(F.concat(F.lit("pat_"), "ring_order").alias("pattern_id"), "ring_order", "involved_accounts")


H = "('0x' || substr(sha256({salt} || '|' || {key}), 1, 16))::UBIGINT"


def h(key: str, salt: str) -> str:
    return H.format(salt=f"'{salt}'", key=key)


#: The same tables as common table expressions; queries add theirs and a SELECT.
SQL = f"""
sizes AS (SELECT count(*)::BIGINT AS n, greatest(4, count(*) // 30)::BIGINT AS p FROM customer),
accounts AS (SELECT 'acc_' || c_custkey AS account_id, c_custkey AS k, c_name AS customer_name, c_acctbal AS balance, (c_custkey % 100) / 100.0::DOUBLE AS risk_score, DATE '2023-01-01' + (c_custkey % 365)::INTEGER AS creation_date FROM customer),
membership AS (SELECT 'acc_' || c_custkey AS account_id, (c_custkey % p)::BIGINT AS community_id FROM customer, sizes),
merchant_of AS (SELECT l_orderkey, 'mch_' || min(l_suppkey) AS merchant_id FROM lineitem GROUP BY l_orderkey),
tx AS (SELECT 'tx_' || o_orderkey AS transaction_id, o_orderkey AS row_seq,
         TIMESTAMP '2024-01-01' + to_seconds((o_orderkey % 60) * 86400 + (o_orderkey * 7919) % (3600 * (1 + (o_custkey % p) % 6))) AS timestamp,
         o_totalprice AS amount, 'acc_' || o_custkey AS src_account_id, 'acc_' || ((o_custkey + p * (o_orderkey % 7) + o_orderkey % 3) % n) AS dst_account_id, merchant_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'card' WHEN '2' THEN 'upi' WHEN '3' THEN 'netbanking' WHEN '4' THEN 'wallet' WHEN '5' THEN 'card' END AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'declined' END AS transaction_status
       FROM orders CROSS JOIN sizes LEFT JOIN merchant_of ON o_orderkey = l_orderkey),
merchants AS (SELECT 'mch_' || s_suppkey AS merchant_id, s_name AS name, 'cat_' || s_nationkey AS category FROM supplier),
links AS (
  SELECT 'devices' AS kind, account_id, CASE WHEN {h("account_id", "42-share-dev")}::DOUBLE / 18446744073709551616.0::DOUBLE < 0.12 THEN 'dev_s' || (k % p) ELSE 'dev_' || k END AS entity_id FROM accounts, sizes
  UNION ALL SELECT 'instruments', account_id, CASE WHEN {h("account_id", "42-share-ins")}::DOUBLE / 18446744073709551616.0::DOUBLE < 0.08 THEN 'ins_s' || (k % p) ELSE 'ins_' || k END FROM accounts, sizes
  UNION ALL SELECT 'ips', account_id, CASE WHEN k % 4 = 0 THEN 'ip_s' || (k % p) ELSE 'ip_' || ({h("account_id", "42-pick-ip")} % greatest(8, n // 2)::UBIGINT) END FROM accounts, sizes),
ring_members AS (SELECT c_custkey // 50 AS ring_order, 'pat_' || (c_custkey // 50) AS pattern_id, 'acc_' || c_custkey AS account_id FROM customer WHERE c_custkey % 50 < 10),
parties AS (SELECT transaction_id, timestamp, merchant_id, unnest([src_account_id, dst_account_id]) AS account_id FROM tx),
days AS (SELECT account_id, list(DISTINCT timestamp::DATE) AS days FROM parties GROUP BY account_id),
shared AS (
  SELECT a.account_id AS src, b.account_id AS dst, a.kind, a.entity_id FROM links a JOIN links b ON a.kind = b.kind AND a.entity_id = b.entity_id AND a.account_id < b.account_id
  UNION SELECT a.account_id, b.account_id, 'merchants', a.merchant_id FROM (SELECT DISTINCT merchant_id, timestamp::DATE AS d, account_id FROM parties WHERE merchant_id IS NOT NULL) a
        JOIN (SELECT DISTINCT merchant_id, timestamp::DATE AS d, account_id FROM parties WHERE merchant_id IS NOT NULL) b ON a.merchant_id = b.merchant_id AND a.d = b.d AND a.account_id < b.account_id),
kinds AS (SELECT src, dst, coalesce(list(DISTINCT entity_id ORDER BY entity_id) FILTER (kind = 'instruments'), []) AS instruments, coalesce(list(DISTINCT entity_id ORDER BY entity_id) FILTER (kind = 'devices'), []) AS devices,
            coalesce(list(DISTINCT entity_id ORDER BY entity_id) FILTER (kind = 'ips'), []) AS ips, coalesce(list(DISTINCT entity_id ORDER BY entity_id) FILTER (kind = 'merchants'), []) AS merchants FROM shared GROUP BY src, dst),
overlapped AS (SELECT kinds.*, coalesce(len(list_intersect(x.days, y.days)), 0)::INTEGER AS temporal_overlap FROM kinds LEFT JOIN days x ON src = x.account_id LEFT JOIN days y ON dst = y.account_id),
edges AS (SELECT *, round_even((4.0::DOUBLE * sqrt(len(instruments)) + 3.0::DOUBLE * sqrt(len(devices)) + 2.0::DOUBLE * sqrt(len(merchants)) + 1.0::DOUBLE * sqrt(len(ips))) * CASE WHEN temporal_overlap <= 0 THEN 1.0::DOUBLE ELSE least(2.0::DOUBLE, 1 + 0.25::DOUBLE * temporal_overlap) END, 6) AS weight FROM overlapped),
inside AS (SELECT e.*, a.community_id FROM edges e JOIN membership a ON src = a.account_id JOIN membership b ON dst = b.account_id AND a.community_id = b.community_id),
mirrored AS (SELECT community_id, src AS account_id, dst AS peer, weight, temporal_overlap, instruments, devices, ips, merchants FROM inside UNION ALL SELECT community_id, dst, src, weight, temporal_overlap, instruments, devices, ips, merchants FROM inside),
member_tx AS (SELECT DISTINCT community_id, tx.* FROM (SELECT transaction_id, unnest([src_account_id, dst_account_id]) AS account_id FROM tx) x JOIN membership USING (account_id) JOIN tx USING (transaction_id))
"""


def sql(body: str, ctes: str = "") -> str:
    return f"WITH {SQL}{',' if ctes else ''}{ctes} {body}"
