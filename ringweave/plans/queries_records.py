"""Queries on attributes, the audit log and limits by file row, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import attributes, audit, catalogs, enrich
from ..operators.stored import shared_dir
from ..sources.io import first_rows
from .network import Network, h, sql
from .queries_graph import TWO_64, ledger_of, once

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, body: str, ctes: str = ""):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Network(spark, sf_dir))
        ORACLES[name] = sql(body, ctes)
        return f

    return keep


def as_text(rows: DataFrame) -> DataFrame:
    """Attributes as name=value;name=value, by name."""
    return rows.withColumn("attrs", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


# --- attributes ---------------------------------------------------------------

_WHEN = "'timestamp=' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')"
_NODE_ATTRS = f"""named AS (
  SELECT account_id AS id, 'Account' AS type, 0 AS priority, concat_ws(';', 'creation_date=' || creation_date, 'customer_name=' || customer_name) AS attrs FROM accounts
  UNION ALL SELECT merchant_id, 'Merchant', 1, concat_ws(';', 'category=' || category, 'name=' || name) FROM merchants
  UNION ALL SELECT entity_id, CASE kind WHEN 'devices' THEN 'Device' WHEN 'ips' THEN 'IPAddress' ELSE 'PaymentInstrument' END, 2, '' FROM links
  UNION ALL SELECT transaction_id, 'Transaction', 3, concat_ws(';', 'payment_method=' || payment_method, {_WHEN}, 'transaction_status=' || transaction_status) FROM tx
  UNION ALL SELECT src_account_id, 'Account', 4, '' FROM tx UNION ALL SELECT dst_account_id, 'Account', 4, '' FROM tx
  UNION ALL SELECT merchant_id, 'Merchant', 4, '' FROM tx WHERE merchant_id IS NOT NULL)"""


@register("node_attributes", "SELECT id, arg_min(type, priority) AS type, arg_min(attrs, priority) AS attrs FROM named GROUP BY id", _NODE_ATTRS)
def node_attributes(net: Network) -> DataFrame:
    return as_text(attributes.nodes(net.accounts, net.merchants, net.links, ledger_of(net)))


@register("merchant_nodes", "SELECT id, arg_min(attrs, priority) AS attrs FROM named GROUP BY id HAVING arg_min(type, priority) = 'Merchant'", _NODE_ATTRS)
def merchant_nodes(net: Network) -> DataFrame:
    return as_text(attributes.of_type(attributes.nodes(net.accounts, net.merchants, net.links, ledger_of(net)), "Merchant")).select("id", "attrs")


@register(
    "edge_attributes",
    f"""SELECT account_id AS src, entity_id AS dst, CASE kind WHEN 'devices' THEN 'USES_DEVICE' WHEN 'ips' THEN 'USES_IP' ELSE 'USES_INSTRUMENT' END AS type, '' AS attrs FROM links
    UNION ALL SELECT transaction_id, src_account_id, 'FROM_ACCOUNT', {_WHEN} FROM tx UNION ALL SELECT transaction_id, dst_account_id, 'TO_ACCOUNT', {_WHEN} FROM tx
    UNION ALL SELECT transaction_id, merchant_id, 'AT_MERCHANT', {_WHEN} FROM tx WHERE merchant_id IS NOT NULL
    UNION ALL SELECT src_account_id, merchant_id, 'PAYS', concat_ws(';', 'payment_method=' || arg_max(payment_method, (timestamp, transaction_id)), 'timestamp=' || strftime(max(timestamp), '%Y-%m-%d %H:%M:%S'),
      'transaction_status=' || arg_max(transaction_status, (timestamp, transaction_id))) FROM tx WHERE merchant_id IS NOT NULL GROUP BY src_account_id, merchant_id""",
)
def edge_attributes(net: Network) -> DataFrame:
    return as_text(attributes.edges(net.links, ledger_of(net)))


# --- catalogs -------------------------------------------------------------------


def _sql_pick(values: list[str], key: str, salt: str) -> str:
    return f"({values})[({h(key, salt)} % {len(values)}::UBIGINT)::INTEGER + 1]"


def _sql_digits(salt: str, n: int, add: int, width: int) -> str:
    return f"lpad((({h('key', salt)} % {n}::UBIGINT)::BIGINT + {add})::VARCHAR, {width}, '0')"


_MOBILE = "CASE WHEN os LIKE 'android%' OR os LIKE 'ios%' THEN 'mobile' ELSE 'desktop' END"
_CATALOGS = f"""pats AS (SELECT DISTINCT pattern_id FROM ring_members),
personal AS (SELECT unnest(range(n))::VARCHAR AS i FROM sizes),
dev AS (SELECT 'dev_' || lpad(i, 6, '0') AS id, {_sql_pick(catalogs.OS, "i", "42|dev-os")} AS os, NULL AS kind, '2023-01-01' AS seen FROM personal
  UNION ALL SELECT 'dev_s' || lpad(i, 4, '0'), {_sql_pick(catalogs.OS, "i", "42|sdev-os")}, NULL, '2023-01-01' FROM (SELECT unnest(range(greatest(4, n // 30)))::VARCHAR AS i FROM sizes)
  UNION ALL SELECT 'dev_ring_' || pattern_id, {_sql_pick(catalogs.OS, "pattern_id", "42|rdev-os")}, 'mobile', '2023-06-01' FROM pats),
keyed AS (SELECT 'ins_' || lpad(i, 6, '0') AS id, 'personal|' || i AS key FROM personal
  UNION ALL SELECT 'ins_s' || lpad(i, 4, '0'), 'shared|' || i FROM (SELECT unnest(range(greatest(4, n // 22)))::VARCHAR AS i FROM sizes)
  UNION ALL SELECT 'ins_ring_' || pattern_id, 'ring|' || pattern_id FROM pats WHERE {h("pattern_id", "42-has-ins")}::DOUBLE / {TWO_64} < 0.5),
ins AS (SELECT id, key, {_sql_pick(catalogs.TYPES, "key", "42-itype")} AS t FROM keyed),
pool AS (SELECT 'ip_' || unnest(range(greatest(8, n // 2))) AS id FROM sizes),
mch AS (SELECT unnest(range(greatest(50, n // 25)))::VARCHAR AS i FROM sizes)"""


@register(
    "catalog_attributes",
    f"""SELECT 'device' AS catalog, id, concat_ws(';', 'device_type=' || coalesce(kind, {_MOBILE}), 'first_seen=' || seen, 'os=' || os) AS attrs FROM dev
    UNION ALL SELECT 'instrument', id, concat_ws(';', 'expiry=' || {_sql_digits("42-expm", 12, 1, 2)} || '/' || {_sql_digits("42-expy", 4, 2027, 4)}, 'instrument_type=' || t, 'last4=' || {_sql_digits("42-last4", 10_000, 0, 4)},
      'network=' || CASE t WHEN 'card' THEN {_sql_pick(catalogs.NETWORKS, "key", "42-net")} WHEN 'upi' THEN 'upi' WHEN 'wallet' THEN 'wallet-provider' ELSE 'bank-transfer' END) FROM ins
    UNION ALL SELECT 'ip', id, concat_ws(';', 'country=IN', 'is_mobile_isp=' || ({h("id", "42-mob")}::DOUBLE / {TWO_64} < 0.35), 'isp=' || {_sql_pick(catalogs.ISPS, "id", "42-isp")}) FROM pool
    UNION ALL SELECT 'ip', 'ip_ring_' || pattern_id, concat_ws(';', 'country=IN', 'is_mobile_isp=false', 'isp=' || {_sql_pick(catalogs.ISPS, "pattern_id", "42-rip")}) FROM pats
    UNION ALL SELECT 'merchant', 'mch_' || lpad(i, 5, '0'), concat_ws(';', 'category=' || {_sql_pick(catalogs.CATEGORIES, "i", "42|category")}, 'country=IN', 'risk_tier=' || CASE WHEN {h("i", "42|tier")}::DOUBLE / {TWO_64} < 0.12 THEN 'medium' ELSE 'low' END) FROM mch""",
    _CATALOGS,
)
def catalog_attributes(net: Network) -> DataFrame:
    profiles = enrich.ring_profiles(net.rings.select("pattern_id"), net.n)
    made = {
        "device": catalogs.devices(net.spark, net.n, profiles), "instrument": catalogs.instruments(net.spark, net.n, profiles),
        "ip": catalogs.addresses(net.spark, net.n, profiles), "merchant": catalogs.merchants(net.spark, net.n),
    }
    out = None
    for kind, rows in made.items():
        id_, *names = rows.columns
        one = rows.select(F.lit(kind).alias("catalog"), F.col(id_).alias("id"), attributes.attributes(**{c: F.col(c) for c in names}).alias("attrs"))
        out = one if out is None else out.unionByName(one)
    return as_text(out)


# --- the audit log ----------------------------------------------------------------

_STATES = """states AS (SELECT 'case_' || src_account_id AS case_id, timestamp AS ts, row_seq AS seq, transaction_status AS status, payment_method AS notes, 'ACCOUNT:' || lower(dst_account_id) AS target FROM tx),
lagged AS (SELECT *, lag(status) OVER w AS status0, lag(notes) OVER w AS notes0, lag(target) OVER w AS target0, row_number() OVER w AS place, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, seq DESC) AS back
  FROM states WINDOW w AS (PARTITION BY case_id ORDER BY ts, seq)),
log AS (SELECT case_id, ts, seq, 'CASE_CREATED' AS event_type, NULL::VARCHAR AS field, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM lagged WHERE place = 1
  UNION ALL SELECT case_id, ts, seq, 'STATUS_CHANGED', 'status', status0, status FROM lagged WHERE status IS DISTINCT FROM status0
  UNION ALL SELECT case_id, ts, seq, 'NOTES_UPDATED', 'notes', notes0, notes FROM lagged WHERE notes IS DISTINCT FROM notes0
  UNION ALL SELECT case_id, ts, seq, 'TARGET_ADDED', 'targets', NULL, target FROM lagged WHERE target IS DISTINCT FROM target0
  UNION ALL SELECT case_id, ts, seq, 'TARGET_REMOVED', 'targets', target0, NULL FROM lagged WHERE target0 IS NOT NULL AND target IS DISTINCT FROM target0)"""


def events_of(net: Network) -> DataFrame:
    """A case for each sending account, whose transactions are its successive states."""
    target = F.array(F.struct(F.lit("ACCOUNT").alias("type"), F.col("dst_account_id").alias("id")))
    states = ledger_of(net).select(F.concat(F.lit("case_"), "src_account_id").alias("case_id"), F.col("timestamp").alias("ts"), F.col("row_seq").alias("seq"), F.col("transaction_status").alias("status"), F.col("payment_method").alias("notes"), target.alias("targets"))
    return audit.changes(states)


@register("case_events", "SELECT * FROM log", _STATES)
def case_events(net: Network) -> DataFrame:
    return events_of(net).drop("event_id")


@register(
    "case_present",
    "SELECT case_id, status, notes, target AS targets, n AS events FROM lagged JOIN (SELECT case_id, count(*)::BIGINT AS n FROM log GROUP BY case_id) USING (case_id) WHERE back = 1",
    _STATES,
)
def case_present(net: Network) -> DataFrame:
    """The state of each case, rebuilt from its events only, which are appended in two batches that overlap."""
    log, events = f"{shared_dir(net.spark)}/case-log-{uuid.uuid4().hex}", once(net, "case-events", lambda: events_of(net))
    audit.append(log, events.filter("ts < '2024-02-10'"))
    whole = audit.append(log, events.filter("ts >= '2024-01-20'"))
    return audit.present(whole, ["status", "notes"]).withColumn("targets", F.array_join("targets", ","))


# --- limits -------------------------------------------------------------------------


@register("first_transactions", "SELECT 'tx_' || o_orderkey AS transaction_id, o_totalprice AS amount FROM (SELECT * FROM orders LIMIT 1000)")
def first_transactions(net: Network) -> DataFrame:
    """The first 1 000 transactions of the file, in its own order."""
    return first_rows(net.read("orders").select("o_orderkey", "o_totalprice", "_metadata"), 1000).select(F.concat(F.lit("tx_"), "o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"))
