"""Queries on enrichment, the graph, communities, features, labels and evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hashing
from ..operators import communities, enrich, evidence, features, graph, incidence, labels
from .network import Network, h, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TWO_64 = "18446744073709551616.0::DOUBLE"


def register(name: str, body: str | None = None, ctes: str = ""):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Network(spark, sf_dir))
        if body:
            ORACLES[name] = sql(body, ctes)
        return f

    return keep


def r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def edges_of(net: Network) -> DataFrame:
    return graph.project(net.accounts, net.links, ledger_of(net))


def weights_of(net: Network) -> DataFrame:
    return graph.weights(net.accounts, net.links, ledger_of(net))


def once(net: Network, name: str, make) -> DataFrame:
    """A table that several parts of a query read: written when first asked for."""
    kept = net.__dict__.setdefault("_kept", {})
    if name not in kept:
        kept[name] = communities.cut(make(), name)
    return kept[name]


def ledger_of(net: Network) -> DataFrame:
    """The ledger, joined once for queries that read it several times."""
    return once(net, "ledger", lambda: net.transactions)


def inside_of(net: Network) -> DataFrame:
    return once(net, "inside", lambda: graph.project(net.accounts, net.links, ledger_of(net), net.membership))


def incidence_of(net: Network, inside: bool = False) -> DataFrame:
    """Accounts by what they share, of the whole network or of each community."""
    return incidence.memberships(net.accounts, net.links, ledger_of(net), net.membership if inside else None)


def features_of(net: Network, *only: str) -> DataFrame:
    """The feature matrix, or those features that are asked for."""
    rows = member_times_of(net) if "total_transaction_amount" in only else None
    return once(net, "-".join(("features", *only)), lambda: features.community_features(net.membership, inside_of(net), ledger_of(net), net.merchants, only or None, rows))


def member_times_of(net: Network) -> DataFrame:
    """When the members of each community moved money, and how much: each transaction once for a community."""
    return once(net, "member-times", lambda: features.member_transactions(net.membership, ledger_of(net).select("transaction_id", "timestamp", "amount", "src_account_id", "dst_account_id")).drop("src_account_id", "dst_account_id"))


def member_rows_of(net: Network) -> DataFrame:
    """The transactions of each community's members, once for each community."""
    return once(net, "member-rows", lambda: features.member_transactions(net.membership, ledger_of(net)))


def bursts_of(net: Network) -> DataFrame:
    rows = member_rows_of(net).select("community_id", "timestamp", "transaction_id")
    return once(net, "bursts", lambda: evidence.bursts(rows, "community_id", "COMMUNITY"))


def labels_of(net: Network) -> DataFrame:
    return labels.community_labels(net.membership, labels.ring_members(net.rings))


def items_of(net: Network) -> DataFrame:
    """Evidence on communities for queries that read it once: not stored, and what isn't asked for isn't made. An item may be there twice."""
    return evidence.community_items(net.membership, inside_of(net), ledger_of(net), features_of(net, *evidence.DENSITY), member_times_of(net))


def evidence_of(net: Network) -> DataFrame:
    return once(net, "evidence", lambda: evidence.distinct_items(items_of(net)))


# --- hashes and enrichment -------------------------------------------------


@register(
    "hash_assign",
    f"""SELECT account_id, device_id, payment_instrument_id, ip_address, pref AS preferred_merchant, (pref + 1 + ({h("account_id", "42-alt-mch")} % (m - 1)::UBIGINT)::BIGINT) % m AS alternate_merchant, round(f, 9) AS share,
        link_type FROM (SELECT *, ({h("account_id", "42-pref-mch")} % m::UBIGINT)::BIGINT AS pref, CASE WHEN device_id LIKE 'dev_s%' THEN 'shared_pool' ELSE 'primary' END AS link_type FROM a)""",
    f"""b AS (SELECT account_id, k, n, greatest(50, n // 25)::BIGINT AS m, {h("account_id", "42-share-dev")}::DOUBLE / {TWO_64} AS f, {h("account_id", "42-share-ins")}::DOUBLE / {TWO_64} AS g FROM accounts, sizes),
    a AS (SELECT account_id, m, f, CASE WHEN f < 0.12 THEN 'dev_s' || lpad((k % greatest(4, n // 30))::VARCHAR, 4, '0') ELSE 'dev_' || lpad((k % n)::VARCHAR, 6, '0') END AS device_id,
      CASE WHEN g < 0.08 THEN 'ins_s' || lpad((k % greatest(4, n // 22))::VARCHAR, 4, '0') ELSE 'ins_' || lpad((k % n)::VARCHAR, 6, '0') END AS payment_instrument_id,
      'ip_' || ({h("account_id", "42-pick-ip")} % greatest(8, n // 2)::UBIGINT) AS ip_address FROM b)""",
)
def hash_assign(net: Network) -> DataFrame:
    out = enrich.assignments(net.accounts, net.n)
    return out.withColumn("share", F.round(hashing.stable_float(F.col("account_id"), "42-share-dev"), 9)).withColumn("link_type", enrich.link_type(F.col("device_id")))


def _enriched(net: Network) -> DataFrame:
    members = labels.ring_members(net.rings)
    patterns = enrich.first_patterns(members)
    profiles = enrich.ring_profiles(net.rings.select("pattern_id"), net.n)
    return enrich.enrich(net.raw, net.accounts, enrich.assignments(net.accounts, net.n, profiles, patterns), net.n, profiles, patterns)


_FLOAT = lambda key, salt: f"({h(key, salt)}::DOUBLE / {TWO_64})"
_ENRICH = f"""
prof AS (SELECT DISTINCT pattern_id, 'dev_ring_' || pattern_id AS rd, 'ip_ring_' || pattern_id AS ri, CASE WHEN {_FLOAT("pattern_id", "42-has-ins")} < 0.5 THEN 'ins_ring_' || pattern_id END AS rn,
  [{", ".join(f"({h('pattern_id', f'42-ring-mch-{k}')} % greatest(50, n // 25)::UBIGINT)::BIGINT" for k in range(3))}] AS rm,
  0.2::DOUBLE + 0.5::DOUBLE * {_FLOAT("pattern_id", "42-p-device")} AS pd, 0.3::DOUBLE + 0.5::DOUBLE * {_FLOAT("pattern_id", "42-p-ip")} AS pi, 0.1::DOUBLE + 0.4::DOUBLE * {_FLOAT("pattern_id", "42-p-instrument")} AS pn, 0.2::DOUBLE + 0.6::DOUBLE * {_FLOAT("pattern_id", "42-p-merchant")} AS pm FROM ring_members, sizes),
ofring AS (SELECT account_id, min(pattern_id) AS pattern_id FROM ring_members GROUP BY account_id),
base AS (SELECT a.account_id, a.creation_date, p.*, n,
  CASE WHEN rd IS NOT NULL AND ('0x' || substr(sha256('42-adopt-dev|' || p.pattern_id || '|' || a.account_id), 1, 16))::UBIGINT::DOUBLE / {TWO_64} < pd THEN rd WHEN {_FLOAT("a.account_id", "42-share-dev")} < 0.12 THEN 'dev_s' || lpad((k % greatest(4, n // 30))::VARCHAR, 4, '0') ELSE 'dev_' || lpad((k % n)::VARCHAR, 6, '0') END AS dev,
  CASE WHEN rn IS NOT NULL AND ('0x' || substr(sha256('42-adopt-inst|' || p.pattern_id || '|' || a.account_id), 1, 16))::UBIGINT::DOUBLE / {TWO_64} < pn THEN rn WHEN {_FLOAT("a.account_id", "42-share-ins")} < 0.08 THEN 'ins_s' || lpad((k % greatest(4, n // 22))::VARCHAR, 4, '0') ELSE 'ins_' || lpad((k % n)::VARCHAR, 6, '0') END AS ins,
  CASE WHEN ri IS NOT NULL AND ('0x' || substr(sha256('42-adopt-ip|' || p.pattern_id || '|' || a.account_id), 1, 16))::UBIGINT::DOUBLE / {TWO_64} < pi THEN ri ELSE 'ip_' || ({h("a.account_id", "42-pick-ip")} % greatest(8, n // 2)::UBIGINT) END AS ip,
  ({h("a.account_id", "42-pref-mch")} % greatest(50, n // 25)::UBIGINT)::BIGINT AS pref, ({h("a.account_id", "42-alt-mch")} % (greatest(50, n // 25) - 1)::UBIGINT)::BIGINT AS alt, greatest(50, n // 25)::BIGINT AS m
  FROM accounts a CROSS JOIN sizes LEFT JOIN ofring o ON a.account_id = o.account_id LEFT JOIN prof p ON o.pattern_id = p.pattern_id),
u AS (SELECT t.*, b.* EXCLUDE (account_id), {h("transaction_id", "tx")} AS u, round_even(amount, 2) AS amt FROM tx t LEFT JOIN base b ON src_account_id = b.account_id),
v AS (SELECT *, (u & 65535)::DOUBLE / 65536 AS r0, ((u >> 16) & 65535)::DOUBLE / 65536 AS r16, ((u >> 32) & 65535)::DOUBLE / 65536 AS r32, ((u >> 48) & 65535)::DOUBLE / 65536 AS r48,
  ((u >> 3) & 255)::DOUBLE / 256 AS b3, ((u >> 11) & 255)::DOUBLE / 256 AS b11, ((u >> 19) & 255)::DOUBLE / 256 AS b19, ((u >> 27) & 255)::DOUBLE / 256 AS b27 FROM u),
w AS (SELECT *, CASE WHEN rn IS NOT NULL AND b19 < pn * 0.6::DOUBLE + 0.12::DOUBLE THEN rn WHEN r16 < 0.04 THEN 'ins_s' || lpad((u % greatest(4, n // 22)::UBIGINT)::VARCHAR, 4, '0') ELSE ins END AS instrument,
  0.02::DOUBLE + 0.03::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ln(1 + amt) / ln(50001.0::DOUBLE))) AS pdec FROM v)"""


@register(
    "enrich_tx",
    f"""SELECT transaction_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, amt AS amount, src_account_id, dst_account_id,
      'mch_' || lpad((CASE WHEN b27 < pm THEN rm[({h("transaction_id", "ring-mch")} % 3::UBIGINT)::INTEGER + 1] WHEN r32 < 0.82 THEN pref ELSE (pref + 1 + alt) % m END)::VARCHAR, 5, '0') AS merchant_id,
      CASE WHEN b3 < pd * 0.6::DOUBLE + 0.15::DOUBLE THEN rd WHEN r0 < 0.06 THEN 'dev_s' || lpad((u % greatest(4, n // 30)::UBIGINT)::VARCHAR, 4, '0') ELSE dev END AS device_id, instrument AS payment_instrument_id,
      CASE WHEN b11 < pi * 0.6::DOUBLE + 0.2::DOUBLE THEN ri ELSE ip END AS ip_address, (['card', 'upi', 'netbanking', 'wallet'])[({h("instrument", "ins-type")} % 4::UBIGINT)::INTEGER + 1] AS payment_method,
      greatest(0, datediff('day', creation_date, timestamp::DATE))::BIGINT AS account_age_days, CASE WHEN r48 < pdec THEN 'declined' WHEN r48 < pdec + 0.03::DOUBLE THEN 'pending' ELSE 'settled' END AS transaction_status FROM w""",
    _ENRICH,
)
def enrich_tx(net: Network) -> DataFrame:
    return _enriched(net)


@register(
    "label_tx",
    """SELECT transaction_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a.p, []), coalesce(b.p, [])))), '|'), '') AS pattern_id, (a.p IS NOT NULL OR b.p IS NOT NULL) AS is_ring_member
       FROM tx LEFT JOIN lp a ON src_account_id = a.account_id LEFT JOIN lp b ON dst_account_id = b.account_id""",
    "lp AS (SELECT account_id, list(DISTINCT pattern_id) AS p FROM ring_members GROUP BY account_id)",
)
def label_tx(net: Network) -> DataFrame:
    out = enrich.attach_labels(net.transactions, enrich.account_patterns(labels.ring_members(net.rings)))
    return out.select("transaction_id", "pattern_id", "is_ring_member")


@register("pipeline_summary", "SELECT 'accounts' AS table_name, count(*)::BIGINT AS row_count FROM accounts UNION ALL SELECT 'transactions', count(*) FROM tx UNION ALL SELECT 'merchants', count(*) FROM merchants UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'ring_members', count(*) FROM ring_members")
def pipeline_summary(net: Network) -> DataFrame:
    return enrich.summary(accounts=net.accounts, transactions=net.transactions, merchants=net.merchants, links=net.links, ring_members=labels.ring_members(net.rings))


# --- graph ------------------------------------------------------------------

_NODES = """nodes AS (SELECT account_id AS id, 'Account' AS type FROM accounts UNION SELECT merchant_id, 'Merchant' FROM merchants UNION SELECT merchant_id, 'Merchant' FROM tx WHERE merchant_id IS NOT NULL
  UNION SELECT entity_id, CASE kind WHEN 'devices' THEN 'Device' WHEN 'ips' THEN 'IPAddress' ELSE 'PaymentInstrument' END FROM links UNION SELECT transaction_id, 'Transaction' FROM tx UNION SELECT dst_account_id, 'Account' FROM tx UNION SELECT src_account_id, 'Account' FROM tx),
typed AS (SELECT account_id AS src, entity_id AS dst, CASE kind WHEN 'devices' THEN 'USES_DEVICE' WHEN 'ips' THEN 'USES_IP' ELSE 'USES_INSTRUMENT' END AS type, NULL::TIMESTAMP AS timestamp FROM links
  UNION ALL SELECT transaction_id, src_account_id, 'FROM_ACCOUNT', timestamp FROM tx UNION ALL SELECT transaction_id, dst_account_id, 'TO_ACCOUNT', timestamp FROM tx UNION ALL SELECT transaction_id, merchant_id, 'AT_MERCHANT', timestamp FROM tx WHERE merchant_id IS NOT NULL)"""


@register("graph_nodes", "SELECT id, type FROM nodes", _NODES)
def graph_nodes(net: Network) -> DataFrame:
    return graph.typed_nodes(net.accounts, net.merchants, net.links, net.transactions)


@register("graph_edges", "SELECT src, dst, type, max(timestamp) AS timestamp FROM typed GROUP BY ALL", _NODES)
def graph_edges(net: Network) -> DataFrame:
    return graph.typed_edges(net.links, net.transactions)


@register("graph_counts", "SELECT 'node' AS part, type, count(*)::BIGINT AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM (SELECT DISTINCT src, dst, type FROM typed) GROUP BY type", _NODES)
def graph_counts(net: Network) -> DataFrame:
    return graph.counts_by_type(graph_nodes(net), graph_edges(net))


_EXPORT = "src, dst, weight, temporal_overlap, array_to_string(devices, '|') AS shared_devices, array_to_string(instruments, '|') AS shared_instruments, array_to_string(merchants, '|') AS shared_merchants, array_to_string(ips, '|') AS shared_ips"


@register("account_edges", f"SELECT {_EXPORT} FROM edges")
def account_edges(net: Network) -> DataFrame:
    return graph.exported(edges_of(net))


@register("top_edges", f"SELECT {_EXPORT} FROM edges ORDER BY weight DESC, src, dst LIMIT 50")
def top_edges(net: Network) -> DataFrame:
    return graph.exported(incidence.strongest(net.accounts, net.links, ledger_of(net), 50))


@register("pair_lookup", f"SELECT {_EXPORT} FROM edges JOIN (SELECT DISTINCT least(src_account_id, dst_account_id) AS src, greatest(src_account_id, dst_account_id) AS dst FROM tx) USING (src, dst)")
def pair_lookup(net: Network) -> DataFrame:
    """The links between accounts that paid each other, looked up without making the others."""
    pairs = ledger_of(net).select(F.col("src_account_id").alias("a"), F.col("dst_account_id").alias("b"))
    return graph.exported(incidence.of_pairs(pairs, net.accounts, net.links, ledger_of(net)))


_CLASSES = """daily AS (SELECT DISTINCT merchant_id, timestamp::DATE AS day, account_id FROM parties WHERE merchant_id IS NOT NULL),
classes AS (SELECT kind, entity_id, NULL::DATE AS day, count(DISTINCT account_id)::BIGINT AS members FROM links GROUP BY ALL HAVING members > 1
  UNION ALL SELECT 'merchants', merchant_id, day, count(*)::BIGINT AS members FROM daily GROUP BY ALL HAVING members > 1)"""


@register("class_sizes", "SELECT kind, entity_id, day, members, members * (members - 1) // 2 AS pairs FROM classes", _CLASSES)
def class_sizes(net: Network) -> DataFrame:
    return incidence.classes(incidence_of(net)).drop("class_id")


@register("account_degrees", "SELECT account_id, count(*)::BIGINT AS degree FROM (SELECT src AS account_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY account_id")
def account_degrees(net: Network) -> DataFrame:
    return incidence.degrees(incidence_of(net))


@register("community_edge_counts", "SELECT community_id, count(*)::BIGINT AS edges FROM inside GROUP BY community_id")
def community_edge_counts(net: Network) -> DataFrame:
    return incidence.edge_counts(incidence_of(net, inside=True))


@register("account_connections", "SELECT account_id, peer, weight, temporal_overlap, len(instruments)::INTEGER AS instruments, len(devices)::INTEGER AS devices, len(ips)::INTEGER AS ips, len(merchants)::INTEGER AS merchants FROM mirrored")
def account_connections(net: Network) -> DataFrame:
    return graph.mirrored(inside_of(net)).select("account_id", "peer", "weight", "temporal_overlap", *(F.size(k).alias(k) for k in ("instruments", "devices", "ips", "merchants")))


# --- communities, features, labels ------------------------------------------

_STATS = """times AS (SELECT DISTINCT community_id, timestamp FROM parties JOIN membership USING (account_id)),
gapped AS (SELECT *, epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY community_id ORDER BY timestamp)) / 1e6::DOUBLE / 3600 AS gap FROM times),
stats AS (SELECT community_id, count(*)::BIGINT AS tx_count, count(DISTINCT date_trunc('hour', timestamp))::BIGINT AS active_hours, min(timestamp) AS first_ts, max(timestamp) AS last_ts, median(gap) AS median_gap_hours, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE / 3600 AS span_hours FROM gapped GROUP BY community_id),
struct_ AS (SELECT community_id, m.member_count, coalesce(e.n, 0)::BIGINT AS internal_edges, round_even(coalesce(e.w, 0), 6) AS total_weight, CASE WHEN member_count < 2 THEN 0.0::DOUBLE ELSE round_even(coalesce(e.n, 0) / (member_count * (member_count - 1) / 2.0::DOUBLE), 6) END AS density
  FROM (SELECT community_id, count(*)::BIGINT AS member_count FROM membership GROUP BY 1) m LEFT JOIN (SELECT community_id, count(*) AS n, sum(weight) AS w FROM inside GROUP BY 1) e USING (community_id))"""


@register("activity_stats", "SELECT community_id, tx_count, active_hours, first_ts, last_ts, round(median_gap_hours, 6) AS median_gap_hours, round(span_hours, 6) AS span_hours, round(tx_count / (tx_count + span_hours), 6) AS compression FROM stats", _STATS)
def activity_stats(net: Network) -> DataFrame:
    return r(communities.activity_stats(net.membership, net.transactions)).select("community_id", "tx_count", "active_hours", "first_ts", "last_ts", "median_gap_hours", "span_hours", "compression")


@register("community_structure", "SELECT community_id, member_count, internal_edges, round(total_weight, 4) AS total_weight, density FROM struct_", _STATS)
def community_structure(net: Network) -> DataFrame:
    return communities.structure(net.membership, inside_of(net)).withColumn("total_weight", F.round("total_weight", 4))


@register(
    "community_summary",
    """SELECT 'size' AS metric, member_count::VARCHAR AS key, count(*)::DOUBLE AS value FROM struct_ GROUP BY member_count UNION ALL SELECT 'total', 'n', count(*) FROM struct_ UNION ALL SELECT 'total', 'two', count(*) FROM struct_ WHERE member_count >= 2
       UNION ALL SELECT 'total', 'three', count(*) FROM struct_ WHERE member_count >= 3 UNION ALL SELECT 'total', 'accounts', sum(member_count) FROM struct_
       UNION ALL SELECT * FROM (SELECT 'largest', community_id::VARCHAR, member_count FROM struct_ ORDER BY member_count DESC, community_id LIMIT 10)
       UNION ALL SELECT 'compression', 'mean', round(avg(tx_count / (tx_count + span_hours)), 6) FROM stats UNION ALL SELECT 'compression', 'max', round(max(tx_count / (tx_count + span_hours)), 6) FROM stats""",
    _STATS,
)
def community_summary(net: Network) -> DataFrame:
    return r(communities.summary(communities.structure(net.membership, inside_of(net)), communities.activity_stats(net.membership, net.transactions)))


@register(
    "modularity",
    "SELECT round(2 * sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 8) AS modularity FROM (SELECT c, sum(i) AS i, sum(w) AS k FROM (SELECT a.community_id AS c, CASE WHEN a.community_id = b.community_id THEN weight ELSE 0 END AS i, weight AS w FROM edges JOIN membership a ON src = a.account_id JOIN membership b ON dst = b.account_id UNION ALL SELECT b.community_id, 0, weight FROM edges JOIN membership b ON dst = b.account_id) GROUP BY c)",
)
def modularity(net: Network) -> DataFrame:
    return r(communities.modularity(net.membership, weights_of(net)), 8)


_FEATURES = (
    _STATS
    + """,
uniq AS (SELECT community_id, count(DISTINCT x) FILTER (k = 'i') AS ui, count(DISTINCT x) FILTER (k = 'd') AS ud, count(DISTINCT x) FILTER (k = 'p') AS up, count(DISTINCT x) FILTER (k = 'm') AS um FROM
  (SELECT community_id, 'i' AS k, unnest(instruments) AS x FROM inside UNION ALL SELECT community_id, 'd', unnest(devices) FROM inside UNION ALL SELECT community_id, 'p', unnest(ips) FROM inside UNION ALL SELECT community_id, 'm', unnest(merchants) FROM inside) GROUP BY 1),
ovl AS (SELECT community_id, avg(temporal_overlap) AS o FROM inside GROUP BY 1),
money AS (SELECT community_id, avg(amount) AS a, sum(amount) AS s, CASE WHEN count(amount) >= 2 THEN stddev_samp(amount) / nullif(avg(amount), 0) END AS cv, avg((transaction_status = 'declined')::INTEGER) AS dr, count(DISTINCT payment_method) AS pm FROM member_tx GROUP BY 1),
cats AS (SELECT community_id, category, count(*) AS n FROM member_tx JOIN merchants USING (merchant_id) GROUP BY ALL),
ent AS (SELECT community_id, abs(sum(p * log2(p))) AS e FROM (SELECT *, n / sum(n) OVER (PARTITION BY community_id) AS p FROM cats) GROUP BY 1),
features AS (SELECT community_id, member_count::DOUBLE AS member_count, density, CASE WHEN internal_edges > 0 THEN total_weight / internal_edges END AS mean_edge_weight, total_weight / member_count AS weight_per_member,
  coalesce(ui, 0)::DOUBLE AS unique_shared_instruments, coalesce(ud, 0)::DOUBLE AS unique_shared_devices, coalesce(up, 0)::DOUBLE AS unique_shared_ips, coalesce(um, 0)::DOUBLE AS unique_shared_merchants,
  coalesce(ui, 0) / member_count AS instrument_sharing_ratio, coalesce(ud, 0) / member_count AS device_sharing_ratio, coalesce(tx_count / (tx_count + span_hours), 0) AS temporal_compression_score, coalesce(active_hours, 0)::DOUBLE AS unique_active_hours,
  median_gap_hours AS median_inter_transaction_gap_hours, coalesce(tx_count, 0) / member_count AS tx_per_member, o AS temporal_overlap_mean, a AS mean_tx_amount, s AS total_transaction_amount, cv AS amount_cv, dr AS declined_rate, coalesce(pm, 0)::DOUBLE AS unique_payment_methods, e AS merchant_category_entropy
  FROM struct_ LEFT JOIN uniq USING (community_id) LEFT JOIN stats USING (community_id) LEFT JOIN ovl USING (community_id) LEFT JOIN money USING (community_id) LEFT JOIN ent USING (community_id))"""
)
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in features.FEATURES)


@register("community_features", f"SELECT community_id, {_ROUNDED} FROM features", _FEATURES)
def community_features(net: Network) -> DataFrame:
    return r(features_of(net), 4)


_LABELS = """sized AS (SELECT pattern_id, min(ring_order) AS ring_order, count(*) AS n FROM ring_members GROUP BY 1),
cov AS (SELECT community_id, r.pattern_id, ring_order, count(*) / any_value(n)::DOUBLE AS coverage FROM ring_members r JOIN membership USING (account_id) JOIN sized s USING (pattern_id, ring_order) GROUP BY ALL),
labels_ AS (SELECT m.community_id, coalesce(max(coverage), 0)::DOUBLE AS max_ring_coverage, arg_min(pattern_id, (-coverage, ring_order)) AS primary_ring_id, count(pattern_id)::BIGINT AS num_rings_intersected FROM (SELECT DISTINCT community_id FROM membership) m LEFT JOIN cov USING (community_id) GROUP BY 1),
frauds AS (SELECT community_id, count(*) AS members, count(*) FILTER (account_id IN (SELECT account_id FROM ring_members))::BIGINT AS fraud FROM membership GROUP BY 1),
ring_labels AS (SELECT community_id, max_ring_coverage, primary_ring_id, num_rings_intersected, fraud AS fraud_account_count, round_even(fraud / members::DOUBLE, 6) AS fraud_purity, (max_ring_coverage >= {t})::INTEGER AS is_positive FROM labels_ JOIN frauds USING (community_id))"""


@register("ring_labels", "SELECT * FROM ring_labels", _LABELS.format(t="0.5"))
def ring_labels(net: Network) -> DataFrame:
    return labels_of(net)


@register("ring_labels_low", "SELECT community_id, is_positive FROM ring_labels", _LABELS.format(t="0.1"))
def ring_labels_low(net: Network) -> DataFrame:
    return labels.binary(labels.community_labels(net.membership, labels.ring_members(net.rings), 0.1))


@register(
    "feature_quality",
    "SELECT feature, count(*) FILTER (v IS NULL)::BIGINT AS missing, round(avg(v) FILTER (is_positive = 1), 6) AS mean_positive, round(avg(v) FILTER (is_positive = 0), 6) AS mean_negative, round((avg(v) FILTER (is_positive = 1)) / nullif(avg(v) FILTER (is_positive = 0), 0), 6) AS ratio FROM long_ JOIN ring_labels USING (community_id) GROUP BY feature",
    _FEATURES + "," + _LABELS.format(t="0.1") + ", long_ AS (" + " UNION ALL ".join(f"SELECT community_id, '{c}' AS feature, {c} AS v FROM features" for c in features.FEATURES) + ")",
)
def feature_quality(net: Network) -> DataFrame:
    return r(features.quality_report(features_of(net), labels.community_labels(net.membership, labels.ring_members(net.rings), 0.1)), 6)


# --- evidence ----------------------------------------------------------------

_POINTS = "CASE severity WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 12 WHEN 'LOW' THEN 5 END AS points"


def _id(kind: str, entity: str, sub: str, of: str = "COMMUNITY") -> str:
    return f"'ev_' || substr(sha1('{of}:' || {entity} || ':{kind}:' || {sub}), 1, 12)"


def _shared(kind: str) -> str:
    name, (high, mid, low) = evidence.SHARING[kind]
    return f"""SELECT {_id(name, "community_id", "entity")} AS evidence_id, community_id::VARCHAR AS entity_id, '{name}' AS type, CASE WHEN n >= {high} THEN 'HIGH' WHEN n >= {mid} THEN 'MEDIUM' WHEN n >= {low} THEN 'LOW' END AS severity, n::VARCHAR AS measure, array_to_string(accounts[1:20], ',') AS supporting FROM
      (SELECT community_id, entity, list(DISTINCT a ORDER BY a) AS accounts, count(DISTINCT a) AS n FROM (SELECT community_id, entity, unnest([src, dst]) AS a FROM (SELECT community_id, unnest({kind}) AS entity, src, dst FROM inside)) GROUP BY ALL)"""


_WINDOWS = """mt AS (SELECT community_id, timestamp, transaction_id FROM member_tx),
hours AS (SELECT community_id, timestamp, count(*) OVER x AS n, max(timestamp) OVER x AS e, count(*) OVER (PARTITION BY community_id) AS total FROM mt WINDOW x AS (PARTITION BY community_id ORDER BY timestamp RANGE BETWEEN CURRENT ROW AND INTERVAL 3600 SECOND FOLLOWING)),
hour1 AS (SELECT community_id, n, timestamp AS s, e FROM hours WHERE total >= 4 QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n DESC, timestamp) = 1),
dayss AS (SELECT community_id, timestamp, count(*) OVER x AS n, max(timestamp) OVER x AS e, count(*) OVER (PARTITION BY community_id) AS total FROM mt WINDOW x AS (PARTITION BY community_id ORDER BY timestamp RANGE BETWEEN CURRENT ROW AND INTERVAL 86400 SECOND FOLLOWING)),
day1 AS (SELECT community_id, n, timestamp AS s, e FROM dayss WHERE total >= 4 AND community_id NOT IN (SELECT community_id FROM hour1 WHERE n >= 8) QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n DESC, timestamp) = 1),
support AS (SELECT community_id, array_to_string(list(transaction_id ORDER BY transaction_id), ',') AS supporting FROM (SELECT mt.*, row_number() OVER (PARTITION BY mt.community_id ORDER BY mt.timestamp, transaction_id) AS k FROM mt JOIN hour1 USING (community_id) WHERE hour1.n >= 8 AND mt.timestamp BETWEEN s AND e) WHERE k <= 20 GROUP BY 1),
raw_gaps AS (SELECT community_id, epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY community_id ORDER BY timestamp)) / 1e6::DOUBLE / 3600 AS gap FROM mt),
med AS (SELECT community_id, median(gap) AS m FROM raw_gaps GROUP BY 1),
deg AS (SELECT m.account_id, m.community_id, count(x.peer)::BIGINT AS degree FROM membership m LEFT JOIN mirrored x ON m.account_id = x.account_id GROUP BY ALL),
pct AS (SELECT community_id, quantile_cont(degree, 0.5) AS p50, quantile_cont(degree, 0.75) AS p75, quantile_cont(degree, 0.95) AS p95, count(*) AS members, sum(degree) AS ends FROM deg GROUP BY 1)"""
_EV = {
    **{k: _shared(k) for k in evidence.SHARING},
    "burst": f"""SELECT {_id("TEMPORAL_BURST", "community_id", "'60min'")} AS evidence_id, community_id::VARCHAR AS entity_id, 'TEMPORAL_BURST' AS type, CASE WHEN n >= 15 THEN 'HIGH' WHEN n >= 8 THEN 'MEDIUM' END AS severity, n::VARCHAR || ' ' || strftime(s, '%Y-%m-%d %H:%M:%S') || ' ' || strftime(e, '%Y-%m-%d %H:%M:%S') AS measure, supporting FROM hour1 LEFT JOIN support USING (community_id)
      UNION ALL SELECT {_id("TEMPORAL_BURST", "community_id", "'24h'")}, community_id::VARCHAR, 'TEMPORAL_BURST', CASE WHEN n >= 4 THEN 'LOW' END, n::VARCHAR || ' ' || strftime(s, '%Y-%m-%d %H:%M:%S') || ' ' || strftime(e, '%Y-%m-%d %H:%M:%S'), '' FROM day1""",
    "gap": f"""SELECT {_id("RAPID_INTERACTION", "community_id", "'gap'")} AS evidence_id, community_id::VARCHAR AS entity_id, 'RAPID_INTERACTION' AS type, CASE WHEN m < 0.5 THEN 'HIGH' WHEN m < 2 THEN 'MEDIUM' WHEN m < 6 THEN 'LOW' END AS severity, round_even(m, 4)::VARCHAR AS measure, '' AS supporting FROM med""",
    "density": f"""SELECT {_id("HIGH_EVIDENCE_DENSITY", "community_id", "'density'")} AS evidence_id, community_id::VARCHAR AS entity_id, 'HIGH_EVIDENCE_DENSITY' AS type, CASE WHEN weight_per_member > 10 THEN 'HIGH' WHEN weight_per_member > 3 THEN 'MEDIUM' WHEN weight_per_member > 0.5 THEN 'LOW' END AS severity, member_count::BIGINT::VARCHAR AS measure, '' AS supporting FROM features""",
    "hub": f"""SELECT {_id("HUB_ACCOUNT", "community_id", "account_id")} AS evidence_id, community_id::VARCHAR AS entity_id, 'HUB_ACCOUNT' AS type, CASE WHEN degree >= p95 AND degree >= 10 THEN 'HIGH' WHEN degree >= p75 AND degree >= 5 THEN 'MEDIUM' WHEN degree >= p50 AND degree >= 3 THEN 'LOW' END AS severity, degree::VARCHAR AS measure, account_id AS supporting FROM deg JOIN pct USING (community_id) WHERE members >= 2 AND ends > 0""",
    "multilayer": f"""SELECT {_id("MULTI_LAYER_EVIDENCE", "community_id", "src || ':' || dst")} AS evidence_id, community_id::VARCHAR AS entity_id, 'MULTI_LAYER_EVIDENCE' AS type, CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' END AS severity, n::VARCHAR AS measure, src || ',' || dst AS supporting FROM (SELECT *, (len(devices) > 0)::INTEGER + (len(instruments) > 0)::INTEGER + (len(ips) > 0)::INTEGER + (len(merchants) > 0)::INTEGER AS n FROM inside)""",
}
_MEASURES = {"burst": ["transaction_count", "start", "end"], "gap": ["median_gap_hours"], "density": ["member_count"], "hub": ["degree"], "multilayer": ["layer_count"]}


def shown(items: DataFrame, keys: list[str]) -> DataFrame:
    measure = F.concat_ws(" ", *(F.element_at("metrics", F.lit(k)) for k in keys))
    if keys == _MEASURES["gap"]:
        measure = measure.cast("double")
    return items.select("evidence_id", "entity_id", "type", "severity", "points", measure.alias("measure"), F.array_join("supporting_entities", ",").alias("supporting"))


def _detectors() -> None:
    def rows(net):
        return features.member_transactions(net.membership, net.transactions).select("community_id", "timestamp", "transaction_id")

    made = {
        **{k: (lambda net, k=k: evidence.sharing(inside_of(net), k)) for k in evidence.SHARING},
        "burst": lambda net: evidence.bursts(rows(net), "community_id", "COMMUNITY"),
        "gap": lambda net: evidence.rapid(rows(net), "community_id", "COMMUNITY"),
        "density": lambda net: evidence.density(features_of(net, *evidence.DENSITY)),
        "hub": lambda net: evidence.hubs(net.membership, inside_of(net)),
        "multilayer": lambda net: evidence.multi_layer(inside_of(net)),
    }
    for name, make in made.items():
        keys = _MEASURES.get(name, ["account_count"])
        body = f"SELECT evidence_id, entity_id, type, severity, {_POINTS}, measure, supporting FROM ({_EV[name]}) WHERE severity IS NOT NULL"
        if name == "gap":  # a double's text differs between engines, so its value is compared
            body = body.replace("measure, supporting FROM", "measure::DOUBLE AS measure, supporting FROM", 1)
        register(f"ev_{name.removesuffix('s') if name in evidence.SHARING else name}", body, _FEATURES + "," + _WINDOWS)(lambda net, make=make, keys=keys: shown(make(net), keys))


_detectors()
_ALL_EV = _FEATURES + "," + _WINDOWS + ", ev AS (" + " UNION ALL ".join(f"SELECT evidence_id, entity_id, type, severity, {_POINTS} FROM ({b}) WHERE severity IS NOT NULL" for b in _EV.values()) + ")"


@register(
    "evidence_summary",
    "SELECT 'COMMUNITY' AS entity_type, entity_id, least(100, sum(points))::INTEGER AS evidence_score, sum(points)::BIGINT AS raw_score, count(*)::BIGINT AS item_count, count(*) FILTER (severity = 'HIGH')::BIGINT AS high_count, count(*) FILTER (severity = 'MEDIUM')::BIGINT AS medium_count, count(*) FILTER (severity = 'LOW')::BIGINT AS low_count FROM ev GROUP BY entity_id",
    _ALL_EV,
)
def evidence_summary(net: Network) -> DataFrame:
    return evidence.scores(evidence_of(net))


@register("evidence_order", "SELECT entity_id, evidence_id, row_number() OVER (PARTITION BY entity_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, points DESC, evidence_id)::INTEGER AS place FROM ev", _ALL_EV)
def evidence_order(net: Network) -> DataFrame:
    return evidence.ordered(evidence_of(net)).select("entity_id", "evidence_id", "place")


_FAMILY = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.FAMILIES.items()) + " END"


@register("evidence_families", f"SELECT entity_id, family, n, points, round(points / max(points) OVER (PARTITION BY entity_id), 6) AS share FROM (SELECT entity_id, {_FAMILY} AS family, count(*)::BIGINT AS n, sum(points)::BIGINT AS points FROM ev GROUP BY ALL)", _ALL_EV)
def evidence_families(net: Network) -> DataFrame:
    return r(evidence.families(evidence_of(net))).drop("entity_type")


def _told(kind: str, **values: str) -> str:
    """A description in SQL; values are the metrics' expressions."""
    parts = evidence.told(evidence.TEXTS[""][kind], lambda name: (values[name],))
    return " || ".join("'" + x + "'" if isinstance(x, str) else f"({x[0]})::VARCHAR" for x in parts)


def _told_sharing(kind: str) -> str:
    name, bounds = evidence.SHARING[kind]
    return f"""SELECT {_id(name, "community_id", "entity")} AS evidence_id, community_id, entity || ': ' || n || ' accounts' AS title, {_told(name, entity="entity", account_count="n")} AS description
      FROM (SELECT community_id, entity, count(DISTINCT a) AS n FROM (SELECT community_id, entity, unnest([src, dst]) AS a FROM (SELECT community_id, unnest({kind}) AS entity, src, dst FROM inside)) GROUP BY ALL) WHERE n >= {bounds[2]}"""


def _told_burst(window: str, table: str, least: int) -> str:
    text = _told("TEMPORAL_BURST", transaction_count="n", start="strftime(s, '%Y-%m-%d %H:%M:%S')", end="strftime(e, '%Y-%m-%d %H:%M:%S')")
    return f"""SELECT {_id("TEMPORAL_BURST", "community_id", f"'{window}'")}, community_id, n || ' transactions within {window}', {text} FROM {table} WHERE n >= {least}"""


_KINDS = "list_filter([" + ", ".join(f"CASE WHEN len({k}) > 0 THEN '{k}' END" for k in evidence.LAYERS) + "], lambda x: x IS NOT NULL)"
_TOLD = [
    *map(_told_sharing, evidence.SHARING),
    _told_burst("60min", "hour1", 8),
    _told_burst("24h", "day1", 4),
    f"""SELECT {_id("RAPID_INTERACTION", "community_id", "'gap'")}, community_id, NULL, {_told("RAPID_INTERACTION", transaction_count="n", minutes="round_even(round_even(m, 4) * 60, 0)::BIGINT")}
      FROM med JOIN (SELECT community_id, count(gap) + 1 AS n FROM raw_gaps GROUP BY 1) USING (community_id) WHERE m < 6""",
    f"""SELECT {_id("HIGH_EVIDENCE_DENSITY", "community_id", "'density'")}, community_id, NULL, {_told("HIGH_EVIDENCE_DENSITY", member_count="member_count::BIGINT", weight="floor(round_even(weight_per_member, 4))::BIGINT")} FROM features WHERE weight_per_member > 0.5""",
    f"""SELECT {_id("HUB_ACCOUNT", "community_id", "account_id")}, community_id, account_id || ' has ' || degree || ' links', {_told("HUB_ACCOUNT", account_id="account_id", degree="degree", community_size="members")}
      FROM deg JOIN pct USING (community_id) WHERE members >= 2 AND ends > 0 AND (degree >= p95 AND degree >= 10 OR degree >= p75 AND degree >= 5 OR degree >= p50 AND degree >= 3)""",
    f"""SELECT {_id("MULTI_LAYER_EVIDENCE", "community_id", "src || ':' || dst")}, community_id, src || ' and ' || dst || ': ' || len(names) || ' kinds', {_told("MULTI_LAYER_EVIDENCE", account_a="src", account_b="dst", layer_count="len(names)", layers="array_to_string(names, ',')")}
      FROM (SELECT *, {_KINDS} AS names FROM inside) WHERE len(names) >= 2""",
]


@register("evidence_texts", f"SELECT evidence_id, community_id::VARCHAR AS entity_id, title, description FROM ({' UNION ALL '.join(_TOLD)})", _FEATURES + "," + _WINDOWS)
def evidence_texts(net: Network) -> DataFrame:
    """Titles and descriptions of the communities' evidence; titles with decimal fractions are left out, as engines write them differently."""
    whole = ~F.col("type").isin("RAPID_INTERACTION", "HIGH_EVIDENCE_DENSITY")
    return evidence.described(evidence.distinct_items(items_of(net))).select("evidence_id", "entity_id", F.when(whole, F.col("title")).alias("title"), "description")


_ACCOUNT = _WINDOWS.replace("member_tx", "own_tx").replace("community_id", "account_id")
_ACCOUNT_CTES = (
    _WINDOWS
    + ", own_tx AS (SELECT DISTINCT account_id, tx.* FROM (SELECT transaction_id, unnest([src_account_id, dst_account_id]) AS account_id FROM tx) JOIN tx USING (transaction_id)), "
    + ", ".join(f"a_{c}" for c in _ACCOUNT.split(",\ndeg AS")[0].split(",\n")).replace("FROM mt", "FROM a_mt").replace("FROM hours", "FROM a_hours").replace("FROM hour1", "FROM a_hour1").replace("FROM dayss", "FROM a_dayss").replace("FROM raw_gaps", "FROM a_raw_gaps").replace("JOIN hour1", "JOIN a_hour1").replace("hour1.n", "a_hour1.n").replace("mt.", "a_mt.").replace("a_a_mt", "a_mt")
)


def _account_sharing(kind: str) -> str:
    name, (high, mid, low) = evidence.SHARING[kind]
    return f"SELECT {_id(name, 'account_id', 'entity', 'ACCOUNT')} AS evidence_id, account_id AS entity_id, '{name}' AS type, CASE WHEN n >= {high} THEN 'HIGH' WHEN n >= {mid} THEN 'MEDIUM' WHEN n >= {low} THEN 'LOW' END AS severity FROM (SELECT account_id, entity, count(DISTINCT peer) + 1 AS n FROM (SELECT account_id, peer, unnest({kind}) AS entity FROM mirrored) GROUP BY ALL)"


_ACCOUNT_EV = " UNION ALL ".join(
    [
        *(_account_sharing(k) for k in ("instruments", "devices", "ips")),
        f"SELECT {_id('MULTI_LAYER_EVIDENCE', 'account_id', 'least(account_id, peer) || chr(58) || greatest(account_id, peer)', 'ACCOUNT')}, account_id, 'MULTI_LAYER_EVIDENCE', CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' END FROM (SELECT *, (len(devices) > 0)::INTEGER + (len(instruments) > 0)::INTEGER + (len(ips) > 0)::INTEGER + (len(merchants) > 0)::INTEGER AS n FROM mirrored)",
        f"SELECT {_id('TEMPORAL_BURST', 'account_id', chr(39) + '60min' + chr(39), 'ACCOUNT')}, account_id, 'TEMPORAL_BURST', CASE WHEN n >= 15 THEN 'HIGH' WHEN n >= 8 THEN 'MEDIUM' END FROM a_hour1",
        f"SELECT {_id('TEMPORAL_BURST', 'account_id', chr(39) + '24h' + chr(39), 'ACCOUNT')}, account_id, 'TEMPORAL_BURST', CASE WHEN n >= 4 THEN 'LOW' END FROM a_day1",
        f"SELECT {_id('RAPID_INTERACTION', 'account_id', chr(39) + 'gap' + chr(39), 'ACCOUNT')}, account_id, 'RAPID_INTERACTION', CASE WHEN m < 0.5 THEN 'HIGH' WHEN m < 2 THEN 'MEDIUM' WHEN m < 6 THEN 'LOW' END FROM a_med",
        f"SELECT {_id('HUB_ACCOUNT', 'account_id', 'account_id', 'ACCOUNT')}, account_id, 'HUB_ACCOUNT', CASE WHEN degree >= p95 AND degree >= 10 THEN 'HIGH' WHEN degree >= p75 AND degree >= 5 THEN 'MEDIUM' WHEN degree >= p50 AND degree >= 3 THEN 'LOW' END FROM deg JOIN pct USING (community_id) WHERE members >= 2 AND ends > 0",
    ]
)


@register("account_evidence", f"SELECT DISTINCT evidence_id, entity_id, type, severity, {_POINTS} FROM ({_ACCOUNT_EV}) WHERE severity IS NOT NULL", _ACCOUNT_CTES)
def account_evidence(net: Network) -> DataFrame:
    return evidence.account_evidence(net.membership, inside_of(net), ledger_of(net)).select("evidence_id", "entity_id", "type", "severity", "points")


@register("louvain_membership")
def louvain_membership(net: Network) -> DataFrame:
    return communities.detect(net.accounts.select("account_id"), weights_of(net))
