"""Queries on directories, timelines, evidence subjects and paths, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import communities, contracts, directory, evidence, features, filters, graph, labels, marts, scoring, slices
from ..operators.stored import cut
from . import queries_graph as base
from . import queries_marts as more
from .network import Network, sql
from .queries_graph import edges_of, evidence_of, features_of, inside_of, ledger_of, once, r

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, body: str | None = None, ctes: str = ""):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Network(spark, sf_dir))
        if body:
            ORACLES[name] = sql(body, ctes)
        return f

    return keep


# --- communities ---------------------------------------------------------------

_DIRECTORY = (
    base._ALL_EV
    + ","
    + more._SCORES
    + """,
type_points AS (SELECT entity_id, type, sum(points) AS p FROM ev GROUP BY ALL),
sig AS (SELECT entity_id::BIGINT AS community_id, list(type ORDER BY p DESC, type) AS s FROM type_points GROUP BY 1),
dir AS (SELECT community_id, risk_score,
    CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    coalesce(s[1], '') AS top_signal_1, coalesce(s[2], '') AS top_signal_2, coalesce(s[3], '') AS top_signal_3
  FROM sc JOIN sig USING (community_id))"""
)


def directory_of(net: Network, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Communities with score, level and signals, and where a text finds evidence. A row for each type of a community's evidence is stored, and no items."""
    types = cut(directory.tally(base.items_of(net), text), "tally")
    rows = types.groupBy(F.col("entity_id").cast("long").alias("community_id")).agg(evidence.score().alias("risk_score"))
    rows = rows.join(directory.signals(types).hint("merge"), "community_id")
    return rows.withColumn("risk_level", directory.level_of(F.col("risk_score"))), types


@register(
    "community_search",
    """SELECT community_id, risk_score, risk_level, top_signal_1, top_signal_2, top_signal_3 FROM dir
       WHERE risk_level = 'HIGH' AND (community_id::VARCHAR LIKE '%hub%' OR top_signal_1 || ' ' || top_signal_2 || ' ' || top_signal_3 ILIKE '%hub%')""",
    _DIRECTORY,
)
def community_search(net: Network) -> DataFrame:
    return directory.communities(directory_of(net)[0], " Hub ", "HIGH").select("community_id", "risk_score", "risk_level", "top_signal_1", "top_signal_2", "top_signal_3")


@register(
    "triage_search",
    """SELECT community_id, risk_level FROM dir WHERE 'community #' || community_id LIKE '%burst%' OR community_id IN (SELECT entity_id::BIGINT FROM ev WHERE type ILIKE '%burst%')""",
    _DIRECTORY,
)
def triage_search(net: Network) -> DataFrame:
    rows, types = directory_of(net, "burst")
    return directory.communities(rows, "burst", None, types).select("community_id", "risk_level")


@register(
    "directory_sorted",
    "SELECT community_id, round(density, 6) AS density FROM features ORDER BY density DESC NULLS LAST, community_id LIMIT 25",
    base._FEATURES,
)
def directory_sorted(net: Network) -> DataFrame:
    return r(directory.top(features_of(net, "density"), "density"))


_SORTS = {
    "risk_asc": "coalesce(risk_score, 0), account_id",
    "risk_desc": "coalesce(risk_score, 0) DESC, account_id DESC",
    "balance_asc": "coalesce(balance, 0), account_id",
    "balance_desc": "coalesce(balance, 0) DESC, account_id DESC",
    "created_asc": "coalesce(creation_date::VARCHAR, ''), account_id",
    "created_desc": "coalesce(creation_date::VARCHAR, '') DESC, account_id DESC",
}


@register(
    "community_account_orders",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS sort, community_id, account_id, row_number() OVER (PARTITION BY community_id ORDER BY {by})::INTEGER AS place
            FROM accounts JOIN membership USING (account_id)
            WHERE (lower(account_id) LIKE '%1%' OR lower(customer_name) LIKE '%1%') AND coalesce(risk_score, 0) < 0.35"""
        for name, by in _SORTS.items()
    )
    + ") WHERE place <= 5",
)
def community_account_orders(net: Network) -> DataFrame:
    rows, out = net.accounts.join(net.membership.hint("merge"), "account_id"), None
    for name in _SORTS:
        placed = directory.account_page(directory.accounts(rows, "1", "LOW", name), 1, 5)
        one = placed.select(F.lit(name).alias("sort"), "community_id", "account_id", "place")
        out = one if out is None else out.unionByName(one)
    return out


# --- timelines and evidence ------------------------------------------------------

_FOCUS = """burst AS (SELECT community_id, s, e FROM hour1 WHERE n >= 8 UNION ALL SELECT community_id, s, e FROM day1 WHERE n >= 4),
focus AS (SELECT DISTINCT mt.community_id, mt.transaction_id FROM burst b JOIN mt ON mt.community_id = b.community_id AND mt.timestamp BETWEEN s AND e)"""


@register(
    "timeline_filtered",
    """SELECT community_id, transaction_id, timestamp FROM member_tx m
       WHERE (lower(transaction_id) LIKE '%7%' OR lower(src_account_id) LIKE '%7%' OR lower(dst_account_id) LIKE '%7%' OR lower(merchant_id) LIKE '%7%')
         AND lower(transaction_status) = 'settled'
         AND ((community_id, transaction_id) IN (SELECT (community_id, transaction_id) FROM focus) OR community_id NOT IN (SELECT community_id FROM focus))""",
    base._WINDOWS + "," + _FOCUS,
)
def timeline_filtered(net: Network) -> DataFrame:
    rows = base.member_rows_of(net)
    named = evidence.matches(base.bursts_of(net), rows.withColumn("entity_id", F.col("community_id").cast("string")))
    named = named.select(F.col("entity_id").cast("long").alias("community_id"), "transaction_id")
    return directory.events(rows, "7", "SETTLED", named).select("community_id", "transaction_id", "timestamp")


_ITEMS = "items AS (" + " UNION ALL ".join(f"SELECT evidence_id, entity_id, type, severity, measure, supporting FROM ({b}) WHERE severity IS NOT NULL" for b in base._EV.values()) + ")"


@register(
    "evidence_subjects",
    """SELECT entity_id, evidence_id,
         CASE WHEN type IN ('TEMPORAL_BURST', 'RAPID_INTERACTION') THEN 'transactions' WHEN supporting LIKE 'acc%' THEN 'accounts' ELSE 'community' END AS subject,
         CASE WHEN type = 'TEMPORAL_BURST' THEN split_part(measure, ' ', 1)::BIGINT WHEN type = 'RAPID_INTERACTION' THEN g.n ELSE 0 END AS transaction_count,
         CASE WHEN supporting LIKE 'acc%' THEN len(string_split(supporting, ',')) ELSE 0 END::INTEGER AS account_count,
         CASE WHEN supporting LIKE 'acc%' THEN array_to_string(string_split(supporting, ',')[1:3], ', ') ELSE '' END AS first_accounts
       FROM items LEFT JOIN (SELECT community_id::VARCHAR AS c, count(*) FILTER (gap IS NOT NULL)::BIGINT + 1 AS n FROM raw_gaps GROUP BY 1) g ON entity_id = c""",
    base._FEATURES + "," + base._WINDOWS + "," + _ITEMS,
)
def evidence_subjects(net: Network) -> DataFrame:
    return evidence.subjects(evidence_of(net)).select("entity_id", "evidence_id", "subject", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), "account_count", "first_accounts")


@register(
    "evidence_of_accounts",
    """SELECT account_id, count(*)::BIGINT AS items, count(*) FILTER (severity = 'HIGH')::BIGINT AS high FROM
         (SELECT DISTINCT evidence_id, severity, unnest(string_split(supporting, ',')) AS account_id FROM items WHERE supporting LIKE 'acc%') GROUP BY 1""",
    base._FEATURES + "," + base._WINDOWS + "," + _ITEMS,
)
def evidence_of_accounts(net: Network) -> DataFrame:
    return evidence.touching(evidence_of(net)).groupBy("account_id").agg(F.count("*").alias("items"), F.count_if(F.col("severity") == "HIGH").alias("high"))


# --- filters, labels, paths --------------------------------------------------------


@register("community_members", "SELECT account_id FROM membership WHERE community_id = 3")
def community_members(net: Network) -> DataFrame:
    return filters.equal(net.accounts.join(net.membership.hint("merge"), "account_id", "left"), community_id=3).select("account_id")


@register(
    "class_balance",
    "SELECT is_positive, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT (max_ring_coverage >= 0.1)::INTEGER AS is_positive FROM ring_labels) GROUP BY 1",
    base._FEATURES + "," + base._LABELS.format(t="0.1"),
)
def class_balance(net: Network) -> DataFrame:
    return r(features.class_balance(more.positives_of(net)))


def _target(net: Network) -> str:
    return "acc_514" if net.n > 514 else "acc_7"


@register(
    "path_length",
    "SELECT max(hops)::INTEGER AS hops FROM (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(7)) + "), sizes WHERE account_id = CASE WHEN n > 514 THEN 'acc_514' ELSE 'acc_7' END",
    more._HOPS,
)
def path_length(net: Network) -> DataFrame:
    """The way from the first account over shared devices, instruments and addresses."""
    path = slices.shortest_path(more.infrastructure(net), "acc_0", _target(net))
    return path.agg(F.max("hop").alias("hops"))


# --- from detection to evidence --------------------------------------------------


@register("detected_evidence")
def detected_evidence(net: Network) -> DataFrame:
    """Detected communities all the way: features, learned scores, evidence scores and modularity's share of each."""
    edges = once(net, "edges", lambda: edges_of(net))
    found = once(net, "detected", lambda: communities.detect(net.accounts.select("account_id"), edges))
    inside = once(net, "detected-inside", lambda: graph.internal(edges, found))
    # sums, times and evidence read these
    rows = once(net, "detected-rows", lambda: features.member_transactions(found, ledger_of(net)))
    matrix = once(net, "detected-features", lambda: features.community_features(found, inside, ledger_of(net), net.merchants, rows=rows))
    contracts.require(matrix, ["community_id"], (*contracts.EVALUATION, *contracts.LABEL_COLUMNS))
    truth = labels.community_labels(found, labels.ring_members(net.rings), 0.1)
    learned = scoring.score(matrix, truth)
    told = evidence.scores(evidence.community_evidence(found, inside, ledger_of(net), matrix, rows))
    told = told.select(F.col("entity_id").cast("long").alias("community_id"), "evidence_score", "item_count")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("evidence_score", "item_count")]
    scored = learned.join(told.hint("merge"), "community_id", "left").select("community_id", "risk_score", "probability", "risk_tier", "top_signal_1", "top_signal_2", "top_signal_3", *zero)
    listed = matrix.select("community_id", "member_count", "density", "mean_edge_weight", "tx_per_member", "total_transaction_amount")
    return marts.community_list(scored, listed.join(communities.shares(found, edges, inside).hint("merge"), "community_id", "left"))
