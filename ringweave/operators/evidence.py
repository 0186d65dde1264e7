"""Rule-based evidence for all communities and all accounts in one plan each."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import evidence_id
from ..functions.rules import AT_LEAST, ORDER, POINTS, by_severity, hub_severity, steps
from .communities import gaps
from .features import member_transactions
from .graph import mirrored
from .intervals import within
from .selection import medians
from .stored import cut

# Names of the evidence types by kind of entity, and the families of signals.
SHARING = {
    "instruments": ("SHARED_INSTRUMENT_CONCENTRATION", AT_LEAST["sharing"]),
    "devices": ("DEVICE_REUSE", AT_LEAST["sharing"]),
    "ips": ("IP_CONCENTRATION", AT_LEAST["ip"]),
    "merchants": ("MERCHANT_TEMPORAL_OVERLAP", AT_LEAST["merchant"]),
}
FAMILIES = {
    "SHARED_INSTRUMENT_CONCENTRATION": "instruments", "DEVICE_REUSE": "devices", "IP_CONCENTRATION": "network", "TEMPORAL_BURST": "timing", "RAPID_INTERACTION": "timing",
    "MERCHANT_TEMPORAL_OVERLAP": "merchants", "HIGH_EVIDENCE_DENSITY": "structure", "HUB_ACCOUNT": "structure", "MULTI_LAYER_EVIDENCE": "structure",
}
LAYERS = ["devices", "instruments", "ips", "merchants"]
SUPPORT, SAMPLE = 20, 10
#: Descriptions by entity and type of evidence; names in braces are metrics, or made from them in `told`.
TEXTS = {
    "": {
        "SHARED_INSTRUMENT_CONCENTRATION": "Payment instrument {entity} is on the links of {account_count} accounts. Families share one, and so do accounts in one hand.",
        "DEVICE_REUSE": "Device {entity} is on the links of {account_count} accounts. A lent device looks the same as one operator.",
        "IP_CONCENTRATION": "Address {entity} is on the links of {account_count} accounts. Offices and carriers put strangers behind one address.",
        "MERCHANT_TEMPORAL_OVERLAP": "{account_count} linked accounts paid merchant {entity} on the same days. Popular merchants bring this about by chance.",
        "TEMPORAL_BURST": "{transaction_count} transactions lie between {start} and {end}. To be read against the usual pace.",
        "RAPID_INTERACTION": "Half of {transaction_count} transactions come within {minutes} minutes of the one before.",
        "HIGH_EVIDENCE_DENSITY": "Links among {member_count} members weigh {weight} or more for each of them.",
        "HUB_ACCOUNT": "{account_id} is linked to {degree} of the {community_size} accounts of its community.",
        "MULTI_LAYER_EVIDENCE": "{account_a} and {account_b} have {layer_count} kinds of links: {layers}.",
    },
    "ACCOUNT": {"MULTI_LAYER_EVIDENCE": "The account and {peer} have {layer_count} kinds of links: {layers}."},
}


def item(rows: DataFrame, entity_type: str, entity_id: Column, kind: str | Column, severity: Column, subkey: Column, title: Column, supporting: Column, metrics: dict[str, Column], observed: Column | None = None) -> DataFrame:
    """Evidence rows: id, entity, type, severity, points, title, observed_at, supporting_entities, metrics."""
    text = F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))))
    return (
        rows.withColumn("severity", severity)
        .filter("severity IS NOT NULL")
        .select(
            evidence_id(F.lit(entity_type), entity_id.cast("string"), kind, subkey).alias("evidence_id"),
            F.lit(entity_type).alias("entity_type"),
            entity_id.cast("string").alias("entity_id"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            "severity",
            by_severity(F.col("severity"), {k: F.lit(v) for k, v in POINTS.items()}).alias("points"),
            title.alias("title"),
            (F.lit(None).cast("timestamp") if observed is None else observed).alias("observed_at"),
            F.slice(supporting, 1, SUPPORT).alias("supporting_entities"),
            text.alias("metrics"),
        )
    )


def told(template: str, value) -> list:
    """The parts of a text: literals as they are, value(name) for names in braces."""
    return [x for literal, name, _, _ in Formatter().parse(template) for x in ([literal] if literal else []) + ([value(name)] if name else [])]


def described(items: DataFrame) -> DataFrame:
    """Items with a description, made of their metrics; a metric that is absent or null is a dash."""
    metric = lambda name: F.element_at("metrics", F.lit(name))
    made = {"minutes": F.bround(metric("median_gap_hours").cast("double") * 60).cast("long").cast("string"), "weight": F.floor(metric("weight_per_member").cast("double")).cast("string")}

    def text(template: str) -> Column:
        return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in told(template, lambda name: F.coalesce(made.get(name, metric(name)), F.lit("-")))))

    of = lambda texts: by_severity(F.col("type"), {k: text(t) for k, t in texts.items()})
    special = [F.when(F.col("entity_type") == e, of(texts)) for e, texts in TEXTS.items() if e]
    return items.withColumn("description", F.coalesce(*special, of(TEXTS[""])))


def _none() -> Column:
    return F.expr("array()").cast("array<string>")


def first_of(rows: DataFrame, keys: list[str], column: str, name: str, keep: int = SUPPORT) -> DataFrame:
    """keys, n (distinct values of `column`) and the first `keep` of these as an array: a hot key's values are counted, never gathered in a row."""
    single = rows.select(*keys, column).dropna().distinct().repartition(*keys)
    # a number before the names, which sorts faster
    placed = single.withColumn("key", F.xxhash64(*keys)).withColumn("k", F.row_number().over(W.partitionBy("key", *keys).orderBy(column)))
    return placed.groupBy("key", *keys).agg(F.max("k").cast("long").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= keep, F.col(column)))).alias(name)).drop("key")


def _kinds_of(rows: DataFrame, kinds: list[str], *keep: str) -> DataFrame:
    """`keep`, kind, entity: a row for each entity of an edge."""
    parts = [F.expr(f"transform(coalesce({k}, array()), x -> named_struct('kind', '{k}', 'entity', x))") for k in kinds]
    return rows.select(*keep, F.explode(F.concat(*parts)).alias("x")).select(*keep, "x.kind", "x.entity")


def sharing(inside: DataFrame, *kinds: str) -> DataFrame:
    """Entities of some kinds on the internal edges of a community, by the number of accounts at their ends."""
    each = _kinds_of(inside, list(kinds), "community_id", "src", "dst")
    ends = each.select("community_id", "kind", "entity", F.explode(F.array("src", "dst")).alias("account"))
    found = first_of(ends, ["community_id", "kind", "entity"], "account", "accounts")
    metrics = {"entity": F.col("entity"), "account_count": F.col("n"), "sample": F.array_join(F.slice("accounts", 1, SAMPLE), ",")}
    return _shared_items(found, kinds, "COMMUNITY", F.col("community_id"), F.col("accounts"), metrics)


def _shared_items(found: DataFrame, kinds, entity_type: str, entity_id: Column, supporting: Column, metrics: dict[str, Column]) -> DataFrame:
    """Items on shared entities (kind, entity, n) of several kinds."""
    of = lambda make: F.coalesce(*(F.when(F.col("kind") == k, make(*SHARING[k])) for k in kinds))
    return item(found, entity_type, entity_id, of(lambda name, _: F.lit(name)), of(lambda _, bounds: steps(F.col("n"), bounds)), F.col("entity"), F.concat("entity", F.lit(": "), "n", F.lit(" accounts")), supporting, metrics)


def burst_windows(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """key, n, start, end: the earliest of the fullest windows of so many seconds, both ends included. Rows (key, timestamp).

    Rows are counted by time first; a block of `seconds` gets the rows of the
    next block as well, so no task needs a whole key's rows."""
    at = rows.groupBy(key, F.unix_micros("timestamp").alias("at")).count()
    size = seconds * 1_000_000
    block = F.floor(F.col("at") / size).cast("long")
    dealt = at.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("block", F.when(F.col("own"), block).otherwise(block - 1))
    frame = W.partitionBy(key, "block").orderBy("at").rangeBetween(W.currentRow, size)
    found = dealt.withColumn("n", F.sum("count").over(frame)).withColumn("end", F.max("at").over(frame)).filter("own")
    best = found.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "end")).alias("b"), F.sum("count").alias("total"))
    return best.select(key, (-F.col("b.n")).alias("n"), F.timestamp_micros("b.at").alias("start"), F.timestamp_micros("b.end").alias("end"), "total")


def bursts(rows: DataFrame, key: str, entity_type: str) -> DataFrame:
    """Evidence for the fullest hour, or failing that the fullest day, of each key. Rows (key, timestamp, transaction_id)."""
    # a row for each key at the most, which three parts read
    hour = cut(burst_windows(rows, key, 3600).filter("total >= 4").withColumn("severity", steps(F.col("n"), (15, 8), ("HIGH", "MEDIUM"))).filter("severity IS NOT NULL"), "hours")
    others = rows.select(key, "timestamp").join(hour.select(key).hint("merge"), key, "left_anti")
    day = burst_windows(others, key, 86400).filter("total >= 4").withColumn("severity", F.when(F.col("n") >= 4, "LOW"))
    inside = rows.join(hour.select(key, "start", "end").hint("merge"), key).filter(F.col("timestamp").between(F.col("start"), F.col("end")))
    first = F.row_number().over(W.partitionBy(key).orderBy("timestamp", "transaction_id"))
    support = inside.withColumn("k", first).filter(F.col("k") <= SUPPORT).groupBy(key).agg(F.array_sort(F.collect_set("transaction_id")).alias("support"))
    seconds = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    length = lambda unit: F.greatest(F.lit(1), F.bround(seconds / unit)).cast("int")

    def rows_of(found: DataFrame, window: str, unit: float, support: Column) -> DataFrame:
        metrics = {"transaction_count": F.col("n"), "window_length": length(unit), "start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "end": F.date_format("end", "yyyy-MM-dd HH:mm:ss")}
        return item(found, entity_type, F.col(key), "TEMPORAL_BURST", F.col("severity"), F.lit(window), F.format_string("%d transactions within %s", "n", F.lit(window)), support, metrics, F.col("start"))

    return rows_of(hour.join(support.hint("merge"), key, "left"), "60min", 60.0, F.coalesce("support", _none())).unionByName(rows_of(day, "24h", 3600.0, _none()))


def rapid(rows: DataFrame, key: str, entity_type: str) -> DataFrame:
    """Evidence for a small median gap between consecutive rows; equal times count."""
    between = cut(gaps(rows.select(key, "timestamp"), key), "gaps")
    found = between.groupBy(key).agg(F.min("gap").alias("least"), F.max("gap").alias("most"), (F.count("*") + 1).alias("n")).join(medians(between, key, "gap", stored=True).hint("merge"), key)
    severity = steps(F.col("median"), (0.5, 2.0, 6.0), test="__lt__")
    metrics = {"median_gap_hours": F.bround("median", 4), "min_gap_hours": F.bround("least", 4), "max_gap_hours": F.bround("most", 4), "transaction_count": F.col("n")}
    return item(found, entity_type, F.col(key), "RAPID_INTERACTION", severity, F.lit("gap"), F.format_string("median gap %.2f h", "median"), _none(), metrics)


#: The features that evidence reads.
DENSITY = ["member_count", "density", "mean_edge_weight", "weight_per_member"]


def density(features: DataFrame) -> DataFrame:
    severity = steps(F.col("weight_per_member"), (10.0, 3.0, 0.5), test="__gt__")
    metrics = {"weight_per_member": F.bround("weight_per_member", 4), "mean_edge_weight": F.bround(F.coalesce("mean_edge_weight", F.lit(0.0)), 4), "density": F.bround("density", 6), "member_count": F.col("member_count").cast("long")}
    return item(features, "COMMUNITY", F.col("community_id"), "HIGH_EVIDENCE_DENSITY", severity, F.lit("density"), F.format_string("weight per member %.2f", "weight_per_member"), _none(), metrics)


def degrees(membership: DataFrame, inside: DataFrame) -> DataFrame:
    """account_id, community_id, degree within the community, zeros included."""
    n = mirrored(inside.select("src", "dst")).groupBy("account_id").agg(F.count("*").alias("degree"))
    return membership.join(n.hint("merge"), "account_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def hub_rows(membership: DataFrame, inside: DataFrame) -> DataFrame:
    """Degrees with their community's percentiles and the share of members with no higher degree, where hubs can be told."""
    # percentiles, shares and rows all read these
    d = cut(degrees(membership, inside), "degrees")
    p = d.groupBy("community_id").agg(F.expr("percentile(degree, array(0.5, 0.75, 0.95))").alias("p"), F.count("*").alias("members"), F.sum("degree").alias("ends")).filter("members >= 2 AND ends > 0")
    # ranks over distinct degrees: a community's degrees are few, its members may be many
    n = d.groupBy("community_id", "degree").count()
    share = n.withColumn("upto", F.sum("count").over(W.partitionBy("community_id").orderBy("degree"))).drop("count")
    return d.join(p.hint("merge"), "community_id").join(share.hint("merge"), ["community_id", "degree"]).withColumn("rank_pct", F.col("upto") / F.col("members") * 100)


def hubs(membership: DataFrame, inside: DataFrame, entity_type: str = "COMMUNITY") -> DataFrame:
    """Hub accounts as evidence on their community, or on themselves."""
    rows = hub_rows(membership, inside)
    severity = hub_severity(F.col("degree"), F.col("p")[0], F.col("p")[1], F.col("p")[2])
    metrics = {"account_id": F.col("account_id"), "degree": F.col("degree"), "percentile_rank": F.bround("rank_pct", 1), "p50": F.bround(F.col("p")[0], 1), "p75": F.bround(F.col("p")[1], 1), "p95": F.bround(F.col("p")[2], 1), "community_size": F.col("members")}
    entity = F.col("community_id") if entity_type == "COMMUNITY" else F.col("account_id")
    return item(rows, entity_type, entity, "HUB_ACCOUNT", severity, F.col("account_id"), F.concat("account_id", F.lit(" has "), "degree", F.lit(" links")), F.array("account_id"), metrics)


def layers() -> tuple[Column, Column]:
    """(number, names joined by commas) of the kinds of evidence on an edge."""
    has = {k: F.size(k) > 0 for k in LAYERS}
    return sum((F.when(v, 1).otherwise(0) for v in has.values()), F.lit(0)), F.concat_ws(",", *(F.when(v, k) for k, v in has.items()))


def multi_layer(inside: DataFrame) -> DataFrame:
    n, names = layers()
    rows = inside.withColumn("n", n).withColumn("names", names)
    metrics = {"account_a": F.col("src"), "account_b": F.col("dst"), "layer_count": F.col("n"), "layers": F.col("names")}
    return item(rows, "COMMUNITY", F.col("community_id"), "MULTI_LAYER_EVIDENCE", steps(F.col("n"), (3, 2), ("HIGH", "MEDIUM")), F.concat_ws(":", "src", "dst"), F.concat("src", F.lit(" and "), "dst", F.lit(": "), "n", F.lit(" kinds")), F.array("src", "dst"), metrics)


def community_evidence(membership: DataFrame, inside: DataFrame, transactions: DataFrame, features: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Evidence on communities; features: those of DENSITY at least. rows: what `member_transactions` gives, where that is stored."""
    return distinct_items(community_items(membership, inside, transactions, features, rows))


def community_items(membership: DataFrame, inside: DataFrame, transactions: DataFrame, features: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The same, in which an item that is found twice is there twice."""
    if rows is None:
        # windows, their support and gaps all read these
        rows = cut(member_transactions(membership, transactions.select("transaction_id", "timestamp", "src_account_id", "dst_account_id")), "member-rows")
    rows = rows.select("community_id", "timestamp", "transaction_id")
    parts = [sharing(inside, *SHARING), bursts(rows, "community_id", "COMMUNITY"), rapid(rows, "community_id", "COMMUNITY"), density(features), hubs(membership, inside), multi_layer(inside)]
    return _union(parts)


def account_evidence(membership: DataFrame, inside: DataFrame, transactions: DataFrame) -> DataFrame:
    """Evidence on single accounts, from their own connections and transactions."""
    both = mirrored(inside)
    parts = []
    kinds = ["instruments", "devices", "ips"]
    found = first_of(_kinds_of(both, kinds, "account_id", "peer"), ["account_id", "kind", "entity"], "peer", "peers").withColumn("n", F.col("n") + 1)
    parts.append(_shared_items(found, kinds, "ACCOUNT", F.col("account_id"), F.col("peers"), {"entity": F.col("entity"), "account_count": F.col("n")}))
    n, names = layers()
    paired = both.withColumn("n", n).withColumn("names", names)
    parts.append(item(paired, "ACCOUNT", F.col("account_id"), "MULTI_LAYER_EVIDENCE", steps(F.col("n"), (3, 2), ("HIGH", "MEDIUM")), F.concat_ws(":", F.least("account_id", "peer"), F.greatest("account_id", "peer")), F.format_string("%s: %d kinds", "peer", "n"), F.array("peer"), {"peer": F.col("peer"), "layer_count": F.col("n"), "layers": F.col("names")}))
    own = transactions.select(F.explode(F.array_distinct(F.array("src_account_id", "dst_account_id"))).alias("account_id"), "timestamp", "transaction_id")
    own = cut(own, "account-transactions")
    parts += [bursts(own, "account_id", "ACCOUNT"), rapid(own, "account_id", "ACCOUNT"), hubs(membership, inside, "ACCOUNT")]
    return distinct_items(_union(parts))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_items(items: DataFrame) -> DataFrame:
    # repeated items are few: all move at once, and are sorted by what tells most of them apart
    return items.repartition("evidence_id").dropDuplicates(["evidence_id", "entity_id", "entity_type"])


def severity_order(severity: Column) -> Column:
    return by_severity(severity, {k: F.lit(v) for k, v in ORDER.items()})


def ordered(items: DataFrame) -> DataFrame:
    """Items with their place on their entity: severity, points, id."""
    place = F.row_number().over(W.partitionBy("entity_type", "entity_id").orderBy(severity_order(F.col("severity")), F.desc("points"), "evidence_id"))
    return items.withColumn("place", place)


def score() -> Column:
    """The score of rows with points: their sum, 100 at most."""
    return F.least(F.lit(100), F.sum("points")).cast("int")


def scores(items: DataFrame) -> DataFrame:
    """Per entity: score (at most 100), raw score, items by severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower() + "_count")
    return items.groupBy("entity_type", "entity_id").agg(score().alias("evidence_score"), F.sum("points").alias("raw_score"), F.count("*").alias("item_count"), *map(n, POINTS))


def families(items: DataFrame) -> DataFrame:
    """Per entity and signal family: items, points, share of the entity's strongest family."""
    family = by_severity(F.col("type"), FAMILIES)
    n = items.groupBy("entity_type", "entity_id", family.alias("family")).agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    return n.withColumn("share", F.col("points") / F.max("points").over(W.partitionBy("entity_type", "entity_id")))


def matches(items: DataFrame, transactions: DataFrame) -> DataFrame:
    """evidence_id, transaction_id: transactions that an item names, or that fall into its window on the same entity."""
    named = items.select("entity_type", "entity_id", "evidence_id", F.explode("supporting_entities").alias("transaction_id")).filter(F.col("transaction_id").startswith("tx_"))
    timed = items.filter("observed_at IS NOT NULL").select("entity_type", "entity_id", "evidence_id", F.col("observed_at").alias("from"), F.to_timestamp(F.element_at("metrics", F.lit("end"))).alias("to"))
    inside = within(timed, transactions.select("entity_id", "transaction_id", "timestamp"), "entity_id", ("from", "to"), "timestamp")
    return named.unionByName(inside.select(*named.columns)).distinct()


def subjects(items: DataFrame) -> DataFrame:
    """What an item is about: subject (transactions, accounts or community), transaction_count, window_minutes, account_count, first_accounts."""
    measure = lambda name: F.try_element_at("metrics", F.lit(name))
    accounts = F.filter("supporting_entities", lambda x: x.rlike("(?i)^acc"))
    others = F.size("supporting_entities") - F.size(accounts)
    counted = measure("transaction_count").cast("long")
    span = F.unix_timestamp(measure("end"), "yyyy-MM-dd HH:mm:ss") - F.unix_timestamp(measure("start"), "yyyy-MM-dd HH:mm:ss")
    window = F.coalesce(measure("window_minutes").cast("long"), F.when(span.isNotNull(), F.greatest(F.lit(1), F.bround(span / 60))).cast("long"))
    n = F.coalesce(counted, F.when(window.isNotNull() | (others > 0), others).cast("long"))
    subject = F.when(n.isNotNull(), "transactions").when(F.size(accounts) > 0, "accounts").otherwise("community")
    return items.select("entity_type", "entity_id", "evidence_id", subject.alias("subject"), n.alias("transaction_count"), window.alias("window_minutes"), F.size(accounts).alias("account_count"), F.array_join(F.slice(accounts, 1, 3), ", ").alias("first_accounts"))


def touching(items: DataFrame) -> DataFrame:
    """account_id and the evidence items that name it among their supporting entities."""
    rows = items.select(F.explode("supporting_entities").alias("account_id"), "entity_type", "entity_id", "evidence_id", "type", "severity")
    return rows.filter(F.col("account_id").rlike("(?i)^acc")).distinct()
