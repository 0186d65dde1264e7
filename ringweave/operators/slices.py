"""Graph slices around focal accounts, for all communities at once, and paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .evidence import degrees
from .graph import mirrored, parties, project
from .marts import pairs
from .stored import cut

#: Accounts or classes of a step of a path that are broadcast; more are joined by shuffles.
FEW = 200_000
KINDS = ("devices", "instruments", "ips", "merchants")


def flow_direction(forward: Column, reverse: Column) -> Column:
    return F.when((forward > 0) & (reverse > 0), "bidirectional").when(forward > 0, "source_to_target").when(reverse > 0, "target_to_source")


def nodes(membership: DataFrame, inside: DataFrame, accounts: DataFrame, transactions: DataFrame, focal: DataFrame, most: int = 150) -> DataFrame:
    """community_id, account_id, degree, balance, place: the best connected members, the focal account, its neighbours and counterparties. focal: community_id, focal."""
    d = degrees(membership, inside)
    top = d.withColumn("k", F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("degree"), "account_id"))).filter(F.col("k") <= most).select("community_id", "account_id")
    own = focal.select("community_id", F.col("focal").alias("account_id"))
    near = mirrored(inside.select("community_id", "src", "dst")).join(focal, "community_id").filter("account_id = focal").select("community_id", F.col("peer").alias("account_id"))
    flows = mirrored(pairs(transactions).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    paid = flows.join(focal, flows.account_id == focal.focal).select("community_id", F.col("peer").alias("account_id")).join(membership, ["community_id", "account_id"], "left_semi")
    chosen = top.unionByName(own).unionByName(near).unionByName(paid).distinct()
    rows = chosen.join(d, ["community_id", "account_id"], "left").join(accounts.select("account_id", "balance"), "account_id", "left").join(focal, "community_id", "left")
    first = F.when(F.col("account_id") == F.col("focal"), 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("community_id").orderBy(first, F.desc(F.coalesce("degree", F.lit(0))), F.desc(F.coalesce("balance", F.lit(0.0))), "account_id"))
    return rows.select("community_id", "account_id", F.coalesce("degree", F.lit(0)).alias("degree"), "balance", place.alias("place"))


def edges(chosen: DataFrame, inside: DataFrame, transactions: DataFrame, focal: DataFrame, most: int = 500) -> DataFrame:
    """Edges among the chosen nodes: all of the focal account, then the heaviest up to `most`; with flows, and flow-only edges of the focal account."""
    members = chosen.select("community_id", "account_id")
    both = inside.join(members.withColumnRenamed("account_id", "src"), ["community_id", "src"], "left_semi").join(members.withColumnRenamed("account_id", "dst"), ["community_id", "dst"], "left_semi")
    rows = both.join(focal, "community_id", "left").withColumn("is_focal", F.coalesce((F.col("src") == F.col("focal")) | (F.col("dst") == F.col("focal")), F.lit(False)))
    n_focal = rows.groupBy("community_id").agg(F.count_if("is_focal").alias("n_focal"))
    k = F.row_number().over(W.partitionBy("community_id", "is_focal").orderBy(F.desc("weight"), "src", "dst"))
    rows = rows.withColumn("k", k).join(n_focal, "community_id").filter(F.col("is_focal") | (F.col("k") <= F.greatest(F.lit(0), F.lit(most) - F.col("n_focal"))))
    flow = pairs(transactions)
    rows = rows.join(flow, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    known = rows.select("community_id", "src", "dst", "weight", "is_focal", "temporal_overlap", *KINDS, count("forward_count").alias("forward"), count("reverse_count").alias("reverse"), (count("forward_amount") + count("reverse_amount")).alias("amount"))
    # two equi-joins, as the focal account may be either end
    ends = lambda own, other: flow.filter("a <> b").join(focal.hint("merge"), F.col(own) == F.col("focal")).withColumn("other", F.col(other))
    lone = ends("a", "b").unionByName(ends("b", "a")).join(members.withColumnRenamed("account_id", "other"), ["community_id", "other"], "left_semi")
    lone = lone.join(inside.select("community_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["community_id", "a", "b"], "left_anti")
    ahead = F.col("forward_count") > 0  # along the forward flow, if there is one
    none = F.expr("array()").cast("array<string>")
    lone = lone.select(
        "community_id", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("dst"), F.lit(1.0).alias("weight"), F.lit(True).alias("is_focal"), F.lit(0).alias("temporal_overlap"),
        *(none.alias(k) for k in KINDS), F.when(ahead, F.col("forward_count")).otherwise(F.col("reverse_count")).alias("forward"), F.when(ahead, F.col("reverse_count")).otherwise(F.lit(0)).alias("reverse"), (F.col("forward_amount") + F.col("reverse_amount")).alias("amount"),
    )
    out = known.unionByName(lone).withColumn("direction", flow_direction(F.col("forward"), F.col("reverse"))).withColumn("transactions", F.col("forward") + F.col("reverse"))
    place = F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("is_focal"), F.desc("weight"), "src", "dst"))
    return out.withColumn("place", place).drop("forward", "reverse")


def relation(transactions: Column) -> Column:
    """The type of an edge: MULTI_LAYER for two signals or more, else the one there is."""
    signs = {"TRANSACTION_FLOW": transactions > 0, "SHARED_DEVICE": F.size("devices") > 0, "SHARED_INSTRUMENT": F.size("instruments") > 0, "SHARED_IP": F.size("ips") > 0, "SHARED_MERCHANT": F.size("merchants") > 0, "TEMPORAL_OVERLAP": F.col("temporal_overlap") > 0}
    n = sum((s.cast("int") for s in signs.values()), F.lit(0))
    out = F.when(n >= 2, "MULTI_LAYER")
    for name, sign in signs.items():
        out = out.when(sign, name)
    return out.otherwise("WEIGHT_ONLY")


def reasons() -> Column:
    """Lines that tell why two accounts are linked: ids by kind, three at most, and how many more."""
    def line(kind: str) -> Column:
        more = F.when(F.size(kind) > 3, F.concat(F.lit(" (+"), F.size(kind) - 3, F.lit(")"))).otherwise("")
        return F.when(F.size(kind) > 0, F.concat(F.lit(kind + ": "), F.array_join(F.slice(kind, 1, 3), ", "), more))

    flow = F.when(F.col("transactions") > 0, F.concat(F.lit("flow: "), F.col("transactions").cast("string"), F.lit(" "), F.col("direction")))
    days = F.when(F.col("temporal_overlap") > 0, F.concat(F.lit("days: "), F.col("temporal_overlap").cast("string")))
    return F.array_compact(F.array(flow, *(line(k) for k in KINDS), days))


def lens(slice_edges: DataFrame, which: str) -> DataFrame:
    """The edges of a slice that a lens shows; flow of funds keeps to the focal account where that has flows."""
    if which == "community":
        return slice_edges
    if which == "relationship":
        return slice_edges.filter("is_focal")
    if which == "shared-infrastructure":
        return slice_edges.filter((F.size("devices") > 0) | (F.size("instruments") > 0) | (F.size("ips") > 0))
    if which == "temporal":
        return slice_edges.filter("temporal_overlap > 0")
    flows = slice_edges.filter("transactions > 0")
    own = flows.groupBy("community_id").agg(F.max("is_focal").alias("own"))
    return flows.join(own, "community_id").filter("is_focal OR NOT own").drop("own")


def lens_nodes(shown: DataFrame) -> DataFrame:
    return shown.select("community_id", F.explode(F.array("src", "dst")).alias("account_id")).distinct()


def threads(inside: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per account: peers, shared counts, overlap days, links with several kinds of evidence, strongest peer, flow totals."""
    both = mirrored(inside)
    kinds = sum(((F.size(k) > 0).cast("int") for k in ("devices", "instruments", "ips")), F.lit(0)) + (F.col("temporal_overlap") > 0).cast("int")
    flow = mirrored(pairs(transactions).filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("forward_count") + F.col("reverse_count")).alias("n"), (F.col("forward_amount") + F.col("reverse_amount")).alias("amount")))
    rows = both.join(flow.hint("merge"), ["account_id", "peer"], "left").withColumn("kinds", kinds + (F.coalesce("n", F.lit(0)) > 0).cast("int"))
    size = lambda k: F.sum(F.size(k)).alias(f"{k}_links")
    return rows.groupBy("account_id").agg(
        F.count("*").alias("peers"), size("devices"), size("instruments"), size("ips"), size("merchants"), F.sum("temporal_overlap").alias("overlap_days"), F.count_if(F.col("kinds") >= 2).alias("multi_layer"),
        F.min(F.struct((-F.col("weight")).alias("w"), "peer"))["peer"].alias("strongest"), F.sum(F.coalesce("n", F.lit(0))).alias("transfers"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("flow_amount"),
    )


def roles(members: DataFrame, timeline: DataFrame, keep: int = 6) -> DataFrame:
    """The best connected members of each community and their part: hub, intermediary, source or member. members: community_id, account_id, degree, balance."""
    k = F.row_number().over(W.partitionBy("community_id").orderBy(F.desc("degree"), F.desc("balance"), "account_id"))
    top = members.withColumn("k", k).filter(F.col("k") <= keep)
    seen = lambda c, name: timeline.select("community_id", F.col(c).alias("account_id"), F.lit(True).alias(name)).distinct()
    rows = top.join(seen("src_account_id", "sends").hint("merge"), ["community_id", "account_id"], "left").join(seen("dst_account_id", "receives").hint("merge"), ["community_id", "account_id"], "left")
    role = F.when(F.col("degree") >= 4, "HUB").when(F.col("sends") & F.col("receives"), "INTERMEDIARY").when(F.col("sends"), "SOURCE").otherwise("MEMBER")
    return rows.select("community_id", "account_id", "degree", role.alias("role"))


def flow_chain(timeline: DataFrame, keep: int = 5) -> DataFrame:
    """The first events of each community as hops. Only the last of all events counts as final."""
    part = F.when(F.col("place") == 1, "origin").when(F.col("place") == F.col("total"), "final").otherwise("hop")
    return timeline.filter(F.col("place") <= keep).select("community_id", "place", "transaction_id", "src_account_id", "dst_account_id", "amount", part.alias("part"))


#: Transactions of a community that a storyline shows.
MOVES = 4


def storyline(accounts: DataFrame, items: DataFrame, timeline: DataFrame) -> DataFrame:
    """community_id, stage, place, entity: five stages, each cut to its first rows. accounts: community_id, account_id; items: ordered evidence of communities."""
    def capped(rows: DataFrame, stage: str, by: list, keep: int) -> DataFrame:
        k = F.row_number().over(W.partitionBy("community_id").orderBy(*by))
        return rows.withColumn("place", k).filter(F.col("place") <= keep).select("community_id", F.lit(stage).alias("stage"), "place", "entity")

    def of(kinds) -> DataFrame:
        return items.filter(F.col("type").isin(*kinds)).select(F.col("entity_id").cast("long").alias("community_id"), F.col("evidence_id").alias("entity"), F.col("place").alias("by"))

    parts = [
        capped(accounts.select("community_id", F.col("account_id").alias("entity")), "onboarding", ["entity"], 4),
        capped(of(("SHARED_INSTRUMENT_CONCENTRATION", "DEVICE_REUSE", "IP_CONCENTRATION", "HUB_ACCOUNT")), "infrastructure", ["by"], 4),
        capped(of(("TEMPORAL_BURST", "RAPID_INTERACTION", "HIGH_EVIDENCE_DENSITY")), "velocity", ["by"], 3),
        timeline.filter(F.col("place") <= MOVES).select("community_id", F.lit("movement").alias("stage"), "place", F.col("transaction_id").alias("entity")),
        capped(of(("MERCHANT_TEMPORAL_OVERLAP",)), "merchant", ["by"], 3),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ways(edges: DataFrame) -> DataFrame:
    """What paths go along, stored: each edge from either end (account_id, peer), or, given classes (class_id, account_id: what `incidence.memberships` returns), those of two accounts or more."""
    if "class_id" in edges.columns:
        of = W.partitionBy("class_id").orderBy("account_id")
        some = edges.select("class_id", "account_id").withColumns({"place": F.row_number().over(of), "next": F.lead("account_id").over(of)}).filter("place > 1 OR next IS NOT NULL")
        return cut(some.select("class_id", "account_id"), "reach-classes")
    return cut(mirrored(edges.select("src", "dst")).select("account_id", "peer"), "reach-edges")


def _near(both: DataFrame, of: DataFrame) -> DataFrame:
    """account_id, parent: the neighbours of some accounts, and the smallest of these that each is a neighbour of.

    The members of a class are neighbours of each other, so a class needs the smallest one only, and no pair is made; the accounts themselves are among the neighbours then."""
    own = of.select("account_id")
    few = own.limit(FEW + 1).count() <= FEW
    here = both.join(F.broadcast(own) if few else own.hint("merge"), "account_id")
    if "class_id" not in both.columns:
        return here.groupBy("peer").agg(F.min("account_id").alias("parent")).withColumnRenamed("peer", "account_id")
    first = here.groupBy("class_id").agg(F.min("account_id").alias("parent"))
    if few:
        first = cut(first, "reach-met")
        few = first.limit(FEW + 1).count() <= FEW
    return both.join(F.broadcast(first) if few else first.hint("merge"), "class_id").groupBy("account_id").agg(F.min("parent").alias("parent"))


def _next(both: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The accounts one step beyond the last of `levels`, with the smallest account that they are reached from. Neighbours of a level lie in it, before it or beyond it, so only two levels are looked up."""
    step = _near(both, levels[-1])
    for known in levels[-2:]:
        # an outer join, as an anti join would be pushed below the grouping, where it shuffles all that paths go along
        step = step.join(known.select("account_id", F.lit(True).alias("known")).hint("merge"), "account_id", "left").filter("known IS NULL").drop("known")
    return cut(step.select("account_id", F.lit(len(levels)).alias("hops"), "parent"), "reach-frontier")


def _few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table, for which no Python worker starts."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kind = ",".join(c.replace(" ", ":") for c in schema.split(", "))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def _start(both: DataFrame, account: str) -> DataFrame:
    return _few(both.sparkSession, [(account, 0, None)], "account_id string, hops int, parent string")


def reach(edges: DataFrame, start: str, depth: int | None = 6) -> DataFrame:
    """account_id, hops, parent for what can be reached over undirected edges in `depth` steps, in any number for None."""
    both = _ways(edges)
    levels = [_start(both, start)]
    while depth is None or len(levels) <= depth:
        beyond = _next(both, levels)
        if beyond.isEmpty():
            break
        levels.append(beyond)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _hops(both: DataFrame, start: str, end: str) -> list[tuple[str, str]]:
    """(from, to) of each hop of a path with the fewest hops; of several the one that takes, from the end backwards, the smallest account each time.

    Levels grow from both ends, the smaller outermost one first, until they meet.
    From where they meet, the accounts of the end's levels that lie on a shortest
    path are marked back to the end."""
    sides, sizes = ([_start(both, start)], [_start(both, end)]), [1, 1]
    if start == end:
        return []
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        beyond = _next(both, sides[k])
        sizes[k] = beyond.count()
        if not sizes[k]:
            return []
        sides[k].append(beyond)
        met = sides[0][-1].join(sides[1][-1].select("account_id").hint("merge"), "account_id", "left_semi")
        if not met.isEmpty():
            break
    alive = [cut(met.select("account_id"), "reach-met")]
    for level in sides[1][-2::-1]:
        near = _near(both, alive[-1]).select("account_id")
        alive.append(cut(near.join(level.select("account_id").hint("merge"), "account_id"), "reach-met"))
    path, at = [], end
    for on_path in alive[-2::-1]:
        one = _few(both.sparkSession, [(at,)], "account_id string")
        last = _near(both, one).join(on_path.select("account_id").hint("merge"), "account_id").agg(F.min("account_id")).first()[0]
        path.append((last, at))
        at = last
    for level in sides[0][:0:-1]:
        last = level.filter(F.col("account_id") == at).first()["parent"]
        path.append((last, at))
        at = last
    return path[::-1]


def _path(edges: DataFrame, start: str, end: str) -> DataFrame:
    hops = [(k + 1, a, b, min(a, b), max(a, b)) for k, (a, b) in enumerate(_hops(_ways(edges), start, end))]
    return _few(edges.sparkSession, hops, "hop int, src string, dst string, a string, b string")


def class_path(classes: DataFrame, start: str, end: str, accounts: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """`shortest_path` over classes of accounts that share something (`incidence.memberships`): no pair is made but those among the accounts of the path."""
    path = cut(_path(classes, start, end), "path")
    # as many accounts as the path has
    on_path = path.select(F.explode(F.array("src", "dst")).alias("account_id")).distinct()
    moves = parties(transactions).join(F.broadcast(on_path), "account_id", "left_semi").select("transaction_id").distinct()
    own = transactions.join(moves.hint("merge"), "transaction_id", "left_semi")
    edges = project(accounts.join(F.broadcast(on_path), "account_id", "left_semi"), links.join(F.broadcast(on_path), "account_id", "left_semi"), own)
    return _relations(path, edges, own)


def shortest_path(edges: DataFrame, start: str, end: str, transactions: DataFrame | None = None) -> DataFrame:
    """hop, src, dst and, where edges tell kinds, the relation of each hop of a path with the fewest edges, however long; none if there isn't any."""
    path = _path(edges, start, end)
    if "devices" not in edges.columns:
        return path.select("hop", "src", "dst")
    return _relations(path, edges, transactions)


def _relations(path: DataFrame, edges: DataFrame, transactions: DataFrame | None) -> DataFrame:
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *KINDS, "temporal_overlap")
    rows = path.hint("broadcast").join(known, ["a", "b"])  # a row for each hop
    if transactions is None:
        return rows.select("hop", "src", "dst", relation(F.lit(0)).alias("relation"))
    flow = pairs(transactions).select("a", "b", (F.col("forward_count") + F.col("reverse_count")).alias("n"))
    return rows.join(flow.hint("merge"), ["a", "b"], "left").select("hop", "src", "dst", relation(F.coalesce("n", F.lit(0))).alias("relation"))
