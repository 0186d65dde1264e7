"""Communities: structure, activity over time, modularity, and detection by moves, refinement and contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import modulo, stable_int
from . import blocks
from .graph import mirrored
from .selection import medians
from .stored import cut, dealt

HOUR = 3600.0


def numbered(rows: DataFrame, by: list, name: str = "number") -> DataFrame:
    """`rows` with their place in the order of `by`, from 1: ranges of rows are counted first and numbered on their own, so no task sees all rows."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("range_id", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range_id").agg(F.count("*").alias("n"))
    # a row for each range, of which there are as many as shuffle partitions
    before = sizes.select("range_id", (F.sum("n").over(W.orderBy("range_id")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("range_id").orderBy(*by))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range_id").withColumn(name, F.col("inside") + F.col("before")).drop("inside", "before", "range_id")


def canonical(membership: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their smallest member."""
    first = membership.groupBy("community_id").agg(F.min("account_id").alias("first"))
    number = numbered(first, ["first"]).select("community_id", (F.col("number") - 1).cast("long").alias("number"))
    return membership.join(number.hint("merge"), "community_id").select("account_id", F.col("number").alias("community_id"))


def structure(membership: DataFrame, inside: DataFrame) -> DataFrame:
    """community_id, member_count, internal_edges, total_weight, density; communities without edges stay."""
    members = membership.groupBy("community_id").agg(F.count("*").alias("member_count"))
    edges = inside.groupBy("community_id").agg(F.count("*").alias("internal_edges"), F.sum("weight").alias("total_weight"))
    n, e = F.col("member_count"), F.coalesce("internal_edges", F.lit(0))
    density = F.when(n < 2, 0.0).otherwise(F.bround(e / (n * (n - 1) / 2), 6))
    return members.join(edges, "community_id", "left").select("community_id", "member_count", e.alias("internal_edges"), F.bround(F.coalesce("total_weight", F.lit(0.0)), 6).alias("total_weight"), density.alias("density"))


def activity(transactions: DataFrame) -> DataFrame:
    """account_id, timestamp: distinct times at which an account sent or received."""
    return transactions.select(F.explode(F.array("src_account_id", "dst_account_id")).alias("account_id"), "timestamp").distinct()


def gaps(times: DataFrame, key: str) -> DataFrame:
    """key, gap (hours) between consecutive rows of `times` (key, timestamp). Days are handled on their own, so no task needs a whole key's rows."""
    day = times.withColumn("day", F.to_date("timestamp"))
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)
    inside = day.withColumn("before", F.lag("timestamp").over(W.partitionBy(key, "day").orderBy("timestamp"))).filter("before IS NOT NULL")
    edges = day.groupBy(key, "day").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(W.partitionBy(key).orderBy("day"))).filter("before IS NOT NULL")
    gap = lambda df, a: df.select(key, (seconds(F.col(a), F.col("before")) / HOUR).alias("gap"))
    return gap(inside, "timestamp").unionByName(gap(across, "first"))


def activity_stats(membership: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per community over the distinct times of its members: count, active hours, median gap, span, compression, first and last."""
    return stats_of(activity(transactions).join(membership.hint("merge"), "account_id").select("community_id", "timestamp"))


def stats_of(rows: DataFrame) -> DataFrame:
    """The same from the times (community_id, timestamp) of a community's members, each any number of times."""
    # counts and both kinds of gaps read these
    times = cut(rows.distinct(), "activity-times")
    basic = times.groupBy("community_id").agg(F.count("*").alias("tx_count"), F.countDistinct(F.date_trunc("hour", "timestamp")).alias("active_hours"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    typical = medians(gaps(times, "community_id"), "community_id", "gap").withColumnRenamed("median", "median_gap_hours")
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6) / HOUR
    return basic.join(typical.hint("merge"), "community_id", "left").withColumn("span_hours", span).withColumn("compression", F.col("tx_count") / (F.col("tx_count") + F.col("span_hours")))


def summary(structures: DataFrame, stats: DataFrame, top: int = 10) -> DataFrame:
    """metric, key, value: size histogram, counts of sizes, the largest communities, range of compression."""
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    histogram = structures.groupBy("member_count").count().select(row("size", F.col("member_count"), F.col("count")).alias("r"))
    sizes = structures.agg(F.count("*").alias("n"), F.count_if(F.col("member_count") >= 2).alias("two"), F.count_if(F.col("member_count") >= 3).alias("three"), F.sum("member_count").alias("accounts"))
    total = sizes.select(F.explode(F.array(*(row("total", F.lit(k), F.col(k)) for k in ("n", "two", "three", "accounts")))).alias("r"))
    largest = structures.orderBy(F.desc("member_count"), "community_id").limit(top).select(row("largest", F.col("community_id"), F.col("member_count")).alias("r"))
    spread = stats.agg(F.avg("compression").alias("mean"), F.max("compression").alias("most")).select(F.explode(F.array(row("compression", F.lit("mean"), F.col("mean")), row("compression", F.lit("max"), F.col("most")))).alias("r"))
    return histogram.unionByName(total).unionByName(largest).unionByName(spread).select("r.*")


def modularity(membership: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition; edges (src, dst, weight) may hold loops."""
    side = lambda name: membership.select(F.col("account_id").alias(name), F.col("community_id").alias(f"{name}_c"))
    both = edges.join(side("src").hint("merge"), "src").join(side("dst").hint("merge"), "dst")
    ends = both.select(F.explode(F.array(F.struct(F.col("src_c").alias("c"), F.when(F.col("src_c") == F.col("dst_c"), F.col("weight")).otherwise(0.0).alias("in")), F.struct(F.col("dst_c").alias("c"), F.lit(0.0).alias("in")))).alias("x"), "weight")
    parts = ends.groupBy("x.c").agg(F.sum("x.in").alias("inside"), F.sum("weight").alias("k"))
    total = F.sum("k")  # twice the weight of all edges
    return parts.agg((2 * F.sum("inside") / total - resolution * F.sum(F.col("k") * F.col("k")) / (total * total)).alias("modularity"))


def shares(membership: DataFrame, edges: DataFrame, inside: DataFrame, resolution: float = 1.0) -> DataFrame:
    """community_id, modularity_share: what each community adds to the modularity of the partition; 0 without edges. inside: the edges within communities."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("account_id"), "weight").groupBy("account_id").agg(F.sum("weight").alias("k"))
    strength = membership.join(ends.hint("merge"), "account_id", "left").groupBy("community_id").agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"))
    within = inside.groupBy("community_id").agg(F.sum("weight").alias("inside"))
    rows = strength.join(within.hint("merge"), "community_id", "left")
    total = strength.agg(F.nullif(F.sum("k"), F.lit(0.0)).alias("total"))  # one row: twice the weight of all edges
    part = 2 * F.coalesce("inside", F.lit(0.0)) / F.col("total") - resolution * F.col("k") * F.col("k") / (F.col("total") * F.col("total"))
    return rows.crossJoin(F.broadcast(total)).select("community_id", F.coalesce(part, F.lit(0.0)).alias("modularity_share"))


def _weighed_moves(state: DataFrame, both: DataFrame, m2: float, resolution: float, fresh: int | None = None) -> DataFrame:
    """A row for each node of `state` (node, comm, k, loop): that, its community's total, here (its weight to it), and the best move: target, gain (null without one). With `fresh`, what no community's number is above its node yet, a node may also leave for a community of its own.

    `both` lies by peer, where the communities come to it; its rows move once, to the node, with all that is needed of their communities."""
    totals = state.groupBy("comm").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    own = state.join(totals.hint("merge"), "comm")
    at = own.select(F.col("node").alias("peer"), F.col("comm").alias("target"), F.col("total").alias("of_target"))
    near = both.join(at.hint("shuffle_hash"), "peer").select("node", "target", "of_target", "weight").repartition("node")
    near = near.groupBy("node", "target").agg(F.sum("weight").alias("w"), F.max("of_target").alias("of_target"))
    value = F.col("w") - resolution * F.col("k") * F.col("of_target") / m2
    away = F.col("target") != F.col("comm")
    kept = [F.first(c).alias(c) for c in ("comm", "k", "loop", "total", "size")]
    rows = own.join(near.hint("merge"), "node", "left").groupBy("node").agg(*kept, F.max(F.when(~away, F.col("w"))).alias("here"), F.min(F.when(away, F.struct((-value).alias("loss"), F.col("target").alias("to")))).alias("best"))
    rows = rows.withColumn("here", F.coalesce("here", F.lit(0.0)))
    stay = F.col("here") - resolution * F.col("k") * (F.col("total") - F.col("k")) / m2
    rows = rows.withColumn("target", F.col("best.to")).withColumn("gain", -F.col("best.loss") - stay).drop("best")
    if fresh is None:
        return rows
    leaves = (F.col("size") > 1) & (-stay > F.coalesce("gain", F.lit(0.0)))
    return rows.withColumn("target", F.when(leaves, F.col("node") + fresh).otherwise(F.col("target"))).withColumn("gain", F.when(leaves, -stay).otherwise(F.col("gain")))


def _best(state: DataFrame, both: DataFrame | blocks.Blocks, m2: float, resolution: float, fresh: int | None = None, stays: Column | None = None) -> DataFrame:
    """The same of blocks, where edges don't move, or of edges by peer."""
    if isinstance(both, blocks.Blocks):
        return blocks.moves(state, both, m2, resolution, fresh, stays)
    return _weighed_moves(state, both, m2, resolution, fresh)


def _step(state: DataFrame, both: DataFrame | blocks.Blocks, m2: float, resolution: float, taken: Column, name: str, fresh: int | None = None, stays: Column | None = None) -> tuple[DataFrame, float, int]:
    """(the state after the moves of `taken`, modularity of the state before, how many nodes had a move that improves): one job, and a sum over the rows that it wrote."""
    rows = _best(state, both, m2, resolution, fresh, stays)
    improves = F.coalesce(F.col("gain") > 1e-9, F.lit(False))
    part = (F.col("here") + F.col("loop")) / m2 - resolution * F.col("k") * F.col("total") / (m2 * m2)
    moved = F.when(improves & taken, F.col("target")).otherwise(F.col("comm"))
    outer = [] if stays is None else ["outer"]
    after = cut(rows.select("node", moved.alias("comm"), "k", "loop", *outer, part.alias("part"), improves.alias("improves")), name)
    seen = after.agg(F.sum("part").alias("quality"), F.count_if("improves").alias("movers")).first()
    return after.drop("part", "improves"), seen["quality"] or 0.0, seen["movers"]


def _apart(state: DataFrame, both: DataFrame | blocks.Blocks, m2: float, resolution: float, fresh: int) -> DataFrame:
    """`state` after moves that are the best ones at both communities they touch: modularity rises by the sum of their gains."""
    moves = _best(state, both, m2, resolution, fresh).filter("gain > 1e-9").select("node", "comm", "target", "gain")
    touched = moves.withColumn("c", F.explode(F.array("comm", "target")))
    first = touched.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "node", "target")).alias("s"))
    alone = first.groupBy("s.node", "s.target").agg(F.count("*").alias("n")).filter("n = 2").select("node", F.col("target").alias("to"))
    return cut(state.join(alone.hint("merge"), "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "k", "loop"), "louvain-state")


def _moved(state: DataFrame, both: DataFrame | blocks.Blocks, m2: float, resolution: float, seed: str, rounds: int, least: float) -> tuple[DataFrame, float, float]:
    """(state, modularity before, modularity after) of moves in rounds.

    A round takes the hash-chosen half of all moves that improve, and writes with
    each node its share of the modularity that the round started from. A round that made things
    worse is known by the next one's job, and taken back: moves that can't disturb
    each other are made in its place."""
    kept, best, start = None, float("-inf"), 0.0
    careful = False
    for r in range(rounds):
        half = modulo(stable_int(F.col("node"), f"{seed}-{r}"), 2) == 0
        after, quality, movers = _step(state, both, m2, resolution, half, "louvain-state", r + 1)
        if kept is None:
            start = quality
        elif quality <= best + 1e-12:
            if careful:
                break
            state, careful = _apart(kept, both, m2, resolution, r + 1), True
            continue
        careful = False
        rise, kept, best = quality - best, state, quality
        if not movers or rise < least:
            break
        state = after
    return kept, start, best


def _refined(state: DataFrame, both: DataFrame | blocks.Blocks, m2: float, resolution: float, seed: str, rounds: int = 4) -> DataFrame:
    """`state` with parts of its communities as comm, and the communities as outer: parts are connected, as nodes only join, alone, a part with which they share an edge and which stays.

    A community that hangs together badly is left in several parts, which later moves can take apart."""
    outer = state.select("node", F.col("comm").alias("outer"))
    whole = isinstance(both, blocks.Blocks)
    if whole:
        parts = cut(state.select("node", F.col("node").alias("comm"), "k", "loop", F.col("comm").alias("outer")), "louvain-parts")
    else:
        peers = outer.withColumnsRenamed({"node": "peer", "outer": "peers"})
        inside = both.join(peers.hint("shuffle_hash"), "peer").join(outer.hint("shuffle_hash"), "node").filter("outer = peers").select("node", "peer", "weight")
        inside = dealt(inside, "louvain-inside", "peer")
        parts = cut(state.select("node", F.col("node").alias("comm"), "k", "loop"), "louvain-parts")
    for r in range(rounds):
        # a part with the other half's name stays, so what joins it is connected to it
        goes = lambda c, r=r: modulo(stable_int(F.col(c), f"{seed}-part-{r}"), 2) == 0
        alone = (F.col("size") == 1) & goes("comm")
        if whole:
            parts, _, movers = _step(parts, both, m2, resolution, alone, "louvain-parts", stays=~goes("comm"))
        else:
            stays = inside.join(parts.select(F.col("node").alias("peer"), F.col("comm").alias("part")).hint("shuffle_hash"), "peer").filter(~goes("part")).select("node", "peer", "weight")
            parts, _, movers = _step(parts, stays, m2, resolution, alone, "louvain-parts")
        if not movers and r:
            break
    return parts if whole else parts.join(outer, "node")


def _contracted(parts: DataFrame, both: DataFrame | blocks.Blocks) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(level, both, state): node and the part's name, its smallest node; edges between parts; the parts as nodes, in their communities."""
    names = parts.groupBy("comm").agg(F.min("node").alias("name"))
    level = cut(parts.join(names, "comm").select("node", "name", "outer", "k", "loop"), "louvain-level")
    if isinstance(both, blocks.Blocks):
        near = blocks.contracted(both, level)
    else:
        side = lambda c, to: level.select(F.col("node").alias(c), F.col("name").alias(to))
        near = both.join(side("peer", "b").hint("shuffle_hash"), "peer").groupBy("node", "b").agg(F.sum("weight").alias("weight"))
        near = near.join(side("node", "a").hint("shuffle_hash"), "node").groupBy(F.col("a").alias("node"), F.col("b").alias("peer")).agg(F.sum("weight").alias("weight"))
    edges = cut(near, "louvain-edges")
    inner = edges.filter("node = peer").select(F.col("node").alias("name"), F.col("weight").alias("inner"))
    outer = level.groupBy("outer").agg(F.min("name").alias("comm"))
    nodes = level.groupBy("name", "outer").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(outer, "outer").join(inner, "name", "left")
    state = cut(nodes.select(F.col("name").alias("node"), "comm", "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")), "louvain-state")
    return level, edges.filter("node <> peer"), state


def detect(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42, rounds: int = 30, least: float = 1e-5, levels: int = 12) -> DataFrame:
    """account_id, community_id of a partition with high modularity; nodes (account_id) without edges are alone.

    Each level moves nodes between communities in rounds, two jobs each, then
    splits communities into connected parts (refinement), which are the nodes of
    the next level. It ends with a level that improves nothing. The result doesn't
    depend on partitions."""
    # nodes are numbers in the order of their accounts, with room for the communities that a node can found
    number = numbered(nodes.select("account_id").distinct(), ["account_id"])
    of = cut(number.select("account_id", (F.col("number") * (rounds + 2)).alias("node")), "louvain-nodes")
    end = lambda c: of.select(F.col("account_id").alias(c), F.col("node").alias(f"{c}_node")).hint("merge")
    ends = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    weighed = cut(ends.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "weight"), "louvain-edges")
    each = mirrored(weighed.filter("NOT src <=> dst")).select(F.col("account_id").alias("node"), "peer", "weight").filter("node IS NOT NULL")
    both = blocks.near(each.filter("peer IS NOT NULL"), of.select("node"), "louvain-both")
    loops = weighed.filter("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum(2 * F.col("weight")).alias("loop"))
    degree = each.groupBy("node").agg(F.sum("weight").alias("d"))
    zero = F.lit(0.0)
    every = of.select("node").join(degree.hint("merge"), "node", "left").join(loops.hint("merge"), "node", "left")
    state = cut(every.select("node", F.col("node").alias("comm"), (F.coalesce("d", zero) + F.coalesce("loop", zero)).alias("k"), F.coalesce("loop", zero).alias("loop")), "louvain-state")
    m2 = state.agg(F.sum("k")).first()[0] or 0.0
    for level in range(levels if m2 > 0 else 0):
        state, before, after = _moved(state, both, m2, resolution, f"{seed}-{level}", rounds, least)
        if after <= before + 1e-12:
            break
        names, edges, state = _contracted(_refined(state, both, m2, resolution, f"{seed}-{level}"), both)
        both = blocks.near(edges, state.select("node"), "louvain-both")
        of = cut(of.join(names.select("node", "name"), "node").select("account_id", F.col("name").alias("node")), "louvain-nodes")
    return canonical(of.join(state.select("node", "comm"), "node").select("account_id", F.col("comm").alias("community_id")))
