"""The account graph in incidence form: classes of accounts that share something, and pairs only where they are asked for.

A class is the accounts that share an entity, or a merchant on one day; all its
members are neighbours. An entity of n accounts has n rows here and n (n - 1) / 2
pairs. Degrees and numbers of edges, of the whole graph or inside communities,
come from class sizes (`degrees`, `edge_counts`); the strongest edges come from
bounds on what an account's classes can add up to, which leave few pairs to be
made (`strongest`); `weighed` makes the edges of given pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import WEIGHTS, evidence_weight, temporal_multiplier
from .contracts import require
from .graph import KINDS, active_days, parties
from .stored import cut

#: Classes of more accounts than this count as wholes in `degrees`; pairs of smaller ones are made, HOT / 2 for a row at the most.
HOT = 128
#: Accounts of a class that stand for it when the first weights are looked for, and pairs that are weighed then, for each edge that is asked for.
SEEDS, FIRST = 4, 40
#: Classes of one account that are combined in twos, LONG * LONG / 2 keys at the most.
LONG = 48
#: Room for the rounding of weights to six digits.
SLACK = 1e-5


def memberships(accounts: DataFrame, links: DataFrame, transactions: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """class_id, kind, entity_id, day, account_id: one row for each account of a class. With `membership` classes end at communities, and their community_id is returned."""
    require(transactions, ["transaction_id", "timestamp", "src_account_id", "dst_account_id", "merchant_id"])
    known = accounts.select("account_id")
    mine = links.select("kind", "entity_id", F.lit(None).cast("date").alias("day"), "account_id")
    daily = parties(transactions).filter("merchant_id IS NOT NULL").select(F.lit("merchants").alias("kind"), F.col("merchant_id").alias("entity_id"), F.to_date("timestamp").alias("day"), "account_id")
    rows, own = mine.unionByName(daily).distinct().join(known.hint("merge"), "account_id", "left_semi"), []
    if membership is not None:
        rows, own = rows.join(membership.select("account_id", "community_id").hint("merge"), "account_id"), ["community_id"]
    # neither kinds nor days have a bar in them, so no two classes have one name
    name = F.concat_ws("|", "kind", F.coalesce(F.col("day").cast("string"), F.lit("")), *own, "entity_id")
    return rows.select(name.alias("class_id"), "kind", "entity_id", "day", "account_id", *own)


def classes(rows: DataFrame) -> DataFrame:
    """class_id, kind, entity_id, day, members, pairs: classes of two accounts or more."""
    own = [c for c in rows.columns if c not in ("class_id", "account_id")]
    n = F.col("members")
    return rows.groupBy("class_id", *own).agg(F.count("*").alias("members")).filter("members > 1").withColumn("pairs", F.expr("members * (members - 1) div 2"))


def shared(rows: DataFrame) -> DataFrame:
    """Rows of classes that have members, with their number."""
    return rows.join(classes(rows).select("class_id", "members").hint("merge"), "class_id")


def blocks(rows: DataFrame, size: int = HOT) -> DataFrame:
    """class_id, block, accounts: the members of each class, sorted, `size` to a block at the most on average; blocks are dealt by hash, so no task sees a class whole."""
    dealt = shared(rows).withColumn("block", F.pmod(F.xxhash64("account_id"), F.ceil(F.col("members") / size)).cast("int"))
    return dealt.groupBy("class_id", "block").agg(F.array_sort(F.collect_list("account_id")).alias("accounts"))


def _pairs(left: DataFrame, by: str = "class_id", also: Column | None = None) -> DataFrame:
    """src < dst of one class each; `also` may speak of l.* and r.*."""
    on = (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col("l.account_id") < F.col("r.account_id"))
    return left.alias("l").join(left.alias("r").hint("merge"), on if also is None else on & also)


def degrees(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """account_id, [community_id,] degree: neighbours of each account that has any, each counted once, whatever they share.

    Small classes make their pairs. Accounts in the same set of large classes are
    one block; two blocks with a large class in common are neighbours throughout,
    so sizes of blocks give those neighbours, and pairs of small classes that lie
    in such blocks are left out.
    """
    own = [c for c in rows.columns if c == "community_id"]
    sized = cut(shared(rows).select("class_id", "account_id", "members", *own), "classes")
    cold = _pairs(sized.filter(F.col("members") <= hot)).select(F.col("l.account_id").alias("src"), F.col("r.account_id").alias("dst"), *(F.col(f"l.{c}") for c in own)).distinct()
    large = sized.filter(F.col("members") > hot)
    ends = F.explode(F.array("src", "dst")).alias("account_id")
    if large.isEmpty():
        return cold.select(ends, *own).groupBy("account_id", *own).agg(F.count("*").alias("degree"))
    of = large.groupBy("account_id", *own).agg(F.array_sort(F.collect_list("class_id")).alias("large"))
    of = cut(of.withColumn("block", F.sha2(F.array_join("large", "\n"), 256)), "large-classes")
    sizes = of.groupBy("block").agg(F.first("large").alias("large"), F.count("*").alias("n"))
    places = cut(sizes.select("block", "n", F.explode("large").alias("class_id")), "block-classes")
    near = places.alias("a").join(places.alias("b").hint("merge"), F.col("a.class_id") == F.col("b.class_id")).select(F.col("a.block").alias("block"), F.col("b.block").alias("other"), F.col("b.n").alias("n")).distinct()
    reach = near.groupBy("block").agg((F.sum("n") - 1).alias("reach"))
    whole = of.join(reach.hint("merge"), "block").select("account_id", *own, F.col("reach").alias("degree"))
    side = lambda c: of.select(F.col("account_id").alias(c), F.col("large").alias(f"{c}_large"))
    apart = cold.join(side("src").hint("merge"), "src", "left").join(side("dst").hint("merge"), "dst", "left").filter(~F.coalesce(F.arrays_overlap("src_large", "dst_large"), F.lit(False)))
    rest = apart.select(ends, *own).groupBy("account_id", *own).agg(F.count("*").alias("degree"))
    return whole.unionByName(rest).groupBy("account_id", *own).agg(F.sum("degree").alias("degree"))


def edge_counts(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """edges: how many account edges there are; with communities in `rows`, community_id and edges inside each that has some."""
    own = [c for c in rows.columns if c == "community_id"]
    return degrees(rows, hot).groupBy(*own).agg(F.expr("coalesce(sum(degree), 0) div 2").alias("edges"))


def profiles(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """account_id; an array of entities for each kind (merchants: day|merchant) that others share, and the account's days. rows: what `shared` gives."""
    name = F.when(F.col("kind") == "merchants", F.concat_ws("|", "day", "entity_id")).otherwise(F.col("entity_id"))
    sets = rows.groupBy("account_id").agg(*(F.collect_set(F.when(F.col("kind") == k, name)).alias(k) for k in KINDS))
    return sets.join(active_days(transactions).hint("merge"), "account_id", "left")


def _merchants(c: Column) -> Column:
    """Merchants of an array of day|merchant, each once."""
    return F.array_distinct(F.transform(c, lambda x: F.substring(x, 12, 1 << 30)))


def weighed(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """The edges of given pairs (src, dst), from the profiles of both ends: arrays of shared entities, temporal_overlap, weight."""
    side = lambda c: accounts.select(F.col("account_id").alias(c), F.struct(*KINDS, "days").alias(f"of_{c}"))
    both = pairs.join(side("src").hint("merge"), "src").join(side("dst").hint("merge"), "dst")
    common = {k: F.array_intersect(f"of_src.{k}", f"of_dst.{k}") for k in KINDS}
    common["merchants"] = _merchants(common["merchants"])
    overlap = F.coalesce(F.size(F.array_intersect("of_src.days", "of_dst.days")), F.lit(0))
    overlap = F.when(F.col("of_src.days").isNull() | F.col("of_dst.days").isNull(), 0).otherwise(overlap)
    edges = both.select("src", "dst", *(F.array_sort(common[k]).alias(k) for k in KINDS), overlap.alias("temporal_overlap"))
    return edges.withColumn("weight", evidence_weight({k: F.size(k) for k in KINDS}, F.col("temporal_overlap")))


def of_pairs(pairs: DataFrame, accounts: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """The edges between given pairs of accounts, whichever comes first; pairs that share nothing have none. Rows (a, b)."""
    wanted = pairs.dropna(subset=["a", "b"]).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).filter("src <> dst").distinct()
    rows = cut(shared(memberships(accounts, links, transactions)), "memberships")
    return weighed(wanted, cut(profiles(rows, transactions), "profiles")).filter("weight > 0")


def _bound(counts: dict[str, Column], days: Column, heaviest: str) -> Column:
    """What an edge can weigh whose heaviest kind is `heaviest`, from how many entities of each kind and days its ends may share."""
    total = sum((F.lit(w) * F.sqrt(counts[k].cast("double")) for k, w in WEIGHTS.items() if w <= WEIGHTS[heaviest]), F.lit(0.0))
    return total * temporal_multiplier(days)


def _by_kind(make) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, make(k)) for k in KINDS))


def candidates(bounded: DataFrame, least: float, long: int = LONG) -> DataFrame:
    """src, dst of all pairs that may weigh `least` or more; bounded: class_id, members, kind, account_id, n (a struct of counts by kind, and days), bound.

    With its own lighter kinds and days an account needs so many common entities
    of a kind, `need`, to reach `least`. Of its classes in one order, small ones
    first, an edge's ends then share one of all but the last need - 1, and two of
    all but the last need - 2; pairs of classes as keys leave few accounts
    together. Accounts that need one entity only, or have more than `long` classes
    to combine, meet the others class by class.
    """
    kept = bounded.filter(F.col("bound") >= least - SLACK).groupBy("account_id", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("members", "class_id"))).alias("own"))
    days = temporal_multiplier(F.col("n.days"))
    lighter = {k: sum((F.lit(w) * F.sqrt(F.col(f"n.{x}").cast("double")) for x, w in WEIGHTS.items() if w < WEIGHTS[k]), F.lit(0.0)) for k in KINDS}
    root = F.coalesce(*(F.when(F.col("kind") == k, (F.lit(least - SLACK) / days - lighter[k]) / WEIGHTS[k]) for k in KINDS))
    need = F.when(root <= 1, 1).otherwise(F.ceil(root * root - 1e-9)).cast("int")
    kept = kept.withColumn("need", need).withColumn("size", F.size("own")).filter("need <= size")
    kept = cut(kept.withColumn("alone", (F.col("need") == 1) | (F.col("size") - F.col("need") + 2 > long)), "candidate-classes")
    single = kept.select("account_id", "kind", "n", "alone", F.explode(F.expr("slice(own, 1, size - need + 1)")).alias("c")).select("account_id", "kind", "n", "alone", "c.class_id")
    several = F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, greatest(0, size - need + 1 - i)), y -> xxhash64(x.class_id, y.class_id))))")
    double = kept.filter("NOT alone").select("account_id", "kind", "n", F.explode(several).alias("class_id"))
    fewer = lambda k: F.least(F.col(f"l.n.{k}"), F.col(f"r.n.{k}"))
    hope = F.coalesce(*(F.when(F.col("l.kind") == k, _bound({x: fewer(x) for x in KINDS}, fewer("days"), k)) for k in KINDS)) >= least - SLACK
    met = single.filter("alone").alias("l").join(single.alias("r").hint("merge"), (F.col("l.class_id") == F.col("r.class_id")) & (F.col("l.account_id") != F.col("r.account_id")) & hope)
    ends = lambda df: df.select(F.least("l.account_id", "r.account_id").alias("src"), F.greatest("l.account_id", "r.account_id").alias("dst"))
    return ends(met).unionByName(ends(_pairs(double, also=hope))).distinct()


def strongest(accounts: DataFrame, links: DataFrame, transactions: DataFrame, k: int) -> DataFrame:
    """The k strongest edges, ties by src and dst, without making the others.

    An edge weighs no more than its ends' counts of shared entities and days
    allow, and its heaviest kind is one that both have a class of. A few pairs of
    promising accounts of each class are weighed first; the k-th weight among them
    is one that the k-th edge has at least, so of each class only accounts, and
    then pairs, that may reach it are paired and weighed.
    """
    rows = cut(shared(memberships(accounts, links, transactions)), "memberships")
    profile = cut(profiles(rows, transactions), "profiles")
    counts = F.struct(*(F.size(_merchants(F.col(c)) if c == "merchants" else F.col(c)).alias(c) for c in KINDS), F.greatest(F.lit(0), F.coalesce(F.size("days"), F.lit(0))).alias("days"))
    sized = rows.join(profile.select("account_id", counts.alias("n")).hint("merge"), "account_id")
    own = lambda kind: _bound({x: F.col(f"n.{x}") for x in KINDS}, F.col("n.days"), kind)
    bounded = cut(sized.select("class_id", "members", "kind", "account_id", "n", _by_kind(own).alias("bound")), "bounds")
    # the most promising account of each quarter of a class, in pairs
    part = F.pmod(F.xxhash64("account_id"), F.lit(SEEDS))
    seeds = bounded.groupBy("class_id", "kind", part.alias("part")).agg(F.max(F.struct("bound", "account_id", "n")).alias("x")).select("class_id", "kind", "x.*")
    fewer = lambda c: F.least(F.col(f"l.n.{c}"), F.col(f"r.n.{c}"))
    hope = F.coalesce(*(F.when(F.col("l.kind") == c, _bound({x: fewer(x) for x in KINDS}, fewer("days"), c)) for c in KINDS))
    first = _pairs(seeds).select(F.col("l.account_id").alias("src"), F.col("r.account_id").alias("dst"), hope.alias("hope")).groupBy("src", "dst").agg(F.max("hope").alias("hope"))
    first = first.orderBy(F.desc("hope"), "src", "dst").limit(FIRST * k).select("src", "dst")
    found = weighed(first, profile).orderBy(F.desc("weight")).limit(k).agg(F.count("*").alias("n"), F.min("weight").alias("least")).first()
    least = found["least"] if found["n"] == k else 0.0
    return weighed(candidates(bounded, least), profile).orderBy(F.desc("weight"), "src", "dst").limit(k)
