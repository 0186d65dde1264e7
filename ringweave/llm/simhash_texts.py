"""SimHash near-dedup by the similarity of texts: the same operator for callers that name a similarity rather than a number of bits.

Two texts are linked if the sets of their shingles of WIDTH words (A-Z in lower
case) have a Jaccard similarity of LEAST or more. At that similarity SimHashes
of 64 bits differ in about ten bits, too many to shard by blocks of equal bits;
so a shard is the set of distinct texts that share one of BANDS keys, each made
of ROWS minima of hashed shingles. Two texts at the threshold share none with a
probability of 5e-6, and differ in more than RADIUS bits with one of about 1e-6.
Whatever the shards propose is verified on whole texts.

1. Texts that can have no link leave: LEAST of a text's shingles occur in the
   other text too, so one with more shingles of its own, among all that share a
   shard, is done.
2. STARS rounds join groups: every text is compared with one leader, the text of
   its shards that shares most shards with others. A group of near copies takes
   a pair for each text, not for each two. Later rounds take leaders outside
   the largest component of a shard.
3. What is left are shards of several components: often one large group and texts
   just too far from it, which are too many to compare in pairs. Every member is
   compared with one centre of the shard again, which gives the shingles in which
   it differs from the centre. If neither of two texts or only one is similar to the
   centre, they can be similar only if they have a certain number of these
   differences in common, so (as in prefix filtering) one of the first few of
   each. Texts with a centre and a difference in common, and of several
   components, are searched with BK-trees of fingerprints within RADIUS. Trees
   hold the members outside the largest component; those of more than SHARD
   members are dealt in parts, all of which are asked.

Texts with the same set of shingles are one node, so copies cost one row. Sets
are named by 64 bits.

Defined results: a text with fewer words than WIDTH is one shingle; texts without
words, null or empty, are copies of each other; rows with the same id keep a row
each; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, stored, utf8
from .simhash import BKTree, components
from .words import U, Words, mix

WIDTH, LEAST, RADIUS = 5, 0.8, 24
BANDS, ROWS, STARS, SHARD = 40, 6, 2, 2048
#: Members that are verified against one copy of their centre's text, about.
SPREAD = 256
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(3)
_FLIP = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_TIMES = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Each text's distinct shingles as sorted hashes."""
    words = Words(_LOWER[data], offsets)
    windows, whole, n = words.windows(width), words.texts(), np.diff(words.of)
    for k, first in enumerate(words.of[:-1]):
        if n[k] >= width:
            yield np.unique(windows[first : first + n[k] - width + 1])
        else:
            yield whole[k : k + min(1, n[k])]


def fingerprint(shingles: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 1 << 14):
        ones += np.unpackbits(shingles[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> list[int]:
    """BANDS keys of a set that isn't empty."""
    short = (shingles >> U(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(short), 4096):
        np.minimum(low, ((short[a : a + 4096] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=U)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key * U(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64).tolist()


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole, size, fp, bands = [], [], [], []
            for a, b in pieces(offsets, PIECE):
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width):
                    name = mix(np.array([mix(s ^ U(0xA24BAED4963EE407)).sum(dtype=U) + U(len(s))], U))
                    whole.append(int(name.view(np.int64)[0]))
                    size.append(len(s))
                    fp.append(fingerprint(s))
                    bands.append(band_keys(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(whole, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "key", "whole", "size", "fp", "bands"])

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def prefixes(d: int, n: int, centre: int, near: bool, least: float) -> tuple[int, int]:
    """How many of a text's d differences from its centre have to be looked at: (where the other text has at least as many differences, where it has at most as many).

    n, centre: shingles of the text and of the centre. Similar texts differ in `part` of their shingles together at most, so in n * reach.
    """
    part = (1 - least) / (1 + least)
    reach = part * (1 + 1 / least)
    small, large = ceil(d - n * reach / 2 - 1e-9), ceil(d - n * reach - 1e-9)
    if near:  # the other one is not, so it has many differences
        common = floor((d + part * (centre - n)) / 2 - 1e-9) + 1
        small, large = max(small, common), max(large, common)
    return tuple(min(d, max(0, d - max(1, x) + 1)) for x in (small, large))


def _compare(width: int, least: float):
    """Rows (a, b, text) sorted so that a centre (b null) comes before its members: each member's likeness to it and first differences from it."""
    limit = round(least * 1000)
    names = ["a", "b", "near", "d", "n", "head", "differences"]

    def run(batches):
        centre = np.zeros(0, U)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out: list[tuple] = []
            for x, y in pieces(offsets, PIECE):
                for k, s in enumerate(shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], width), x):
                    if b[k] is None:
                        centre = s
                        continue
                    gained, lost = np.setdiff1d(s, centre, True), np.setdiff1d(centre, s, True)
                    same, d = len(s) - len(gained), len(gained) + len(lost)
                    near = 1000 * same >= limit * (len(centre) + len(s) - same)
                    head, most = prefixes(d, len(s), len(centre), near, least)
                    out.append((a[k], b[k], near, d, len(s), head, np.concatenate([gained, lost])[:most].view(np.int64)))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def compared(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """a, b, near (whether the texts are similar), d, n, head, differences of the pairs (a, b). A centre `a` with many members goes to several tasks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    members = pairs.join(sizes.hint("shuffle_hash"), "a").select("a", salt, "b")
    heads = heads.join(texts.hint("merge"), F.col("a") == F.col("whole")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    members = members.join(texts.hint("merge"), F.col("b") == F.col("whole")).select("a", "salt", "b", "text")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_compare(width, least), "a long, b long, near boolean, d long, n long, head int, differences array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    return compared(pairs, texts, width, least).filter("near").select("a", "b")


def _ask(radius: int, least: float):
    """Rows (cell, tree, whole, fp, root, near, d, n, first) sorted by cell, a cell's tree first: pairs (tree member, other) within the radius, of different roots, that their counts allow."""
    part = (1 - least) / (1 + least)

    def may(x, y) -> bool:
        (one, root, near, d, n, first), (two, other, close, e, m, early) = x, y
        if root == other or near and close or least * max(n, m) > min(n, m) + 1e-9:
            return False
        return (first if (d, one) < (e, two) else early) and d + e - part * (n + m) <= 2 * min(d, e) + 1e-9

    def run(batches):
        cell, tree, named = None, BKTree(), {}
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("cell", "tree", "fp", "whole", "root", "near", "d", "n", "first"))
            for at, grows, fp, *row in zip(*columns):
                fp &= (1 << 64) - 1
                if at != cell:
                    cell, tree, named = at, BKTree(), {}
                if grows:
                    if fp not in named:
                        tree.add(fp)
                    named.setdefault(fp, []).append(row)
                else:
                    out += [(x[0], row[0]) for near in tree.near(fp, radius) for x in named[near] if may(x, row)]
            yield _pairs(out)

    return run


def _exploded(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole = batch.column("whole").to_numpy()
            for a, b in pieces(offsets, PIECE):
                sets = list(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(whole[a:b], [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["whole", "shingle"])

    return run


def _several(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Members of the shards that hold several components."""
    shards = rows.groupBy(*by).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(*by)
    return stored(rows.join(shards.hint("merge"), by, "left_semi"), name)


def _linkable(members: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Members without those that have too many shingles of their own for any link among `members`."""
    rows = texts.mapInArrow(_exploded(width), "whole long, shingle long")
    own = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("whole").alias("whole")).filter("n = 1").groupBy("whole").agg(F.count("*").alias("own"))
    done = own.join(texts.select("whole", "size").hint("merge"), "whole").filter(1000 * (F.col("size") - F.col("own")) < round(least * 1000) * F.col("size")).select("whole")
    return _several(members.join(done.hint("merge"), "whole", "left_anti"), ["band"], "similar-linkable")


def _rooted(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Members (band, whole, fp, root) of the shards that still hold several components."""
    reach = components(links)
    rows = rows.select("band", "whole", "fp").join(reach.hint("merge"), F.col("whole") == F.col("node"), "left").select("band", "whole", "fp", F.coalesce("root", "whole").alias("root"))
    return _several(rows, ["band"], name)


def _leaders(rows: DataFrame) -> DataFrame:
    """whole, root, best (fame, whole, root): for each text the one of its shards' texts that may lead (column `may`) and shares most shards with others."""
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"))
    able = rows.filter("may")
    fame = able.join(sizes.hint("merge"), "band").groupBy("whole").agg(F.sum("n").alias("fame"))
    best = able.join(fame.hint("merge"), "whole").groupBy("band").agg(F.max(F.struct("fame", "whole", "root")).alias("best"))
    return rows.join(best.hint("merge"), "band").groupBy("whole", "root").agg(F.max("best").alias("best"))


def _outside(rows: DataFrame) -> DataFrame:
    """`rows` with may: whether a member is outside its shard's largest component."""
    counts = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    major = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m")).select("band", F.col("m.root").alias("major"))
    return rows.join(major.hint("merge"), "band").withColumn("may", F.col("root") != F.col("major")).drop("major")


def _centred(rows: DataFrame) -> DataFrame:
    """a, b: every member b with the centre a of each of its shards; shards of one group mostly have the same."""
    best = _leaders(rows.withColumn("may", F.lit(True))).select("whole", "best")
    centres = rows.join(best.hint("merge"), "whole").groupBy("band").agg(F.max("best").alias("best"))
    return rows.join(centres.hint("merge"), "band").select(F.col("best.whole").alias("a"), F.col("whole").alias("b")).filter("a <> b").distinct()


def _remaining(differing: DataFrame, roots: DataFrame, radius: int, shard: int, least: float) -> DataFrame:
    """Candidate pairs of different components among texts that share a centre and a difference from it."""
    rows = differing.join(roots.hint("merge"), F.col("b") == F.col("whole")).select("a", "whole", "fp", "root", "near", "d", "n", "head", F.posexplode("differences").alias("place", "difference"))
    rows = rows.withColumn("first", F.col("place") < F.col("head")).drop("head", "place")
    by = ["a", "difference"]
    rows = _several(rows, by, "similar-differences")
    counts = rows.groupBy(*by, "root").agg(F.count("*").alias("n"))
    cells = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("major"))
    cells = cells.select(*by, F.col("major.root").alias("major"), F.ceil((F.col("all") - F.col("major.n")) / shard).cast("int").alias("parts"), F.ceil(F.col("all") / (4 * shard)).cast("int").alias("salts"))
    rows = rows.join(cells.hint("merge"), by)
    part, salt = F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("whole", F.lit(1)), F.col("salts")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    trees = rows.filter("root <> major").withColumn("part", part).withColumn("salt", F.explode(every("salts"))).withColumn("tree", F.lit(True))
    askers = rows.withColumn("part", F.explode(every("parts"))).withColumn("salt", salt).withColumn("tree", F.lit(False))
    both = trees.unionByName(askers).select(F.xxhash64(*by, "part", "salt").alias("cell"), "tree", "whole", "fp", "root", "near", "d", "n", "first")
    both = both.repartition("cell").sortWithinPartitions("cell", F.desc("tree"), "whole")
    found = both.mapInArrow(_ask(radius, least), "a long, b long").filter("a <> b")
    # a pair that several trees propose is one
    return found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def similar_texts(docs: DataFrame, *, id_col="doc_id", text_col="text", width=WIDTH, least=LEAST, radius=RADIUS, stars=STARS, shard=SHARD) -> DataFrame:
    """id, key (xxhash64 of the text), fp, root (one per component), component_id (the smallest id reachable over links) for each row."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    prints = stored(texts.mapInArrow(_signatures(width), f"id {kind}, key long, whole long, size long, fp long, bands array<long>"), "similar-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("s")
    nodes = stored(prints.groupBy("whole").agg(first, F.min(F.struct("size", "fp", "bands")).alias("t")).select("whole", "s.id", "s.key", "t.size", "t.fp", "t.bands"), "similar-nodes")
    members = nodes.select("whole", "fp", F.explode("bands").alias("band"))
    shards = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    shared = stored(members.join(shards.hint("merge"), "band"), "similar-shards")
    # the text of each node that shares a shard, once
    wanted = nodes.join(shared.select("whole").distinct().hint("merge"), "whole", "left_semi").select("whole", "size", F.col("id").alias("_id"), F.col("key").alias("_key"))
    own = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    named = stored(texts.filter("text IS NOT NULL").join(wanted.hint("shuffle_hash"), own).groupBy("whole", "size").agg(F.first("text").alias("text")), "similar-texts")

    open_ = _linkable(shared.withColumn("root", F.col("whole")), named, width, least)
    links = None
    for k in range(stars):
        led = _leaders(open_.withColumn("may", F.lit(True)) if k == 0 else _outside(open_))
        pairs = stored(led.filter(F.col("root") != F.col("best.root")).select(F.col("best.whole").alias("a"), F.col("whole").alias("b")), f"similar-stars-{k}")
        found = stored(verified(pairs, named, width, least), f"similar-links-{k}")
        links = found if links is None else links.unionByName(found)
        open_ = _rooted(open_, links, f"similar-open-{k}")
    differing = stored(compared(stored(_centred(open_), "similar-centres"), named, width, least), "similar-compared")
    roots = open_.select("whole", "fp", "root").distinct()
    rest = stored(_remaining(differing, roots, radius, shard, least), "similar-rest")
    found = stored(verified(rest, named, width, least).unionByName(differing.filter("near").select("a", "b")), "similar-links")
    links = found if links is None else links.unionByName(found)

    reach = components(links)
    rooted = nodes.select("whole", "id").join(reach.withColumnRenamed("node", "whole").hint("merge"), "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    low = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    places = rooted.select("whole", "root").join(low.hint("merge"), "root")
    return prints.select("id", "key", "whole", "fp").join(places.hint("merge"), "whole").select("id", "key", "fp", "root", "component_id")
