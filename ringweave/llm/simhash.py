"""SimHash near-dedup with BK-trees.

Fingerprints are 64 bits: each shingle's XXH64 votes on each bit. To find all
pairs within a radius of r bits, the 64 bits are cut into r + 1 blocks; two
fingerprints within r bits agree in one block at least, so a shard is the set of
distinct fingerprints that share a block's value. In each shard a BK-tree
(children keyed by their Hamming distance to the parent) finds the neighbours of
every member: only edges within r of the distance are followed. A shard that
outgrows SHARD is cut again by the remaining bits in the same way, which loses
no pair either. Trees travel with their shard, not to every task, because the
number of fingerprints grows with the corpus.

Equal fingerprints are one node, so a group of copies costs one row. Links make
components by repeatedly hanging every node below the smallest one near it.

Defined results: a text without words, null or empty, has fingerprint 0, linked
like any other; rows with the same id keep a row each; a null id never names a
component unless no member has an id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, utf8

RADIUS = 3
SHARD = 2048


def _fingerprints(width: int):
    def run(batches):
        import xxhash

        digest, bits = xxhash.xxh64_intdigest, np.array([1 << k for k in range(64)], np.uint64)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            data, offsets = utf8(batch.column("text"))
            for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                words = data[a:b].tobytes().lower().split()
                if not words:
                    continue
                if len(words) < width:
                    shingles = [b" ".join(words)]
                else:
                    shingles = map(b" ".join, zip(*(words[j:] for j in range(width))))
                h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
                ones = np.zeros(64, np.int64)
                for a in range(0, len(h), 1 << 16):
                    ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[k] = bits[2 * ones > len(h)].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(out.view(np.int64))], ["id", "key", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", width=3) -> DataFrame:
    """id, key (xxhash64 of the text), fp: a signed 64-bit fingerprint for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(width), f"id {docs.schema[id_col].dataType.simpleString()}, key long, fp long")


class BKTree:
    """A node is [fingerprint, {distance: node}]."""

    def __init__(self):
        self.root = None

    def near(self, fp: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            value, children = open_.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            open_ += [child for k, child in children.items() if d - radius <= k <= d + radius]
        return found

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = [fp, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            if d not in node[1]:
                node[1][d] = [fp, {}]
                return
            node = node[1][d]


def _links(radius: int):
    """Rows (shard, fp), all of a shard in a row. Gives links (a, b) that connect every two members within the radius, through other members at most."""

    def of(members: list[int], out: list[tuple[int, int]]) -> None:
        tree, above = BKTree(), {}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for fp in members:
            above[fp] = fp
            for other in tree.near(fp, radius):
                a, b = top(fp), top(other)
                if a != b:  # a link between members that are connected already adds nothing
                    above[max(a, b)] = min(a, b)
                    out.append((fp, other))
            tree.add(fp)

    def run(batches):
        shard, members = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys, fps = batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1 if len(keys) else 0)).tolist() + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != shard:
                    if len(members) > 1:
                        of(members, out)
                    shard, members = keys[a], []
                members += fps[a:b].tolist()
            if out:
                yield _pairs(out)
        out = []
        if len(members) > 1:
            of(members, out)
        yield _pairs(out)

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: links between the distinct fingerprints of `nodes` (column fp) that connect all pairs within the radius."""
    blocks = radius + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]

    def block(low: int, high: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND((1 << (high - low)) - 1)

    parts = F.array(*(F.xxhash64(F.lit(k), block(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    sharded = nodes.select("fp", F.posexplode(parts).alias("k", "shard"))
    sizes = sharded.groupBy("shard").count()
    large = stored(sizes.filter(F.col("count") > shard).select("shard"), "simhash-large")
    small = sharded.join(large.hint("shuffle_hash"), "shard", "left_anti").select("shard", "fp")
    # a large shard's members agree in one block; in a (radius + 1)-th of the other bits they agree again
    others = []
    for k in range(blocks):
        rest = [i for i in range(64) if not cuts[k] <= i < cuts[k + 1]]
        step = [len(rest) * j // blocks for j in range(blocks + 1)]
        masks = [sum(1 << i for i in rest[x:y]) for x, y in zip(step, step[1:])]
        others.append(F.array(*(F.xxhash64("shard", F.lit(j), F.col("fp").bitwiseAND(m - (1 << 64) if m >> 63 else m)) for j, m in enumerate(masks))))
    finer = sharded.join(large.hint("shuffle_hash"), "shard", "left_semi").select("fp", F.explode(F.element_at(F.array(*others), F.col("k") + 1)).alias("shard")).select("shard", "fp")
    together = small.unionByName(finer).repartition("shard").sortWithinPartitions("shard", "fp")
    return together.mapInArrow(_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each linked node with the smallest node it can reach. Rounds end when no node moves."""
    edges = stored(edges.filter("a <> b"), "components-links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "components-0")
    k = 0
    while True:
        k += 1
        # links between the present roots; each root hangs below the smallest root it is linked to, then paths are halved
        up = state.select(F.col("node").alias("x"), F.col("root").alias("r"))
        pairs = edges.join(up.hint("merge"), edges.a == F.col("x")).select("b", F.col("r").alias("ra")).join(up.hint("merge"), F.col("b") == F.col("x")).select("ra", F.col("r").alias("rb")).filter("ra <> rb")
        hang = pairs.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hang = hang.unionByName(state.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("to"))).groupBy("root").agg(F.min("to").alias("to"))
        moved = state.join(hang.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        state = stored(moved, f"components-{k}")
        if not state.filter("moved").limit(1).count():
            return state.select("node", "root")
        state = state.select("node", "root")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", width=3, radius=RADIUS, shard=SHARD) -> DataFrame:
    """id, key (xxhash64 of the text), fp, root (one per component), component_id (the smallest id reachable over links) for each row."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    reach = components(links(nodes.select("fp"), radius, shard))
    rooted = nodes.join(reach.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return prints.join(named.hint("merge"), "fp").select("id", "key", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, near: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` with one row of each component of near_duplicates(): the one with the smallest id, a row without an id only where none has one."""
    stays = near.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("s")).select(F.col("s.id").alias("stays"), F.col("s.key").alias("stays_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    kept = rows.join(stays.hint("merge"), (F.col("key") == F.col("stays_key")) & F.col("id").eqNullSafe(F.col("stays")))
    return kept.dropDuplicates(["id", "key"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
