"""Approximate nearest neighbours with balanced posting lists.

Centroids are learned by k-means on a bounded sample; overfull clusters of the
sample are split until all are of about equal size. Each distinct vector goes to
the posting list of its nearest centroid and, if it lies near a boundary, to
those of further centroids that are at most (1 + replicate) times as far.
Centroids are searched through an in-memory neighbour graph: a best-first walk
from a few entry points. A query first reads the lists whose centroids are at
most (1 + probe) times as far as its nearest one, `probes` of them at most. Lists
are dealt out by number; a list that outgrows PART vectors is dealt in several
parts, all of which its queries visit.

A second pass covers the rest, so results are exact: members of a list are at
least as far from a query as its centroid is, less the list's radius. Each list
not read yet for which this is at most the query's k-th distance so far is read
too. A query that has found fewer than k takes as its distance the farthest that
the members of enough lists can be. For it, lists lie end to end in blocks of PART vectors, and a query goes to
a block once, with the numbers of the lists it has to read there. Where distances
hardly differ, as between random vectors of many dimensions, that is every list.

Equal vectors are one entry with their smallest ids: as ties go to smaller ids,
k + 1 of them always suffice.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, as query or candidate;
repeated rows (same id and vector) count once; fewer than k candidates are
all returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

#: Vectors that centroids are learned from, at most; vectors per list aimed at; lists, at most; entries per part.
SAMPLE, LIST, LISTS, PART = 50_000, 200, 16_384, 20_000
REPLICATE, REPLICAS, PROBE, PROBES = 0.15, 6, 0.45, 48
BEAM, DEGREE = 64, 24
#: Distances that the driver holds at once.
BLOCK = 1 << 21
#: Queries that a task of the second pass holds, at most.
QUERIES = 50_000


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long float lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, measured from the middle of `b`: a common offset would cancel all digits."""
    middle = b.mean(0) if len(b) else 0.0
    a, b = a - middle, b - middle
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))


def centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """About k centroids of clusters of about equal size."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    at = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    limit = 2 * max(1, len(sample) // k)
    for r in range(rounds):
        step = max(1, BLOCK // len(at))
        own = np.concatenate([squared(sample[i : i + step], at).argmin(1) for i in range(0, len(sample), step)])
        size = np.bincount(own, minlength=len(at))
        order, past = np.argsort(own, kind="stable"), np.cumsum(size)
        at = np.stack([sample[order[b - n : b]].mean(0) if n else at[c] for c, (n, b) in enumerate(zip(size.tolist(), past.tolist()))])
        if r % 3 == 2:  # the least used centroids move into the largest clusters
            full, few = np.argsort(-size, kind="stable"), np.argsort(size, kind="stable")
            for big, small in zip(full[: len(at) // 4], few):
                if size[big] <= limit or size[small] * 4 > size[big]:
                    break
                members = sample[own == big]
                at[small] = members[rng.integers(len(members))]
    return at


class Graph:
    """Centroids, each with its nearest neighbours, and entry points spread over them."""

    def __init__(self, at: np.ndarray):
        self.at = at
        step = max(1, BLOCK // len(at))
        near = [np.argsort(squared(at[i : i + step], at), axis=1, kind="stable")[:, 1 : DEGREE + 1] for i in range(0, len(at), step)]
        near = np.concatenate(near).tolist()
        links = [set(x) for x in near]
        for a, b in enumerate(near):
            for c in b[: DEGREE // 2]:
                links[c].add(a)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.unique(np.linspace(0, len(at) - 1, min(len(at), 24)).astype(np.int64))

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of about the `most` nearest, nearest first."""
        import heapq

        dist = lambda ids: np.sqrt(((self.at[ids] - x) ** 2).sum(1))
        beam = max(BEAM, most)
        seen = np.zeros(len(self.at), bool)
        seen[self.entries] = True
        open_ = list(zip(dist(self.entries).tolist(), self.entries.tolist()))
        heapq.heapify(open_)
        best = sorted((-d, c) for d, c in open_)[-beam:]
        heapq.heapify(best)
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = self.links[c]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for e, n in zip(dist(new).tolist(), new.tolist()):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(open_, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted((-d, c) for d, c in best)[:most]
        return np.array([c for _, c in found], np.int64), np.array([d for d, _ in found])


def _lists(graph, most: int, ratio: float):
    """Rows (..., vector last) with the lists whose centroids are near enough."""

    def run(batches):
        g = graph.value
        for batch in batches:
            v = matrix(batch.column(batch.num_columns - 1))
            lists = []
            for x in v:
                c, d = g.nearest(x, most)
                lists.append(c[d <= d[0] * (1 + ratio) + 1e-12].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "lists"])

    return run


def usable(rows: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """id, vec: distinct rows whose vector can take part."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    out = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & good)
    width = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.filter(F.size("vec") == (width[0]["n"] if width else 0))


def _search(k: int):
    def run(key, left, right):
        q, c = matrix(left.column("vec")), matrix(right.column("vec"))
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id")} | {"score": pa.array([], pa.float64())})
        qid, ids = left.column("id").to_pylist(), right.column("ids").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 256):
            d2 = squared(q[a : a + 256], c)
            take = min(len(c), k + 1)
            near = np.argpartition(d2, take - 1, axis=1)[:, :take] if take < len(c) else np.tile(np.arange(len(c)), (len(d2), 1))
            for j, cols in enumerate(near):
                # all that rounding or a tie could move across the edge stay in
                cols = np.flatnonzero(d2[j] <= d2[j][cols].max() * (1 + 1e-9) + 1e-12)
                d = np.sqrt(((c[cols] - q[a + j]) ** 2).sum(1))
                own = sorted((x, i) for x, col in zip(d.tolist(), cols.tolist()) for i in ids[col] if i != qid[a + j])[:k]
                out[0].extend([qid[a + j]] * len(own))
                out[1].extend(i for _, i in own)
                out[2].extend(x for x, _ in own)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _unread(plan, k: int):
    """Rows (block, id, limit, lists, vec) from (id, limit, lists read, vec): what each block holds of lists that may have a member within the limit."""

    def run(batches):
        lists, at, count, radius, begin, end = plan.value
        for batch in batches:
            limits, read = batch.column("limit").to_numpy().copy(), batch.column("lists").to_pylist()
            v = matrix(batch.column("vec"))
            out: tuple[list, list, list] = ([], [], [])
            for j, d in enumerate(np.sqrt(squared(v, at)) if len(lists) else []):
                if np.isinf(limits[j]):  # k + 1 distinct vectors, the query among them at most, lie within this
                    order = np.argsort(d + radius)
                    enough = np.searchsorted(np.cumsum(count[order]), k + 1)
                    if enough < len(order):
                        limits[j] = (d + radius)[order[enough]] * (1 + 1e-6) + 1e-6
                may = d - radius <= limits[j] * (1 + 1e-6) + 1e-6
                may &= ~np.isin(lists, read[j])
                may = np.flatnonzero(may)
                for block in np.unique(np.concatenate([begin[may], end[may]] + [np.arange(begin[m], end[m] + 1) for m in may[end[may] > begin[may] + 1]])).tolist():
                    out[0].append(block)
                    out[1].append(j)
                    out[2].append(lists[may[(begin[may] <= block) & (end[may] >= block)]].tolist())
            rows = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column("id").take(rows), pa.array(limits).take(rows), pa.array(out[2], pa.list_(pa.int64())), batch.column("vec").take(rows)], ["block", "id", "limit", "lists", "vec"])

    return run


def _within(k: int):
    """The k nearest of each query among a block's members of the lists it has to read, within its limit."""

    def run(key, left, right):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        q, limit, qid = matrix(left.column("vec")), left.column("limit").to_numpy(), left.column("id").to_pylist()
        right = right.sort_by("list")
        c, ids, of = matrix(right.column("vec")), right.column("ids").to_pylist(), right.column("list").to_numpy()
        numbers, begin = np.unique(of, return_index=True)
        past = np.append(begin[1:], len(of))
        wanted = left.column("lists").combine_chunks()
        asks, listed = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 64):
            near = (asks >= a) & (asks < a + 64)
            order = np.argsort(listed[near], kind="stable")
            who, what = asks[near][order], listed[near][order]
            hits = []
            for m, x, y in zip(numbers, begin, past):
                rows = who[np.searchsorted(what, m) : np.searchsorted(what, m, "right")]
                if not len(rows):
                    continue
                # all that rounding could move across the limit stay in
                d2 = squared(q[rows], c[x:y])
                i, j = np.nonzero(d2 <= (limit[rows] ** 2 * (1 + 1e-9) + 1e-9)[:, None])
                hits.append((rows[i], j + x, d2[i, j]))
            if not hits:
                continue
            i, j, d2 = (np.concatenate([h[n] for h in hits]) for n in range(3))
            order = np.lexsort((d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            begins = np.searchsorted(i, i)
            last = d2[np.minimum(begins + k, np.searchsorted(i, i, "right") - 1)]
            keep = d2 <= last * (1 + 1e-9) + 1e-12
            i, j = i[keep], j[keep]
            d = np.sqrt(((c[j] - q[i]) ** 2).sum(1))
            order = np.lexsort((d, i))
            i, j, d = i[order], j[order], d[order]
            edges = np.flatnonzero(np.diff(i, prepend=-1))
            for x, y in zip(edges, np.append(edges[1:], len(i))):
                own = sorted((e, z) for e, col in zip(d[x:y].tolist(), j[x:y].tolist()) for z in ids[col] if z != qid[i[x]])[:k]
                out[0].extend([qid[i[x]]] * len(own))
                out[1].extend(z for _, z in own)
                out[2].extend(e for e, _ in own)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(rows: DataFrame, is_query, *, k=10, id_col="vec_id", vec_col="embedding", probe=PROBE, probes=PROBES, per_list=LIST, part=PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows with is_query (a condition on `id`)."""
    spark = rows.sparkSession
    vectors = stored(usable(rows, id_col, vec_col), "ann-vectors")
    first = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    entries = vectors.distinct().withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stored(entries.select("ids", "vec"), "ann-entries")
    n = entries.count()
    cut = F.xxhash64(F.element_at("ids", 1))
    sample = entries.select(cut.alias("place"), "vec").orderBy("place").limit(SAMPLE).toArrow() if n else None
    at = centroids(matrix(sample.column("vec")), min(LISTS, -(-n // per_list))) if n else np.zeros((1, 1))
    graph = spark.sparkContext.broadcast(Graph(at))  # LISTS centroids at most
    posted = entries.mapInArrow(_lists(graph, REPLICAS, REPLICATE), "ids array<long>, vec array<double>, lists array<long>").select("ids", "vec", F.posexplode("lists").alias("copy", "list"))
    posted = stored(posted, "ann-lists")
    parts = posted.groupBy("list").count().select("list", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # LISTS rows at most
    dealt = posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts")).cast("int")).select("list", "part", "ids", "vec")
    queries = stored(vectors.filter(is_query).distinct().mapInArrow(_lists(graph, probes, probe), "id long, vec array<double>, lists array<long>"), "ann-queries")
    asked = queries.select("id", "vec", F.explode("lists").alias("list"))
    asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "vec")
    found = asked.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    near = stored(_best(found, k), "ann-near")
    return _best(near.select("query_id", "vec_id", "score").unionByName(_rest(queries, near, posted.filter("copy = 0"), at, k, part)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rest(queries: DataFrame, near: DataFrame, entries: DataFrame, at: np.ndarray, k: int, part: int) -> DataFrame:
    """query_id, vec_id, score: what lists not read yet hold within the k-th distance of `near`."""
    spark = queries.sparkSession
    centers = spark.createDataFrame(pa.table({"list": pa.array(range(len(at)), pa.int64()), "center": pa.array(at.tolist(), pa.list_(pa.float64()))}))
    away = F.sqrt(F.aggregate(F.zip_with("vec", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    sizes = entries.join(F.broadcast(centers), "list").groupBy("list").agg(F.count("*").alias("n"), F.max(away).alias("radius")).orderBy("list").toArrow()  # LISTS rows at most
    lists, count = sizes.column("list").to_numpy(), sizes.column("n").to_numpy()
    start = np.cumsum(count) - count
    plan = spark.sparkContext.broadcast((lists, at[lists] if len(lists) else at[:0], count, sizes.column("radius").to_numpy(), start // part, (start + count - 1) // part))
    starts = F.broadcast(spark.createDataFrame(pa.table({"list": pa.array(lists, pa.int64()), "start": pa.array(start, pa.int64()), "n": pa.array(count, pa.int64())})))
    limits = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    open_ = queries.join(limits.hint("merge"), "id", "left").select("id", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), "lists", "vec")
    slices = max(1, -(-queries.count() // QUERIES))
    open_ = open_.mapInArrow(_unread(plan, k), "block long, id long, limit double, lists array<long>, vec array<double>").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    place = F.col("start") + F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("n"))
    blocks = entries.join(starts, "list").select(F.floor(place / part).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "list", "ids", "vec")
    return open_.groupBy("block", "slice").cogroup(blocks.groupBy("block", "slice")).applyInArrow(_within(k), "query_id long, vec_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


#: Exact; lists that hold everything near make the operator agree with it on small tables.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
      FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
