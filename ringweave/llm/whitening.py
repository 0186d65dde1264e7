"""Whitening of embeddings through a bidiagonal singular value decomposition.

1. Entries become whole numbers, and equal vectors one row of the fit list;
   sums over it are exact.
2. Blocks of centred rows are reduced to a triangle R by QR, the triangles of
   tasks to one in a tree (`reduced`): rows meet nowhere.
3. R, whose size depends on the vectors' length only, becomes bidiagonal by
   Householder reflections; the dqds algorithm finds its singular values, and
   twisted factorisations of the shifted tridiagonal its right vectors, which the
   reflections take back (`components`). This runs in one task for each length.
4. All rows are projected on the components, with the small model in the task.

Vectors of different lengths can't share components: each length is fitted and
whitened on its own, a range of lengths at a time (MODEL bounds what tasks get).

Defined results: rows whose vector is null, empty, or holds null, NaN, infinite
entries or some beyond a long take no part; repeated rows are fitted once and
all returned; a component without variance has a null `whitened`, and
`explained` 0 (null where nothing varies at all); `identity_error` covers the
components that vary; a deviation beyond a long is null; ids may be of any type;
other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, stored, table

TOP, SCALE = 4, 256
ROWS, FAN = 4096, 32
MODEL = 1 << 20  # entries of all vectors of a model that tasks get at once
EPS = np.finfo(float).eps


# The solver: a triangle in, components out ------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): diagonal, superdiagonal and right vectors of the bidiagonal form u'rw of a square matrix."""
    r, n = r.copy(), len(r)
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        v[0] += size if v[0] >= 0 else -size
        length = np.linalg.norm(v)
        return v / length if length else v

    for k in range(n):
        v = reflector(r[k:, k])
        r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        if k < n - 2:
            v = reflector(r[k, k + 1 :])
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), w


def _transformed(q: list, e: list, shift: float):
    """One differential qd step with a shift; None if it loses positivity."""
    out, off, d = [], [], q[0] - shift
    for k, x in enumerate(e):
        if d < 0:
            return None
        top = d + x
        ratio = q[k + 1] / top if top else 0.0
        out.append(top)
        off.append(x * ratio)
        d = d * ratio - shift if top else q[k + 1] - shift
    return (out + [d], off) if d >= 0 else None


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an unreduced bidiagonal matrix, largest first."""
    q, e, done, moved = [x * x for x in a.tolist()], [x * x for x in b.tolist()], [], 0.0
    guess = 0.0
    while q:
        if len(q) == 1:
            done.append(moved + q[0])
            break
        small = EPS * EPS
        if e[-1] <= small * (moved + q[-1]) or e[-1] <= small * small * max(q):
            done.append(moved + q.pop())
            e.pop()
            guess = 0.0
            continue
        if q[0] < q[-1] / 2:  # the small end goes last
            q, e = q[::-1], e[::-1]
        # the smaller root of the last two rows is near the smallest value; a shift beyond it is taken back
        x, y, z = q[-2], q[-1], e[-1]
        mean, gap = (x + y + z) / 2, np.sqrt(max(0.0, ((x - y + z) / 2) ** 2 + y * z))
        shift = min(guess or np.inf, x * y / (mean + gap) if mean + gap else 0.0) * (1 - 4 * EPS)
        found = _transformed(q, e, shift)
        tries = 0
        while found is None:
            tries += 1
            shift = shift / 4 if tries < 6 else 0.0
            found = _transformed(q, e, shift)
        q, e = found
        moved += shift
        guess = 0.0
    return np.sort(np.maximum(done, 0.0))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector z of b'b z = value z, for the unreduced bidiagonal b: stationary and progressive factors of the shifted tridiagonal, joined where they fit worst."""
    n, d = len(a), a * a
    low = b / a[:-1]
    floor = EPS * EPS * max(d.max(), value)
    s, p, plus, minus = np.zeros(n), np.zeros(n), np.zeros(n - 1), np.zeros(n - 1)
    s[0] = -value
    for i in range(n - 1):
        top = s[i] + d[i]
        top = top if abs(top) > floor else floor
        plus[i] = d[i] * low[i] / top
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        bottom = d[i] * low[i] ** 2 + p[i + 1]
        bottom = bottom if abs(bottom) > floor else floor
        minus[i] = low[i] * d[i] / bottom
        p[i] = p[i + 1] * d[i] / bottom - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list) -> np.ndarray:
    for _ in range(2):
        for x in others:
            z = z - x * (x @ z)
    return z


def components(r: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the largest `top` squared singular values of a square matrix, and its right vectors as rows."""
    n, size = len(r), np.abs(r).max(initial=0)
    if not size:
        return np.zeros(min(top, n)), np.eye(n)[: min(top, n)]
    a, b, w = bidiagonal(r / size)
    most = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a[np.abs(a) <= EPS * EPS * most] = EPS * EPS * most
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS * most) + 1), n]
    found = []
    for first, past in zip(cuts, cuts[1:]):
        for value in dqds(a[first:past], b[first : past - 1])[:top]:
            found.append((value, first, past))
    found.sort(key=lambda x: -x[0])
    kept: list = []
    tri = lambda f, t: np.diag(a[f:t] ** 2 + np.concatenate([[0], b[f : t - 1] ** 2])) + np.diag(a[f : t - 1] * b[f : t - 1], 1) + np.diag(a[f : t - 1] * b[f : t - 1], -1)
    for value, first, past in found[:top]:
        near = [z[first:past] for v, z, at in kept if at == first and v - value <= 1e-3 * found[0][0]]
        z = twisted(a[first:past], b[first : past - 1], value) if past - first > 1 else np.ones(1)
        apart = _apart(z, near)
        if np.linalg.norm(apart) < 0.5 and past - first > 1:  # values closer than their precision: the rest of their space, by inverse iteration
            t, apart = tri(first, past), _apart(np.cos(np.arange(past - first) * (1 + len(near))), near)
            for _ in range(4):
                apart = np.linalg.solve(t - (value + 8 * EPS * found[0][0]) * np.eye(past - first), apart)
                apart = _apart(apart / np.linalg.norm(apart), near)
        whole = np.zeros(n)
        whole[first:past] = apart / np.linalg.norm(apart)
        kept.append((value, whole, first))
    vectors = np.array([w @ z for _, z, _ in kept])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return np.array([v for v, _, _ in kept]) * size * size, vectors


# The rows ---------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x (vectors of whole numbers) and size: rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c * SCALE) < float(1 << 63), F.lit(False)))
    return vectors.filter((F.size(v) > 0) & fits).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x"), F.size(v).alias("size"))


def _matrices(batches, most: int = ROWS):
    """(batch, rows of the batch, their vectors as a matrix): for each length, up to `most` rows."""
    for batch in batches:
        lists = batch.column("x")
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            for k in range(0, len(own), most):
                part = own[k : k + most]
                yield batch, part, values[offsets[part][:, None] + np.arange(size)]


def _added(batches):
    total: dict = {}
    for _, _, x in _matrices(batches):
        safe = np.abs(x.astype(float)).max() * len(x) < 2.0**62
        sums = (x if safe else x.astype(object)).sum(axis=0)
        n, old = total.get(x.shape[1], (0, 0))
        total[x.shape[1]] = n + len(x), old + sums.astype(object)
    for size, (n, sums) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(np.arange(size, dtype=np.int32)), pa.array([n] * size, pa.int64()), pa.array([str(s) for s in sums])], ["size", "at", "n", "s"])


def sums_of(fit: DataFrame, low: int, high: int) -> dict:
    """length: (n, exact sums of its dimensions), from one row for each task and dimension."""
    parts = fit.filter(F.col("size").between(low, high)).mapInArrow(_added, "size int, at int, n long, s string")
    out: dict = {}
    for r in parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("size", "at").toLocalIterator():
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def centred(x: np.ndarray, n: int, s: list) -> tuple[np.ndarray, np.ndarray | None]:
    """n x - S exactly (None where 64 bits don't hold it), and x - S / n."""
    if max(n * np.abs(x.astype(float)).max(initial=0), max(map(abs, s), default=0)) < 2.0**61:
        exact = x * n - np.array(s, np.int64)
        return exact / n, exact
    exact = x.astype(object) * n - np.array(s, object)
    return np.array(exact / n, float), None


def _triangle(blocks: list) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _triangles(model: dict):
    def run(batches):
        found: dict = {}
        for _, _, x in _matrices(batches):
            rows, _ = centred(x, *model[x.shape[1]])
            found[x.shape[1]] = _triangle([*([found[x.shape[1]]] if x.shape[1] in found else []), rows])
        for size, r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([r.ravel().tolist()])], ["size", "r"])

    return run


def _merged(group):
    size = group.column("size")[0].as_py()
    return _triangle([np.asarray(x.values).reshape(size, size) for chunk in group.column("r").chunks for x in chunk])


def _combined(group: pa.Table) -> pa.Table:
    r = _merged(group)
    return pa.table({"size": pa.array([len(r)], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})


def _solved(top: int):
    def run(group: pa.Table) -> pa.Table:
        r = _merged(group)
        values, vectors = components(r, top)
        return pa.table({"size": pa.array([len(r)], pa.int32()), "values": pa.array([values.tolist()], pa.list_(pa.float64())), "vectors": pa.array([vectors.ravel().tolist()], pa.list_(pa.float64())), "trace": pa.array([float((r * r).sum())])})

    return run


def reduced(fit: DataFrame, model: dict, low: int, high: int, fan: int = FAN) -> DataFrame:
    """size, r: triangles of the centred rows of each length, `fan` for a length at most: tasks' triangles, merged in a tree."""
    parts = stored(fit.filter(F.col("size").between(low, high)).mapInArrow(_triangles(model), "size int, r array<double>"), "whitening-r")
    fan = max(2, min(fan, (1 << 24) // (high * high)))
    while (most := parts.groupBy("size").count().agg(F.max("count")).first()[0] or 0) > fan:
        groups = -(-most // fan)
        dealt = parts.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(groups)))
        merged = stored(dealt.groupBy("size", "part").applyInArrow(_combined, "size int, r array<double>"), "whitening-r")
        forget(parts)
        if merged.groupBy("size").count().agg(F.max("count")).first()[0] >= most:  # each on its own: next to none are left
            return merged
        parts = merged
    return parts


def fitted(fit: DataFrame, low: int, high: int, top: int = TOP, fan: int = FAN) -> dict:
    """length: n, sums, values (of the covariance), vectors, trace, error of the whitened covariance."""
    sums = sums_of(fit, low, high)
    triangles = reduced(fit, sums, low, high, fan)
    rows = triangles.groupBy("size").applyInArrow(_solved(top), "size int, values array<double>, vectors array<double>, trace double").collect()
    forget(triangles)
    out = {}
    for r in rows:
        n, s = sums[r["size"]]
        values = np.array(r["values"])
        values[values <= values.max(initial=0) * EPS * EPS * 64 * r["size"] ** 2] = 0  # rounding of what has no variance
        out[r["size"]] = {"n": n, "s": s, "values": values / n, "vectors": np.array(r["vectors"]).reshape(-1, r["size"]), "trace": r["trace"] / n}
    names = [f"w{k}" for k in range(top)]
    flat = fit.filter(F.col("size").between(low, high)).select("size", "x").mapInArrow(_flat(out, top), "size int, " + ", ".join(f"{c} double" for c in names))
    pairs = [*combinations_with_replacement(names, 2)]
    for r in flat.groupBy("size").agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).collect():
        off = [abs(r[f"{a}_{b}"] - (a == b)) for a, b in pairs if r[f"{a}_{b}"] is not None]
        out[r["size"]]["error"] = max(off, default=None)
    return out


def _whitened(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray | None]:
    """Projections over the components' deviations (NaN without variance), and n x - S."""
    rows, exact = centred(x, m["n"], m["s"])
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows @ m["vectors"].T / np.where(m["values"] > 0, np.sqrt(m["values"]), np.nan), exact


def _flat(model: dict, top: int):
    def run(batches):
        for _, _, x in _matrices(batches):
            w, _ = _whitened(x, model[x.shape[1]])
            columns = [pa.array(w[:, k], from_pandas=True) if k < w.shape[1] else pa.nulls(len(x), pa.float64()) for k in range(top)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), *columns], ["size", *(f"w{k}" for k in range(top))])

    return run


def _deviations(exact, x: np.ndarray, m: dict) -> pa.Array:
    if exact is not None and (exact.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return pa.array((exact * exact).sum(axis=1))
    whole = x.astype(object) * m["n"] - np.array(m["s"], object)
    return pa.array([d if d < 1 << 63 else None for d in (whole * whole).sum(axis=1)], pa.int64())


def _returned(model: dict):
    def run(batches):
        for batch, rows, x in _matrices(batches):
            m = model[x.shape[1]]
            w, exact = _whitened(x, m)
            deviation = _deviations(exact, x, m)
            n, k = w.shape
            each, whole = pa.array(np.repeat(np.arange(n), k)), np.full(n * k, m["n"])
            explained = np.tile(m["values"] / m["trace"] if m["trace"] else np.full(k, np.nan), n)
            error = np.full(n * k, np.nan if m.get("error") is None else m["error"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(whole), deviation.take(each), *(pa.array(c, from_pandas=True) for c in (w.ravel(), explained, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, *, id_col="vec_id", vec_col="embedding", top: int = TOP, fan: int = FAN, model: int = MODEL) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each of its first components."""
    rows = whole_numbers(vectors, id_col, vec_col)
    fit = stored(rows.select("size", "x").distinct(), "whitening-fit")
    sizes = [r["size"] for r in fit.select("size").distinct().orderBy("size").collect()]
    kind = vectors.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out, k = None, 0
    while k < len(sizes) or out is None:
        past = k + 1
        while past < len(sizes) and sum(sizes[k : past + 1]) * (top + 1) <= model:
            past += 1
        low, high = (sizes[k], sizes[past - 1]) if sizes else (1, 1)
        own = rows.filter(F.col("size").between(low, high)).mapInArrow(_returned(fitted(fit, low, high, top, fan) if sizes else {}), columns)
        out, k = own if out is None else out.unionByName(own), past
    forget(fit)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
