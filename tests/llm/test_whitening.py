"""Embedding whitening: the solver against numpy's, the query against the contract's formulas."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ringweave.llm import whitening

TOP = 4


def some(rng, kind, n, d):
    x = rng.normal(size=(n, d))
    return {
        "graded": lambda: x * 10.0 ** -np.arange(d).clip(0, 12), "rank one": lambda: np.repeat(x[:, :1], d, axis=1), "ties": lambda: np.eye(d)[rng.integers(0, d, n)],
        "equal values": lambda: np.concatenate([np.eye(d)] * 3), "whole": lambda: np.round(x), "plain": lambda: x,
    }[kind]()


@pytest.mark.parametrize("kind", ["plain", "graded", "rank one", "ties", "equal values", "whole"])
def test_solver(kind):
    rng = np.random.default_rng(3)
    for _ in range(40):
        c = some(rng, kind, rng.integers(1, 150), rng.integers(1, 70))
        c = c - c.mean(axis=0)
        values, vectors = whitening.components(whitening._triangle([c]), TOP)
        square = c.T @ c
        want = np.linalg.eigvalsh(square)[::-1][: len(values)]
        most = max(want[0], 1e-300)
        assert len(values) == min(TOP, c.shape[1])
        assert np.abs(values - want).max() <= 1e-12 * most
        assert np.abs(square @ vectors.T - vectors.T * values).max() <= 1e-12 * most
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-12


def test_values_are_relatively_accurate():
    """dqds finds small singular values of a bidiagonal to their own last digits."""
    a, b = 10.0 ** -np.arange(0, 30, 2.0), 10.0 ** -np.arange(1, 29, 2.0)
    got = whitening.dqds(a, b)
    x = [[Fraction(0)] * len(a) for _ in a]
    for k in range(len(a)):
        x[k][k] = Fraction(a[k])
        if k + 1 < len(a):
            x[k][k + 1] = Fraction(b[k])
    product = math.prod(Fraction(v) for v in a) ** 2  # determinant of the square
    assert abs(float(math.prod(Fraction(v) for v in got) / product) - 1) < 1e-12


ROWS = [
    (900, None), (901, []), (902, [float("nan")] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("inf")] + [0.0] * 5), (905, [1e300] + [0.0] * 5), (906, [0.5, -0.5]), (907, [0.25, 1.0]),
    (908, [2.0, -0.1]), (909, [7.0]), (None, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), (910, [0.0] * 6),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, id string, x double, size int").repartition(5)


def expected(rows):
    by: dict = {}
    for i, v in rows:
        if v and all(c is not None and abs(c * 256) < 2**63 for c in v):
            by.setdefault(len(v), []).append((i, tuple(math.floor(256 * c) for c in v)))
    out = []
    for d, own in by.items():
        fit = sorted({x for _, x in own})
        n, s = len(fit), [sum(x[k] for x in fit) for k in range(d)]
        c = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s)] for x in fit])
        cov = c.T @ c / n
        e, v = np.linalg.eigh(cov)
        e, v = e[::-1][:TOP], v[:, ::-1][:, :TOP]
        for i, x in own:
            row = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
            for k in range(min(TOP, d)):
                alive = e[k] > 1e-9 * max(np.trace(cov), 1e-300)
                out.append((i, d, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(x, s)), abs(row @ v[:, k]) / np.sqrt(e[k]) if alive else None, e[k] / np.trace(cov) if np.trace(cov) else None))
    return out


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = ROWS + [(k, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.3, 0.2]).round(2).tolist()) for k in range(120)]
    rows += [(200 + k, rows[20][1]) for k in range(60)] + [(20, rows[30][1])]  # a group of copies, a repeated id
    table(spark, rows).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, f"file://{tmp_path}").collect()
    want = expected(rows)
    key = lambda i, k, n, dev: (str(i), k, n, dev)
    found = sorted(got, key=lambda r: key(r.vec_id, r.component, r.n, r.deviation))
    assert len(found) == len(want)
    for r, w in zip(found, sorted(want, key=lambda w: key(w[0], w[2], w[3], w[4]))):
        assert (r.vec_id, r.component, r.n, r.deviation) == (w[0], *w[2:5])
        assert (r.whitened is None) == (w[5] is None) and (r.explained is None) == (w[6] is None)
        assert w[5] is None or abs(abs(r.whitened) - w[5]) < 1e-9 * max(1, w[5])
        assert w[6] is None or abs(r.explained - w[6]) <= 1e-9 + 1e-4 * w[6] * (w[6] > 1e-9)
        assert r.identity_error is None or r.identity_error < 1e-9
    one = [r for r in found if r.n == 1]
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in one} == {(None, None, None, 0)}
    signs = {}
    for r in found:  # one sign of a component for all rows
        if r.n > 50 and r.vec_id is not None and r.vec_id != 20:
            x = np.array([math.floor(256 * c) for c in next(v for i, v in rows if i == r.vec_id)], float)
            signs.setdefault(r.component, []).append((r.whitened, x))
    for own in signs.values():
        y, x = np.array([w for w, _ in own]), np.array([v for _, v in own])
        line, left, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
        assert np.abs(np.c_[x, np.ones(len(x))] @ line - y).max() < 1e-8


def test_trees_and_chunks(spark):
    """Triangles merged two at a time, and lengths a few at a time, give the same."""
    rng = np.random.default_rng(6)
    rows = table(spark, ROWS + [(k, rng.normal(size=rng.integers(1, 7)).tolist()) for k in range(200)])
    order = lambda r: (str(r.id), r.component, r.n, r.deviation)
    a, b = (sorted(whitening.whiten(rows, **k).collect(), key=order) for k in ({}, {"fan": 2, "model": 1}))
    assert [order(r) for r in a] == [order(r) for r in b]
    for x, y in zip(a, b):
        assert x.whitened is None and y.whitened is None or abs(abs(x.whitened) - abs(y.whitened)) < 1e-9


def test_large_entries_and_empty_tables(spark, tmp_path):
    rows = [(k, [float(2**50 + (k << 20)), float(-k)]) for k in range(9)]
    got = whitening.whiten(table(spark, rows)).collect()
    exact = {(i, k): d for i, _, k, _, d, _, _ in expected(rows)}
    for r in got:
        assert r.deviation == (exact[r.id, r.component] if exact[r.id, r.component] < 1 << 63 else None)
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, ROWS[:6])).count() == 0
    texts = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), (None, [3.0])], "name string, v array<float>")
    assert {(r.id, round(abs(r.whitened), 6)) for r in whitening.whiten(texts, id_col="name", vec_col="v").collect()} == {("a", 1.224745), ("b", 0.0), (None, 1.224745)}
