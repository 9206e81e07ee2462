"""Whitening against NumPy over the whole table."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import SF, clashing, empty

from tapeworks.llm import registry, whitening

ROWS = "vec_id long, embedding array<float>, label int"


def check(rows, vectors, components=32):
    """Rows of the operator against the definition. vectors: (id, list) of those that remain."""
    x = np.array([[int(np.floor(64.0 * np.float64(c))) + 1_000_000 for c in v] for _, v in vectors], np.int64)
    n, d = x.shape
    s = x.sum(axis=0)
    z = x - s / n
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    assert len(rows) == n * k
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    for c in range(1, k + 1):
        own = np.array([got[i][c].whitened for i, _ in vectors], float)
        want = z @ u[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
        assert abs(own.var() - 1) < 1e-6
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert [got[i][1].deviation for i, _ in vectors] == exact
    assert {r.n for r in rows} == {n}
    assert all(r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-6) for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(registry.QUERIES["op13_embedding_whitening"](spark, SF).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_edges(spark):
    pick = np.random.default_rng(5)
    good = [(i, pick.normal(0, 3, 5).astype(np.float32).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e38, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in good + bad], ROWS)
    check(whitening.whiten(clashing(table)).collect(), good)
    check(whitening.whiten(table, 3).collect(), good, 3)
    assert whitening.whiten(empty(spark, ROWS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in bad[:4]], ROWS)).count() == 0


def test_flat_axes_and_repeats(spark):
    """Vectors that are all equal have no scale; repeated and null ids keep a row each."""
    flat = spark.createDataFrame([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [0.5, 0.25], 0)], ROWS)
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 6 and {r.whitened for r in rows} == {None} and {r.deviation for r in rows} == {0} and {r.identity_error for r in rows} == {None}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(4)], ROWS)
    rows = whitening.whiten(line).collect()
    assert {r.whitened is None for r in rows if r.component == 2} == {True}
    assert np.var([r.whitened for r in rows if r.component == 1]) == pytest.approx(1) and rows[0].identity_error < 1e-9


def test_large_entries_are_exact(spark):
    rows = [(i, [1e6 + i, -3e6 - 7 * i]) for i in range(50)]
    table = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    check(whitening.whiten(table.repartition(7), 1).collect(), rows, 1)
    far = spark.createDataFrame([(1, [2.0**54]), (2, [-(2.0**54)]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whiten(far).collect()} == {1: None, 2: None, 3: 0}
