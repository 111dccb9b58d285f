"""Operator 11 against numpy's eigenvectors, and on odd tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from netvigil.llm import whitening
from netvigil.llm.common import table
from tests.llm.test_operators import SF

ROWS = "vec_id long, embedding array<double>, label int, x long, whitened double, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1.0, 1) for i, v in rows], ROWS)


def brute(rows):
    """All rows of the contract by plain numpy: ids, deviations, variances, components, whitened."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}))
    n, s = len(fit), fit.sum(0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)) for _, x in whole]
    centred = fit - s / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    z = (np.array([x for _, x in whole]) - s / n) @ w
    return n, whole, dev, e, w, z


def check(rows, out, model, components=4):
    n, whole, dev, e, w, z = brute(rows)
    assert model.n == n and len(out) == len(whole)
    got = {}
    for r in out:
        got.setdefault(r.id, []).append((int(r.deviation), r.whitened))
    sign = None
    for (i, _), d, y in zip(whole, dev, z):
        deviation, values = next(g for g in got[i] if g[0] == d)
        assert deviation == d
        want = y[:components] / np.sqrt(e[:components])
        if sign is None and (np.abs(want) > 0.05).all():
            sign = np.sign(want * np.array(values))
        if sign is not None:
            assert np.array(values) * sign == pytest.approx(want, rel=1e-7, abs=1e-7)
    assert model.explained == pytest.approx((e[:components] / e.sum()).tolist(), rel=1e-8)
    assert model.identity_error < 1e-9


def test_query_matches_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    n, whole, dev, e, w, z = brute(rows)
    out = whitening.op11_embedding_whitening(spark, SF).collect()
    assert len(out) == 4 * len(whole) and {r.component for r in out} == {1, 2, 3, 4}
    at = {i: k for k, (i, _) in enumerate(whole)}
    for c in range(4):
        own = [r for r in out if r.component == c + 1]
        want = np.array([z[at[r.vec_id], c] for r in own]) / math.sqrt(e[c])
        got = np.array([r.whitened for r in own])
        assert got * np.sign(got @ want) == pytest.approx(want, abs=1e-9)
        assert {r.explained for r in own} == {own[0].explained}
        assert own[0].explained == pytest.approx(e[c] / e.sum(), rel=1e-10)
    assert all(r.n == n and r.deviation == dev[at[r.vec_id]] for r in out)
    assert max(r.identity_error for r in out) < 1e-10


def test_bad_conditioning_and_rounds(spark):
    """Columns of very different sizes and a nearly dependent one; partial matrices added in rounds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6)) * [1e6, 1e3, 1, 0.5, 0.1, 0]
    x[:, 5] = x[:, 0] + 1e-2 * rng.normal(size=700)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-i, x[3].tolist()) for i in range(1, 350)]
    df = frame(spark, rows).repartition(7)
    for bound in (whitening.DRIVER_BYTES, 6 * 6 * 8):
        out, model = whitening.whiten(df, driver_bytes=bound)
        check(rows, out.collect(), model)
        assert 2 <= model.passes <= 5


def test_dependent_columns(spark):
    """Fewer directions than asked for: the others have no value and explain nothing."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 2))
    rows = [(i, [v, v, v, 7.0]) for i, v in enumerate(a[:, 0].tolist())]
    out, model = whitening.whiten(frame(spark, rows))
    assert (model.variance > 0).tolist() == [True, False, False, False]
    assert model.explained == [pytest.approx(1), 0, 0, 0] and model.identity_error < 1e-8
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None] * 3 for r in out.collect())


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, -0.3]), (1, [0.1, 0.2, -0.3]), (2, None), (3, [0.1, None, 0.3]), (4, [nan, 0.0, 0.0]),
            (5, [inf, 0.0, 0.0]), (6, [-0.001, 0.5, 0.25]), (None, [0.4, 0.0, -0.0]), (7, [0.5]), (8, []),
            (9, [nan] * 9), (10, [1.0, 2.0, 5.0]), (11, [0.0, -3.0, 4.0])]
    out, model = whitening.whiten(frame(spark, rows))
    padded = [(i, v + [0.0] * (3 - len(v)) if v is not None and len(v) < 3 else v) for i, v in rows if i != 9]
    check(padded, out.collect(), model, components=3)
    assert out.where("id is null").count() == 1
    one, model = whitening.whiten(frame(spark, [(1, [0.1, 0.2])] * 5))
    assert model.explained == [None, None] and [r.whitened for r in one.collect()] == [[None, None]] * 5
    for rows in ([], [(1, None), (2, [nan])], [(1, []), (2, [])]):
        none, model = whitening.whiten(frame(spark, rows))
        assert model is None and none.count() == 0
    big, model = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-3e8, 1.0]), (3, [3e8, 2.0])]))
    assert big.count() == 3 and model.n == 3
    far = (1 << 63) - 1024
    sums, want = [far, 768], {1: (far, 0), 2: (-256 * 3 * 10 ** 8, 256), 3: (256 * 3 * 10 ** 8, 512)}
    for r in big.collect():
        exact = sum((3 * v - s) ** 2 for v, s in zip(want[r.id], sums))
        assert r.deviation == (exact if exact < 10 ** 38 else None)


def test_triangular_solve():
    rng = np.random.default_rng(6)
    r = np.triu(rng.normal(size=(5, 5))) + 5 * np.eye(5)
    x = rng.normal(size=(5, 40))
    assert r.T @ whitening.solved(x, r) == pytest.approx(x)
