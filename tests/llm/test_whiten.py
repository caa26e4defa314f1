"""Whitening against a direct eigendecomposition, and its updates one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import whiten


def grid_rows(rng, n, d):
    return np.floor(64 * rng.standard_normal((n, d)) * np.geomspace(1, 0.02, d)).astype(np.int64)


def scatter(s):
    return (s.vectors * s.values) @ s.vectors.T


@pytest.mark.parametrize(("n", "d"), [(1, 3), (5, 1), (4, 2), (50, 5), (30, 64), (900, 64)])
def test_updates_and_combined_spectra(n, d):
    x = grid_rows(np.random.default_rng(n + d), n, d)
    x[n // 2 :] = x[0] + np.random.default_rng(1).integers(0, 2, (n - n // 2, d))
    want = np.cov(x.T, bias=True).reshape(d, d) * n
    whole, a, b = (whiten.Spectrum.empty(d) for _ in range(3))
    whole.add(x)
    a.add(x[: n // 3])
    b.add(x[n // 3 :])
    if n > 2:
        a.join(b)
        assert np.allclose(scatter(a), want, rtol=0, atol=1e-11 * max(np.abs(want).max(), 1))
        assert a.n == n and (a.sums == x.sum(axis=0)).all()
    assert np.allclose(scatter(whole), want, rtol=0, atol=1e-11 * max(np.abs(want).max(), 1))
    assert np.allclose(whole.vectors.T @ whole.vectors, np.eye(d), atol=1e-11)
    assert np.allclose(whole.mean, x.mean(axis=0)) and (np.diff(whole.values) >= 0).all()


def test_secular_roots_solve_the_equation():
    rng = np.random.default_rng(8)
    for size in (1, 2, 7, 40):
        poles = np.sort(rng.standard_normal(size)) * 10.0
        weights = rng.random(size) ** 8 + 1e-14
        weights /= weights.sum()
        for rho in (1e-3, 1.0, 1e4):
            origin, at = whiten.secular_roots(poles, weights, rho)
            got = poles[origin] + at
            want = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(np.sqrt(weights), np.sqrt(weights)))
            assert np.allclose(got, want, atol=1e-9 * max(rho, 10))
            assert (got >= poles).all() and (got[:-1] <= poles[1:]).all()


def expect(pairs, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows of one length."""
    x = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(object) for i, v in pairs}
    x = {i: np.array([int(c) + 1_000_000 for c in v], dtype=object) for i, v in x.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in fit])
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        d = [n * c - s for c, s in zip(v, sums, strict=True)]
        p = (np.array(d, dtype=np.float64) / n) @ vectors
        for k in range(min(components, len(values))):
            out[i, k + 1] = (n, sum(c * c for c in d), p[k] / np.sqrt(values[k]), values[k] / values.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        if abs(white) > 1e-3:
            sign.setdefault(r.component, np.sign(white * r.whitened))
        assert r.whitened * sign.get(r.component, 1) == pytest.approx(white, rel=1e-7, abs=1e-9)


def test_given_vectors(spark, tables, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in tables["embeddings"].collect()]
    want = expect(rows)
    got = whiten.whitened(tables["embeddings"]).collect()
    check(got, want)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    monkeypatch.setattr(whiten, "TASK_ROWS", 40)
    monkeypatch.setattr(whiten, "FAN", 3)
    check(whiten.whitened(tables["embeddings"].repartition(7)).collect(), want)


def test_defined_cases(spark):
    rng = np.random.default_rng(4)
    plain = [(i, [float(v) for v in rng.standard_normal(5)]) for i in range(60)]
    pairs = [(100 + i, [float(i), float(i * i)]) for i in range(6)]
    repeated = [(7, plain[7][1]), (200, plain[3][1])]
    dropped = [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (304, [])]
    lone = [(400, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(plain + pairs + repeated + dropped + lone, "vec_id int, embedding array<double>")
    df = df.withColumns({c: F.lit("mine") for c in ("x", "dim", "n", "component", "part", "label")})
    got = whiten.whitened(df).collect()
    fives = [r for r in got if r.vec_id < 100 or r.vec_id == 200]
    assert sum(r.vec_id == 7 for r in fives) == 10
    once = {(r.vec_id, r.component): r for r in fives}
    check(list(once.values()), expect(plain + repeated[1:]))
    check([r for r in got if 100 <= r.vec_id < 200], expect(pairs))
    alone = [r for r in got if r.vec_id == 400]
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 3
    assert not {r.vec_id for r in got} & {300, 301, 302, 303, 304}
    assert whiten.whitened(df.filter("false")).count() == 0


def test_flat_directions_and_long_sums(spark):
    flat = spark.createDataFrame([(i, [float(i), 0.0, float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whiten.whitened(flat).collect()
    assert {r.component for r in got if r.whitened is None} == {2, 3}
    assert next(r for r in got if r.component == 1).explained == pytest.approx(1)
    sums, x = np.array([5, 7]), np.array([[1 << 40, 3], [4, 5]])
    value, known = whiten.deviations(x, 1 << 10, sums)
    assert known.tolist() == [False, True]
    assert value[1] == (4 * 1024 - 5) ** 2 + (5 * 1024 - 7) ** 2
