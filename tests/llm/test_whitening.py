"""Whitening against a plain eigendecomposition of the covariance matrix."""
import math

import numpy as np
import pytest

from tracesieve.llm import whitening as w


@pytest.mark.parametrize("seed, d, z2", [(0, [0.0, 1.0, 3.0], [1.0, 1e-12, 5.0]), (1, [1.0], [2.0]), (2, [0.0, 1e-9, 1e9], [1e9, 1e-6, 1.0])])
def test_secular_roots(seed, d, z2):
    d, z2 = np.array(d), np.array(z2)
    origin, offset = w.secular_roots(d, z2)
    assert np.allclose(d[origin] + offset, np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))), rtol=1e-12, atol=1e-13 * d[-1])
    assert ((d[origin] + offset) >= d).all()


def check_spectrum(s, x):
    want = np.cov(x.T, bias=True).reshape(x.shape[1], -1) * len(x)
    size = max(1.0, np.linalg.norm(want))
    assert s.n == len(x) and np.abs(s.q.T @ s.q - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(s.q * s.d @ s.q.T - want).max() < 1e-12 * size and np.abs(s.mean - x.mean(0)).max() < 1e-12 * max(1.0, np.abs(x).max())


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("kind", ["plain", "equal", "constant dimension", "rank one", "two values", "wide range"])
def test_rank_one_updates(kind, block):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(150, 9)) * 40)
    if kind == "equal":
        x[:] = x[0]
    elif kind == "constant dimension":
        x[:, 2] = 5
    elif kind == "rank one":
        x = np.outer(np.arange(150), np.arange(9))
    elif kind == "two values":
        x = np.sign(x)
    elif kind == "wide range":
        x = np.floor(x * 10.0 ** np.arange(9))
    check_spectrum(w.add_rows(w.Spectrum.empty(9), x, block), x)
    parts = [w.add_rows(w.Spectrum.empty(9), p, block) for p in (x[:1], x[1:60], x[:0], x[60:])]
    both = parts[0]
    for p in parts[1:]:
        both = w.merge(both, p)
    check_spectrum(both, x)


def plain(vectors, k=4):
    """{index: deviation}, whitened columns, shares, by numpy over the distinct vectors."""
    x = [tuple(math.floor(float(c) * 256) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    n, sums = len(fit), [sum(int(c) for c in col) for col in fit.T]
    values, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, q = values[::-1], q[:, ::-1]
    y = (np.array(x) - fit.mean(0)) @ q[:, :k] / np.sqrt(values[:k])
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], y, values[:k] / values.sum()


SCHEMA = "vec_id long, embedding array<float>, component int, n string, whitened string"


def test_whiten(shipped):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12)) * 0.4 + rng.normal(size=(400, 12)) * 0.1
    good = [v.astype(np.float32).tolist() for v in base] + [base[0].astype(np.float32).tolist()] * 200
    good[7][3] = -0.0
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [None] * 12, [nan] + good[0][1:], [inf] + good[0][1:], [-inf] + good[0][1:], good[0][:11], [1e30] + good[0][1:]]
    rows = [(i if i != 5 else None, v, 9, "x", "y") for i, v in enumerate(good)] + [(10_000 + i, v, 9, "x", "y") for i, v in enumerate(bad)]
    got = w.whiten(shipped.createDataFrame(rows, SCHEMA).repartition(20)).collect()
    n, deviations, y, shares = plain(good)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        i = 5 if r.vec_id is None else r.vec_id
        k = r.component - 1
        assert r.deviation == deviations[i] and r.explained == pytest.approx(shares[k], rel=1e-9) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(y[i, k]), abs=1e-8)
        if abs(r.whitened) > 1e-3:
            assert sign.setdefault(k, np.sign(r.whitened * y[i, k])) == np.sign(r.whitened * y[i, k])


@pytest.mark.parametrize("vectors, variance", [([[0.5, 0.25]] * 3, 0), ([[0.5, 0.25], [1.0, 0.5]], 1), ([[1.0], [2.0], [4.0]], 1)])
def test_little_variance(shipped, vectors, variance):
    got = w.whiten(shipped.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(vectors) * min(4, len(vectors[0]))
    for r in got:
        assert (r.whitened is None) == (r.component > variance) and (r.explained > 0) == (r.component <= variance)
        assert (r.identity_error is None) == (variance == 0)


def test_huge_sums_stay_exact(shipped):
    rows = [(0, [2.0 ** 31, 1.0]), (1, [-2.0 ** 31, 3.0]), (2, [5.0, 7.0])]
    got = {r.vec_id: r.deviation for r in w.whiten(shipped.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    want = plain([v for _, v in rows], 2)[1]
    assert got == {i: v if v < 1 << 63 else None for i, v in enumerate(want)}


def test_empty_table(shipped):
    assert w.whiten(shipped.createDataFrame([], SCHEMA)).collect() == []
    assert w.whiten(shipped.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
