import math
import random

import numpy as np
import pytest

from crowdtrust.llm import whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, component string")


def symmetric(r, d, values):
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    return (q * values) @ q.T


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64, 150])
def test_eigenpairs_of_random_matrices(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d))
    a = a + a.T
    values, vectors = whitening.leading_eigenpairs(a, 8)
    wanted = np.linalg.eigvalsh(a)[::-1][:8]
    assert np.allclose(values, wanted, rtol=1e-12, atol=1e-12 * np.abs(wanted).max())
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * np.abs(a).max()
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13 * d


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 5, 2, 1, 1, 0, 0, 0], [1e9, 1e-9, 1e-9, 0, 0, 0, 0, 0, 0, 0], [3, 3 + 1e-14, 3 - 1e-13, 2.9999999, 1, 1, 1, 1, 1, 1], [1] * 10, [0] * 10])
def test_equal_and_close_eigenvalues(spectrum):
    a = symmetric(np.random.default_rng(1), 10, np.array(spectrum, dtype=float))
    values, vectors = whitening.leading_eigenpairs(a, 6)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:6], rtol=1e-12, atol=1e-12 * max(max(spectrum), 1e-300))
    assert np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * max(spectrum)


def test_matrices_that_fall_apart():
    """Zeros off the diagonal: blocks, a diagonal, copies of one block."""
    block = np.array([[2.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 2.0]])
    a = np.zeros((12, 12))
    for i in range(4):
        a[3 * i: 3 * i + 3, 3 * i: 3 * i + 3] = block  # each eigenvalue four times
    for m in (a, np.diag(np.arange(12.0)), np.diag([1.0] * 11 + [5.0])):
        values, vectors = whitening.leading_eigenpairs(m, 8)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:8], atol=1e-12)
        assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-12
        assert np.abs(m @ vectors.T - vectors.T * values).max() < 1e-11


def test_sturm_counts():
    diag, off = np.array([2.0, 2.0, 2.0, 2.0]), np.array([1.0, 1.0, 1.0])
    exact = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    for x in (-1, 0.3, 0.4, 1.0, 1.5, 2.5, 3.7, 9):
        assert whitening.sturm_counts(diag, off, np.array([float(x)]))[0] == (exact < x).sum()


def brute(rows):
    """Exact whole numbers, numpy's eigenvectors: (n, deviations, whitened up to sign, explained)."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x]).reshape(n, d)
    v = centred.T @ centred / max(n, 1)
    e, q = np.linalg.eigh(v)
    return [i for i, _ in good], n, dev, centred @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / max(e.sum(), 1e-300)


def check(spark, rows, k=8, parts=4):
    out = whitening.whiten(vectors(spark, rows).repartition(parts), k).collect()
    ids, n, dev, white, explained = brute(rows)
    m = max((r.component for r in out), default=0)
    assert len(out) == len(ids) * m
    signs = {}
    by_dev = {}
    for place, (i, x) in enumerate(zip(ids, dev, strict=True)):
        by_dev.setdefault((i, x), []).append(place)
    for r in sorted(out, key=lambda r: -abs(r.whitened)):
        c = r.component - 1
        assert r.n == n and (r.vec_id, int(r.deviation)) in by_dev and r.identity_error < 1e-9
        assert abs(r.explained - explained[c]) < 1e-9
        wanted = [white[p, c] for p in by_dev[r.vec_id, int(r.deviation)]]
        sign = signs.setdefault(c, 1 if min(abs(r.whitened - w) for w in wanted) < min(abs(r.whitened + w) for w in wanted) else -1)
        assert min(abs(r.whitened * sign - w) for w in wanted) < 1e-7 * max(1, abs(r.whitened))
    return m


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 12)) * (1.3 ** np.arange(12)) * 0.1
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    bad = [(500, None), (501, [0.1, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11)]
    other = [(None, [0.3] * 12), (504, [0.2, 0.1]), (505, []), *rows[:9]]  # no id, shorter, empty, repeated
    assert check(spark, rows + bad + other) == 8


def test_large_entries_and_few_directions(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(0, 3e9))), float(np.float32(r.gauss(0, 2e9))), 0.5]) for i in range(200)]
    assert check(spark, rows) == 2  # the third direction has no variance; sums are beyond 64 bits
    assert check(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])]) == 1


def test_nothing_to_whiten(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [0.5, 0.5]) for i in range(9)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_too_wide(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMENSION", 2)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0])]))
