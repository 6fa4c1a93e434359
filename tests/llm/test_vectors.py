import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtrust.llm import ann_hilbert, exact_topk


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, rank string, score double")


def brute(rows, is_query, k, score):
    """rows with unique ids."""
    out = set()
    for q, a in rows:
        if is_query(q):
            s = sorted(((-score(a, b), i) for i, b in rows if i != q))[:k]
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def whole(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))


def odd_rows(r, dim):
    good = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.75]) for _ in range(dim)]) for i in range(130)]
    good += [(200 + i, [0.5] * dim) for i in range(150)]  # many ties
    bad = [(500, None), (550, [0.1, None] + [0.0] * (dim - 2)), (None, [0.5] * dim), (600, [float("nan")] * dim), (650, [float("inf")] * dim)]
    return good, bad


@pytest.mark.parametrize("bins", [512, 3])
def test_exact_topk(spark, monkeypatch, bins):
    monkeypatch.setattr(exact_topk, "BINS", bins)
    monkeypatch.setattr(exact_topk, "GROUP", 2)
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    good, bad = odd_rows(random.Random(1), 6)
    df = vectors(spark, good + bad + good[:9]).repartition(4)  # repeated rows count once
    out = [tuple(r) for r in exact_topk.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert len(out) == len(set(out)) and set(out) == brute(good, lambda i: i % 50 == 0, 5, whole)


def test_topk_of_few_and_none(spark):
    assert exact_topk.search(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert exact_topk.search(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
    assert exact_topk.search(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 50 == 0).collect() == []
    three = [(0, [1.0, 0.5]), (50, [-1.0, 0.0]), (7, [0.0, 0.0])]
    assert {tuple(r) for r in exact_topk.search(vectors(spark, three), F.col("vec_id") % 50 == 0).collect()} == brute(three, lambda i: i % 50 == 0, 5, whole)
    large = [(i, [float(3e4 * (i - 2)), 1e5 + i]) for i in range(0, 200, 10)]  # beyond what doubles add exactly
    large = [(i, np.float32(v).tolist()) for i, v in large]
    assert {tuple(r) for r in exact_topk.search(vectors(spark, large), F.col("vec_id") % 50 == 0).collect()} == brute(large, lambda i: i % 50 == 0, 5, whole)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = ann_hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0))
    assert (steps.sum(axis=1) == 1).all()


def inner(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def test_ann_is_exact_where_the_window_holds_all(spark):
    r = random.Random(2)
    good = [(i, np.float32([r.gauss(0, 1) * (1 + i % 3) for _ in range(8)]).tolist()) for i in range(150)]
    bad = [(500, None), (520, [0.0] * 8), (540, [0.1, None] + [0.0] * 6), (None, [0.5] * 8), (600, [float("nan")] * 8)]
    out = [tuple(r) for r in ann_hilbert.search(vectors(spark, good + bad + good[:5]).repartition(3), F.col("vec_id") % 20 == 0, k=20).collect()]
    assert len(out) == len(set(out)) and set(out) == brute(good, lambda i: i % 20 == 0, 20, inner)


def test_ann_few_and_none(spark):
    assert ann_hilbert.search(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert ann_hilbert.search(vectors(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert ann_hilbert.search(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0])]), F.col("vec_id") % 20 == 0).collect() == []
    two = [(0, [1.0, 0.5]), (3, [0.5, 0.5])]
    assert {tuple(r) for r in ann_hilbert.search(vectors(spark, two), F.col("vec_id") % 20 == 0).collect()} == brute(two, lambda i: i % 20 == 0, 20, inner)


def test_ann_recall_without_structure(spark, monkeypatch):
    """Directions at random, the hardest case, and a third of the vectors equal."""
    monkeypatch.setattr(ann_hilbert, "MIN_WINDOW", 1)
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 64))
    x[4000:] = x[4000]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = vectors(spark, [(i, v) for i, v in enumerate(x.tolist())])
    out = ann_hilbert.search(df, F.col("vec_id") % 200 == 0, k=20).collect()
    x = x.astype(float)
    found, wanted = 0, 0
    for q in range(0, 6000, 200):
        s = x @ x[q]
        s[q] = -9
        kth = np.sort(s)[-20]
        own = [r for r in out if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, 21)) or sorted(r.rank for r in own) == list(range(1, 21))
        found += sum(s[r.vec_id] >= kth - 1e-9 for r in own)
        wanted += 20
    assert found >= 0.9 * wanted


def test_ann_recall_beside_very_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann_hilbert, "MIN_WINDOW", 64)
    r = np.random.default_rng(6)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[17, 1234, 5001]] *= [[20.0], [1e4], [1.7]]
    x = x.astype(np.float32)
    out = ann_hilbert.search(vectors(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 200 == 0, k=20).collect()
    x = x.astype(float)
    found = 0
    for q in range(0, 6000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        found += sum(s[r.vec_id] >= kth - 1e-9 for r in out if r.query_id == q)
    assert found >= 0.93 * 600


def test_bands_of_length():
    unit, long = [(-1, 4000, 0.99, 0.9999), (0, 5000, 1.0, 1.001)], (69, 1, 400.0, 400.0)
    assert ann_hilbert.bands(unit) == [(0.99, 1.001)]  # rounding alone makes no band
    assert ann_hilbert.bands([*unit, long]) == [(400.0, 400.0), (0.99, 1.001)]
    assert ann_hilbert.bands([*unit, (-700, 3, 0.0, 1e-26)]) == [(0.0, 1.001)]
    many = [(i, 1 + 1000 // (1 + abs(i)), 2 ** (i / 8), 2 ** ((i + 1) / 8)) for i in range(-200, 200)]
    parted = ann_hilbert.bands(many)
    assert parted[0][1] == many[-1][3] and parted[-1][0] == many[0][2] and all(a[0] >= b[1] for a, b in zip(parted, parted[1:], strict=False))


def test_layout_holds_the_window():
    for w in (1, 63, 64, 200, 1000, 65536, 10 ** 6):
        size, reach = ann_hilbert.layout(w)
        assert size * (reach + 0.5) >= w and size <= ann_hilbert.BLOCK  # a query is half a block from its block's ends on average


def test_window_is_measured():
    r = np.random.default_rng(7)
    near = r.random((1900, ann_hilbert.CURVES)) * 1e-4  # clusters: a few narrow windows
    far = r.random((1900, ann_hilbert.CURVES)) ** 2  # no structure: more curves, wide windows
    few, narrow = ann_hilbert.choose(near)
    many, wide = ann_hilbert.choose(far)
    assert few == min(ann_hilbert.CHOICES) < many and narrow < 1e-4 < wide
    for x, c, share in ((near, few, narrow), (far, many, wide)):
        assert (x[:, :c].min(axis=1) <= share).mean() >= ann_hilbert.RECALL
    assert ann_hilbert.choose(np.zeros((0, ann_hilbert.CURVES))) == (min(ann_hilbert.CHOICES), 0.0)


def test_ann_of_clusters_scores_few_pairs(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 32))[r.integers(0, 60, 6000)] + 0.05 * r.normal(size=(6000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    chosen = []
    monkeypatch.setattr(ann_hilbert, "choose", lambda *a, choose=ann_hilbert.choose: chosen.append(choose(*a)) or chosen[-1])
    out = ann_hilbert.search(vectors(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 50 == 0, k=20).collect()
    x, found = x.astype(float), 0
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -9
        found += sum(s[r.vec_id] >= np.sort(s)[-20] - 1e-9 for r in out if r.query_id == q)
    curves, share = chosen[0]
    size, reach = ann_hilbert.layout(max(ann_hilbert.MIN_WINDOW, math.ceil(share * 6000) + 1))
    assert found >= 0.9 * 2400 and curves * size * (2 * reach + 1) < 0.5 * 6000
