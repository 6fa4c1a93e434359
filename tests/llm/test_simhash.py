import random

import numpy as np
import pytest

from brute import components, documents, simhash, simhash_classes
from conftest import SF0001
from crowdtrust.llm import simhash_dedup as sd
from crowdtrust.llm.components import connected_components


def near(rows):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in rows}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 500)}" for _ in range(3000)).split()
    for i in range(60):  # near copies of a long text: few bits apart, in chains
        long[r.randrange(3000)] = f"edit{i}"
        rows.append((10_000 + i, " ".join(long)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "one"), (20_004, "ONE"), (20_005, "two words"), (20_006, "Ünï two")]
    assert near(sd.near_duplicates(documents(spark, rows), 3, 3).collect()) == simhash_classes(rows)


def test_null_and_repeated_ids(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "other words here"), (9, "A B c d"), (3, None)]
    out = sorted(((r.doc_id or 0, r.component_id) for r in sd.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert out == sorted([(4, 4), (4, 4), (0, 4), (0, None), (9, 4), (3, 3)], key=str)
    df = documents(spark, rows)
    kept = sd.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "other words here"), (3, ""), (4, "a b c d")]
    assert sd.near_duplicates(documents(spark, [])).collect() == [] and sd.keep_one(documents(spark, [])).collect() == []


@pytest.mark.parametrize("limit, words", [(1 << 20, 1 << 21), (0, 1 << 21), (0, 1)])
def test_a_row_is_told_by_id_and_text(spark, monkeypatch, limit, words):
    """One id with different texts, near copies among them, null ids and repeated rows; by broadcast list and by Bloom filter (full, too)."""
    monkeypatch.setattr(sd, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(sd, "BLOOM_WORDS", words)
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    long = prose(4000).split()
    near_copy = " ".join([*long[:2000], "edit", *long[2001:]])
    clean = [prose(60) for _ in range(40)]
    rows = [(1, t) for t in clean[:3]] + [(None, t) for t in clean[3:6]] + [(100 + i, t) for i, t in enumerate(clean[6:])]
    rows += [(5, " ".join(long)), (9, near_copy), (9, clean[0] + " more"), (9, near_copy), (7, clean[7]), (None, clean[8]), (None, clean[3]), (1, clean[1]), (108, clean[20])]
    out = [(x.doc_id, x.text) for x in sd.keep_one(documents(spark, rows).repartition(3)).collect()]
    each = list(dict.fromkeys(rows))
    fp = [simhash(t) for _, t in each]
    links = [(i, j) for i in range(len(each)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    members: dict = {}
    for i, root in components(range(len(each)), links).items():
        members.setdefault(root, []).append(each[i])
    assert len(members) < len(each) and len(out) == len(members)
    for of in members.values():
        kept = [x for x in of if x in out]
        assert len(kept) == 1 and (kept[0][0] is None, kept[0][0]) == min(((d is None, d) for d, _ in of), key=lambda x: (x[0], x[1] or 0))


def test_the_list_of_rows_that_go_moves_no_texts(spark):
    docs = documents(spark, [(i, f"text {i // 2}") for i in range(50)])
    plan = sd.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("n, hot, m", [(300, 256, 3), (3000, 256, 4), (3000, 2, 3), (1500, 16, 2), (40, 1, 4)])
def test_links_against_brute_force(spark, monkeypatch, n, hot, m):
    """A dense cluster (differences in a few bits), a loose one and scattered fingerprints."""
    monkeypatch.setattr(sd, "HOT_SLOT", hot)
    monkeypatch.setattr(sd, "PARTITIONS", m)
    r = random.Random(n)
    base, fps = r.getrandbits(64), {0, (1 << 64) - 1}
    bits = r.sample(range(64), 14)
    while len(fps) < n:
        kind = r.random()
        if kind < 0.5:
            fps.add(base ^ sum(1 << b for b in r.sample(bits, r.randint(0, 7))))
        elif kind < 0.8:
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))))
        else:
            fps.add(r.getrandbits(64))
    a = np.array(sorted(fps), dtype=np.uint64)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    want = {tuple(sorted((int(np.int64(a[i])), int(np.int64(a[j]))))) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)}
    df = spark.createDataFrame([(int(np.int64(x)),) for x in a], "fp long")
    got = [(r.a, r.b) for r in sd.link_fingerprints(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("m", [2, 3, 4])
def test_thresholds_keep_the_pigeonhole_sum(m):
    r = np.random.default_rng(m)
    fps = r.integers(0, 1 << 63, 500).astype(np.uint64)
    groups = [list(range(64))[i::m] for i in range(m)]
    histogram = np.zeros((m, sd.SLOTS), dtype=np.int64)
    for i, g in enumerate(groups):
        histogram[i] += np.bincount(sd.slot(fps & np.uint64(sum(1 << b for b in g)), i), minlength=sd.SLOTS)
    histogram[0] *= 1000  # a partition of common values
    t = sd.allocate(fps, groups, [sd.flips(g, 3) for g in groups], histogram, 3)
    assert (t.sum(axis=1) == 3 - m + 1).all() and (t >= -1).all()
    assert (t[:, 0] <= t[:, 1:].max(axis=1)).all() and t[:, 0].mean() < t[:, 1:].mean()


def test_fingerprint_is_the_plain_one():
    for t in ("", "a", "A b", "a b c", "Straße STRASSE ÀÉ x", "w " * 70_000):
        assert sd.fingerprint(t) == simhash(t)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (-5, 3)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()}
    assert got == {(n, -5) for n in [-5, *range(41)]} | {(n, 100) for n in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "p long, q long"), "p", "q").collect() == []
