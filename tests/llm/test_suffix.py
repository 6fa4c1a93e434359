import random
import re

import pytest

from brute import documents, repeated_words
from conftest import SF0001
from crowdtrust.llm import suffix_dedup as sx


def words_of(spans, repeated):
    out = {}
    for r in spans:
        if r.repeated == repeated:
            out.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    return out


def check(spark, rows, partitions=4):
    cut, first, copies = repeated_words(rows)
    df = documents(spark, rows).repartition(partitions)
    spans = sx.repeated_spans(df).collect()
    n = {d: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows}
    assert words_of(spans, True) == cut | {d: set(range(n[d])) for d in copies}
    whole = {of: set(range(n[of])) for of in copies.values()}
    assert words_of(spans, False) == {d: first.get(d, set()) | whole.get(d, set()) for d in {*(k for k, v in first.items() if v), *whole}}
    kept = sx.cut_repeats(df)
    assert kept.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    want = {}
    for d, t in rows:
        if d in copies:
            continue
        if not cut.get(d):
            want[d] = (t, None if t is None else len(t))
        elif left := [w for i, w in enumerate(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) if i not in cut[d]]:
            assert re.findall(rb"[^\x20\x09-\x0D]+", got[d][0].encode()) == left
            want[d] = (got[d][0], len(got[d][0]))
    assert got == want
    return spans


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows)


def test_planted_passages(spark):
    r = random.Random(1)

    def prose(n):
        return [f"w{r.randint(0, 10**6)}" for _ in range(n)]

    rows = []
    for n in (49, 50, 51, 52, 60, 75, 76, 200):  # only those of 50 words and more count
        passage = prose(n)
        for k in range(3):
            rows.append((len(rows), " ".join(prose(r.randint(0, 90)) + passage + prose(r.randint(0, 90)))))
    both = prose(60), prose(70)
    rows += [(100, " ".join(both[0] + both[1])), (101, "\n".join(both[1] + prose(5) + both[0])), (102, "\t".join(both[0] + prose(3) + both[1]))]
    rows += [(110, "again " * 300), (111, "again " * 120 + "end"), (112, "a b c " * 100)]
    text = " ".join(prose(80))
    rows += [(120, text), (121, text), (122, text + " more"), (123, "é " + text), (130, None), (131, ""), (132, "short text"), (133, " " + " ".join(prose(50)) + " ")]
    spans = check(spark, rows)
    assert {r.partner_doc_id for r in spans if r.doc_id == 121} == {120}
    assert not {r.doc_id for r in spans} & {0, 1, 2, 130, 131, 132, 133}


def test_hot_passage_over_many_partitions(spark):
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(64))
    rows = [(i, " ".join(f"v{r.randint(0, 10**6)}" for _ in range(20)) + " " + (passage if i % 3 else "") + f" tail {i}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 40)  # runs of equal suffixes over many partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    rows = [(1, "head " + passage), (1, "head " + passage), (2, passage + " tail"), (None, "null " + passage), (None, "null " + passage)]
    out = sx.cut_repeats(documents(spark, rows)).collect()
    # rows repeated in full are one document; a null id comes first
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "null " + passage)] * 2 + [(1, "head ")] * 2 + [(2, "tail")]
    assert sx.cut_repeats(documents(spark, [])).collect() == [] and sx.repeated_spans(documents(spark, [])).collect() == []


@pytest.mark.parametrize("shared", [None, 7])
def test_texts_that_share_an_id(spark, shared):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    clean = " ".join(f"z{i}" for i in range(300))
    # the same passage at the same place of two texts, one that repeats another document's, a clean and a short one
    rows = [(shared, f"{a} one"), (shared, f"{a} two"), (shared, " ".join(f"y{i}" for i in range(200)) + f" {b} end"), (shared, clean),
            (shared, " ".join(f"s{i}" for i in range(55))), (1, f"{b} head"), (9, f"nine {c} {b}"), (shared, f"new {c}")]
    out = sorted((r.doc_id or 0, r.text) for r in sx.cut_repeats(documents(spark, rows).repartition(3)).collect())
    kept = sorted(t for _, t in out)
    assert len(out) == len(rows) and (shared or 0, clean) in out and (shared or 0, rows[4][1]) in out
    for passage in (a, b, c):  # every passage stays once
        assert sum(passage in t for t in kept) == 1
    assert {"one", "two"} & set(kept)
    b_owner = 1 if shared else 0  # the least id; null comes first
    assert [d for d, t in out if b in t] == [b_owner] and [d for d, t in out if c in t] == [shared or 0]
    spans = sx.repeated_spans(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.end_word - r.first_word) for r in spans if r.repeated) == sorted(
        [(shared or 0, 60), (7 if shared else 1, 60), (9, 120)])


def test_every_long_passage_keeps_a_suffix():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(50):
        w = r.integers(0, 1 << 63, 50).astype(np.uint64)
        at = np.flatnonzero(sx.minimisers(sx.window_hashes(w, sx.GRAM, 1)))
        assert len(at) and at[0] < sx.WINDOW


def test_least_passage(spark):
    with pytest.raises(ValueError):
        sx.repeats(documents(spark, []), min_words=20)
