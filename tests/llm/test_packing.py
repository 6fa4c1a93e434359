import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from brute import documents
from crowdtrust.llm import packing

VOCABULARY = path("byte_bpe_50k.json")


def check_pieces(pieces, docs, capacity=1024):
    """pieces: (doc, start, length, ids, sequence, offset); docs: doc -> ids.  Every id in one
    piece, sequences gapless and full but for a few of power-of-two length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[4]].append(p)
    assert set(by_doc) == set(docs)
    for d, own in by_doc.items():
        assert sum((p[3] for p in sorted(own, key=lambda p: p[1])), []) == docs[d]
        assert [p[1] for p in sorted(own)] == list(np.cumsum([0, *(p[2] for p in sorted(own))])[:-1])
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p[5]):
            assert p[5] == at and len(p[3]) == p[2] > 0
            at += p[2]
        assert at == capacity or at < capacity and not at & (at - 1)
        short += at < capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return short


@pytest.mark.parametrize("lengths", [[], [5], [700] * 10 + [512] * 3, list(range(1, 1024)), [600] * 4000 + [424] * 700 + [3, 9], [1023] * 50 + [1] * 7])
def test_plan_places_every_remainder_once(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    rows, sequences, tape = packing.plan(histogram, 1024)
    assert tape == sum((histogram[x] - first) * x for x, _, first, _ in rows)
    filled = defaultdict(int)
    for x, runs, first, _ in rows:
        assert [r[0] for r in runs] == [0, *(r[1] for r in runs)][:-1] and (runs[-1][1] if runs else 0) == first
        for lo, hi, sequence, copies, _ in runs:
            for s in range((hi - lo) // copies):
                filled[sequence + s] += copies * x
    assert len(filled) == sequences and all(v == 1024 or not v & (v - 1) for v in filled.values())


def test_column_generation_reaches_the_volume_bound():
    r = np.random.default_rng(3)
    lengths, demand = np.unique(r.integers(1, 1024, 30000), return_counts=True)
    patterns, used = packing.column_generation(lengths, demand, 1024)
    assert np.allclose(patterns @ used, demand, atol=1e-3) and (lengths @ patterns <= 1024).all()
    assert used.sum() <= 1.01 * (lengths @ demand) / 1024
    # nothing fits together: one sequence for each
    patterns, used = packing.column_generation(np.array([600, 700]), [5, 9], 1024)
    assert abs(used.sum() - 14) < 1e-3


def test_pack(spark):
    library = Tokenizer.from_file(VOCABULARY)
    r = np.random.default_rng(0)
    rows = [(i, "word " * int(r.integers(0, 3000))) for i in range(150)] + [(1000 + i, "copy of " * 300) for i in range(120)] + [(2000, None), (2001, ""), (2002, "é" * 9000)]
    pieces = packing.pack(documents(spark, rows).repartition(5), VOCABULARY).collect()
    docs = {d: [*library.encode(t or "").ids, 0] for d, t in rows}
    own = [(p.doc_id, p.start, p.length, np.frombuffer(p.ids, dtype="<u4").tolist(), p.sequence_id, p.offset) for p in pieces]
    assert check_pieces(own, docs) <= 11
    assert all(p.doc_tokens == len(docs[p.doc_id]) for p in pieces)
    assert zlib.crc32(pieces[0].ids) == zlib.crc32(np.array(own[0][3], dtype="<u4").tobytes())


def test_pack_odd_tables(spark):
    assert packing.pack(documents(spark, []), VOCABULARY).collect() == []
    out = packing.pack(documents(spark, [(None, "a b"), (None, "a b"), (1, None)]), VOCABULARY).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in out if p.start == 0) == [(0, 3), (0, 3), (1, 1)]
    assert sum(p.length for p in out) == 7
