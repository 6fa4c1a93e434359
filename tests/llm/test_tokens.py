import array
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from brute import documents
from crowdtrust.llm import bpe, grammar, tokens
from crowdtrust.session import scratch_path

VOCABULARY = path("byte_bpe_50k.json")
BITS = ["a", " ", "  ", "\n", "\t", "'s", "'ll", "'", "é", "ß", "ñ", "×", "中", "文", "😀", " ", "​", "²", "٣", "_", "-", "...", ".", ",",
        "<|endoftext|>", "the", "ing", " and", "\x1c", "\x85", "　", "A", "ZZ", "\x00", "é", "़", "क", "ƀ", "ɏ", "ɐ", "՘", "1", "23"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", " ", "a" * 5000, "the " * 3000, "<|endoftext|>" * 3, "x." * 2000]


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def test_units_give_the_librarys_ids(library, texts, monkeypatch):
    encoder = tokens.UnitEncoder(VOCABULARY)
    assert [ids_of(encoder.encode(t)) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 3000)
    assert [ids_of(x) for x in encoder.encode_all(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode_all(pa.array([], pa.string())) == [] and encoder.encode_all(pa.array(["", "a b", ""]).slice(1)) == [encoder.encode("a b"), b""]
    spaces = [c for c in map(chr, range(0x11000)) if c.isspace()]
    assert all(pc.match_substring_regex(pa.array([f"a{c} b"]), tokens._ODD)[0].as_py() for c in spaces)
    encoder = tokens.UnitEncoder(VOCABULARY, max_units=40)  # the halves change places all the time
    assert [ids_of(encoder.encode(t)) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder) <= 40 * 100


def test_lines_are_remembered_by_their_words(library):
    """What stands on both sides of a line end is remembered apart, so a known word at it costs no new unit."""
    encoder = tokens.UnitEncoder(VOCABULARY)
    for text in ("so thly.\nErat", " thly.\nAnd", "a.\n\nb", "x \ny", "\nA", "a\n", "\'s\n\'s", "a\x1c\nb", "é\nÉa\n1", "a\r\nb", "A\nB\nC D"):
        assert ids_of(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert "thly" in encoder and "thly." in encoder and {"Erat", "And", "\n"} <= set(encoder.bares)


@pytest.mark.parametrize("build", [tokens.UnitEncoder, bpe.BacktrackingBPE])
def test_unsuitable_vocabularies_are_refused(tmp_path, build):
    with pytest.raises(ValueError, match="normalizer"):
        build(path("word_bpe_49k.json"))
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec["added_tokens"][0]
    for k, (part, change) in enumerate([
        ("normalizer", {"type": "Lowercase"}),
        ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}),
        ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}),
        ("pre_tokenizer", None),
        ("model", spec["model"] | {"end_of_word_suffix": "</w>"}),
        ("model", spec["model"] | {"ignore_merges": True}),
        ("model", spec["model"] | {"vocab": {t: i for t, i in spec["model"]["vocab"].items() if t != "a"}}),
        ("added_tokens", [added | {"lstrip": True}]),
        ("added_tokens", [added | {"content": "two words"}]),
    ]):
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps(spec | {part: change}))
        with pytest.raises(ValueError, match="not a tokenizer"):
            build(str(file))


def test_backtracking_gives_the_librarys_ids_and_text(library, texts):
    own = bpe.BacktrackingBPE(VOCABULARY)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        raw = own.encode(t)
        assert ids_of(raw) == ids
        assert own.decode(raw) == library.decode(ids, skip_special_tokens=False) == t
    odd = array.array("I", library.encode("中", add_special_tokens=False).ids[:1]).tobytes()  # not a whole character
    assert own.decode(odd) == library.decode(ids_of(odd), skip_special_tokens=False)


def test_encode_decode_rows(spark, library):
    rows = [(1, "Hello world."), (2, None), (None, "x y"), (3, ""), (1, "Hello world."), (4, "long " * 20000)]
    out = bpe.encode_decode(documents(spark, rows), VOCABULARY).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((d or -1, len(library.encode(t or "").ids)) for d, t in rows)
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert {r.decoded for r in out} == {t or "" for _, t in rows}
    assert bpe.encode_decode(documents(spark, []), VOCABULARY).collect() == []


def shard_row(ids, rules, symbols, terminals):
    sizes = np.array(grammar.rule_sizes(rules, terminals), dtype="<u4")
    return {"terminals": terminals, "n_ids": len(ids), "rules": rules.astype("<u4").tobytes(), "rule_sizes": sizes.tobytes(), "symbols": symbols.astype("<u4").tobytes(),
            "anchors": grammar.anchors(symbols, sizes, terminals).astype("<u8").tobytes()}


@pytest.mark.parametrize("anchor", [1, 3, 512])
def test_random_access(monkeypatch, anchor):
    monkeypatch.setattr(grammar, "ANCHOR", anchor)
    r = np.random.default_rng(anchor)
    phrases = [r.integers(0, 50, r.integers(2, 40)) for _ in range(60)]
    ids = np.concatenate([phrases[i] for i in r.integers(0, 60, 900)]).astype(np.uint32)
    ends = np.arange(len(ids)) % 700 == 699
    ends[-1] = True
    rules, symbols, _ = grammar.compress(ids, ends, 50)
    shard = shard_row(ids, rules, symbols, 50)
    for lo, hi in [(0, 1), (len(ids) - 1, len(ids)), (0, len(ids)), (-5, 10 ** 9), (7, 7), (9, 3), *(sorted(r.integers(0, len(ids) + 1, 2).tolist()) for _ in range(60))]:
        assert (grammar.read_range(shard, lo, hi) == ids[max(lo, 0): max(hi, 0)]).all()
    for i in r.integers(0, len(ids), 300).tolist():
        assert grammar.read_range(shard, i, i + 1).tolist() == [ids[i]]


def test_one_id_costs_the_same_in_a_large_shard():
    """One id of a shard of eight times the size takes about as long, and far less than expanding the shard."""
    import timeit

    r = np.random.default_rng(0)
    phrases = [r.integers(0, 5000, r.integers(2, 60)) for _ in range(3000)]
    took = []
    for n in (2000, 16000):
        ids = np.concatenate([phrases[i] for i in r.integers(0, 3000, n)]).astype(np.uint32)
        rules, symbols, _ = grammar.compress(ids, np.arange(len(ids)) == len(ids) - 1, 5000)
        shard = shard_row(ids, rules, symbols, 5000)
        took.append(min(timeit.repeat(lambda: grammar.read_range(shard, len(ids) // 2, len(ids) // 2 + 1), number=20, repeat=5)) / 20)  # noqa: B023
        whole = min(timeit.repeat(lambda: grammar.expand(symbols, rules, 5000), number=1, repeat=3))  # noqa: B023
    assert took[1] < 4 * took[0] and took[1] < whole / 5


def test_grammar_round_trip_and_ranges():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 6, 20000), np.zeros(1000, int), np.arange(500), np.tile([1, 2, 3, 4], 900), np.zeros(0, int), np.array([7])):
        ids = ids.astype(np.uint32)
        ends = np.zeros(len(ids), bool)
        if len(ids):
            ends[r.integers(0, len(ids), 1 + len(ids) // 97)] = True
            ends[-1] = True
        rules, symbols, last = grammar.compress(ids, ends, 600, min_count=4)
        assert (grammar.expand(symbols, rules, 600) == ids).all()
        sizes = grammar.rule_sizes(rules, 600)
        size = np.array([1 if s < 600 else sizes[s - 600] for s in symbols.tolist()], dtype=int)
        assert (np.cumsum(size)[last] - 1 == np.flatnonzero(ends)).all()  # no pair across a document's end
        shard = shard_row(ids, rules, symbols, 600)
        for lo, hi in [(0, len(ids)), (0, 0), *(sorted(r.integers(0, len(ids) + 1, 2).tolist()) for _ in range(20))]:
            assert (grammar.read_range(shard, lo, hi) == ids[lo:hi]).all()
    assert len(grammar.compress(np.tile([1, 2, 3, 4], 9000), np.arange(36000) % 3600 == 3599, 50)[1]) < 1000


def repeated_pairs(symbols, last):
    """Pairs that occur twice without overlap, documents' ends apart."""
    count, end = {}, {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if not last[i] and end.get(pair, -1) < i:
            count[pair], end[pair] = count.get(pair, 0) + 1, i + 1
    return [p for p, n in count.items() if n > 1]


def test_grammar_leaves_no_repeated_pair():
    r = np.random.default_rng(3)
    phrases = [r.integers(0, 500, r.integers(2, 30)) for _ in range(300)]
    ring = np.concatenate([[1000 + 3 * i, 1000 + 3 * ((i + 1) % 9), 1000 + 3 * ((i + 2) % 9), 2000 + i] for i in range(9)])  # every pair meets another
    for ids in (np.concatenate([phrases[i] for i in r.integers(0, 300, 2000)]), np.tile(np.arange(700), 2), ring, r.integers(0, 3, 5000), np.array([7, 7, 7, 7, 7, 8, 7, 7])):
        ends = np.zeros(len(ids), bool)
        ends[[len(ids) // 3, -1]] = True
        rules, symbols, last = grammar.compress(ids, ends, 5000)
        assert (grammar.expand(symbols, rules, 5000) == ids).all() and not repeated_pairs(symbols, last)
    assert len(grammar.compress(np.tile(np.arange(700), 2), np.arange(1400) == 1399, 5000)[1]) == 2
    assert len(grammar.compress(np.arange(5) % 2, np.ones(5, bool), 50)[1]) == 5


def test_pairs_found_once_are_not_looked_at_again(monkeypatch):
    """Rounds that replace little sort little: what occurs once stays out of them."""
    looked = []
    real = grammar._sorted
    monkeypatch.setattr(grammar, "_sorted", lambda pair, symbols: looked.append(len(pair)) or real(pair, symbols))
    r = np.random.default_rng(3)
    ids = r.zipf(1.3, 60_000).astype(np.uint32) % 5000
    ends = np.arange(len(ids)) % 500 == 499
    rules, symbols, last = grammar.compress(ids, ends, 5000)
    assert (grammar.expand(symbols, rules, 5000) == ids).all() and not repeated_pairs(symbols, last)
    assert len(looked) > 3 and looked[-1] < 300  # though thousands of the pairs that occur once share a slot


def test_pairs_are_sorted_alike_where_64_bits_do_not_hold_them():
    r = np.random.default_rng(4)
    pair = r.integers(0, 300, 5000).astype(np.uint64) << np.uint64(32) | r.integers(0, 300, 5000).astype(np.uint64)
    for symbols in (300, 1 << 31):
        order, values = grammar._sorted(pair, symbols)
        assert (values == np.sort(pair)).all() and (pair[order] == values).all()


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_token_files_of_many_shards(spark, library, monkeypatch, broadcast):
    """Several shards in a task, read back whole and by any range over all of them; part offsets broadcast or joined."""
    monkeypatch.setattr(grammar, "SHARD_IDS", 100)
    monkeypatch.setattr(grammar, "BROADCAST_BYTES", broadcast)
    r = random.Random(2)
    words = ["alpha", "beta", "gamma delta", "the", "of", "x1"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 80)))) for i in range(60)] + [(60, "long " * 2000)]
    where = scratch_path(spark, "many-shards")
    grammar.write_ids(documents(spark, rows).repartition(3), where, VOCABULARY, 2)
    shards = spark.read.schema(grammar.FORMAT).parquet(where).select("part", "shard", "ids_before", "n_ids").collect()
    assert len(shards) > 20 and max(x.shard for x in shards) > 1 and any(x.ids_before for x in shards)
    every = [i for _, t in rows for i in [*library.encode(t).ids, 2]]
    out = sorted(grammar.read_ids(spark, where).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in out] == list(range(61)) and [i for x in out for i in ids_of(x.ids)] == every
    assert [x.start for x in out] == np.cumsum([0, *(x.n_tokens for x in out)])[:-1].tolist()
    for lo, hi in [(0, 1), (0, len(every)), (len(every) - 1, len(every)), (250, 1700), (3, 3)]:
        pieces = sorted(grammar.read_span(spark, where, lo, hi).collect(), key=lambda x: x.start)
        assert [i for x in pieces for i in ids_of(x.ids)] == every[lo:hi]
        assert [x.start for x in pieces] == np.cumsum([lo, *(len(x.ids) // 4 for x in pieces)])[:-1].tolist()


def test_token_files(spark, library, monkeypatch):
    rows = [(5, "five " * 400), (2, None), (9, "Nine.\nlines"), (None, "no id"), (3, ""), (7, "seven " * 900), (2, None), (-4, "minus")]
    df = documents(spark, rows).repartition(4)
    out = grammar.write_and_read(df, VOCABULARY).collect()
    at = 0
    for r, (d, t) in zip(sorted(out, key=lambda r: r.start), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert r.doc_id == d and r.start == at and ids_of(r.ids) == [*library.encode(t or "").ids, 2] and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert grammar.write_and_read(documents(spark, []), VOCABULARY).collect() == []
