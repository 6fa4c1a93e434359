import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import documents

from crowdtrust.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """docs, items: rows (id, text); a list of rows per item row."""
    own = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), n in zip(own, sizes, strict=True):
            if n:
                m = 100 - 25 + (25 * n * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, score string, q string")


def run(spark, docs, items, k=20, parts=4):
    return sorted(map(tuple, ls.search(documents(spark, docs).repartition(parts), asked(spark, items).repartition(2), k).collect()), key=repr)


def corpus(r, n, words):
    zipf = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(r.choices(words, zipf, k=r.randint(0, 60)))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, "?!  \n"), (None, "alpha w1 w2"), (None, "alpha w1 w2"), (903, "É É straße w3\tW3-w4"), (904, "x" * 5000 + " w1"), (903, "w5")]


@pytest.mark.parametrize("width, common, batch", [(512, 1 << 16, 1 << 15), (4, 3, 5), (1, 0, 1)])
def test_equals_scoring_everything(spark, monkeypatch, width, common, batch):
    """Wide and very narrow sketches (where bounds say next to nothing), few or no common terms, several batches of queries."""
    for name, value in (("WIDTH", width), ("COMMON", common), ("BATCH_TERMS", batch), ("CHUNK", 7), ("CELLS", 64)):
        monkeypatch.setattr(ls, name, value)
    r = random.Random(width)
    words = [f"w{i}" for i in range(80)] + ["Alpha", "ñandú"]
    docs = corpus(r, 300, words) + ODD
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # many equal scores
    docs.append((2000, " ".join(r.choices(words, k=30_000))))  # one very long text
    docs += docs[:4]  # repeated rows
    items = [(1, "w1 w2 w79 w79 alpha"), (2, docs[5][1]), (3, "nowhere at all"), (4, None), (5, ""), (6, "É STRASSE straße"), (None, "w70 w71"), (1, "W60"), (2, docs[5][1])]
    assert run(spark, docs, items, k=5) == brute(docs, items, 5)


def test_few_and_none(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None), (2, "..")], [(1, "a")]) == []
    assert run(spark, [(1, "a"), (2, "b a")], [(1, "a"), (2, "c")]) == brute([(1, "a"), (2, "b a")], [(1, "a"), (2, "c")])


def test_sketch_bounds_no_score_from_below(spark):
    """The sum of the coordinates' levels is never less than the exact impact sum of any document."""
    r = random.Random(4)
    docs = corpus(r, 200, [f"t{i}" for i in range(400)])
    index = ls.SketchIndex.build(documents(spark, docs))
    level = ls.levels() * (1 + 1e-9)
    place = ls.Coordinates(index.common)
    df = Counter(t for _, x in docs for t in set(split(x)))
    for row in index.rows.select("doc_id", "n", "sketch").collect():
        c, s = Counter(split(docs[row.doc_id][1])), np.frombuffer(row.sketch, np.uint8)
        m = ls.length_norm(row.n, index.n_docs, index.n_terms)
        assert row.n == sum(c.values())
        for t, tf in c.items():
            w, at = ls.weight(index.n_docs, df[t]), place[t.encode()] % (2 * ls.WIDTH)
            bound = level[s[at]] * ls.MOST * (index.most_weight if at < ls.WIDTH else w)
            assert bound >= w * ls.share(tf, m)
    index.drop()


def test_index_is_deleted(spark):
    index = ls.SketchIndex.build(documents(spark, [(1, "a b")]))
    found = index.search(asked(spark, [(1, "a")]))
    index.drop()
    assert [r.doc_id for r in found.collect()] == [1]
    with pytest.raises(Exception):
        index.rows.count()
