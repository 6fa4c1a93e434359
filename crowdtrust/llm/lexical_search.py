"""Ranked lexical search over hashed max-sketches.

The index has, for each document, a sketch of ``2 * WIDTH`` bytes.  A term's
impact on a document is its weight times its share of term frequency and
length.  Terms hash to coordinates, and a coordinate holds the largest impact
of the document's terms there, rounded up to one of 255 levels.  The most
common terms (a table of bounded size, with their weights) have coordinates of
their own; for all others impacts are folded without the weight, which the
query supplies.  So the sum of the coordinates of a query's terms, none above
the most that the term could give, is never less than the document's score.

A batch of queries is answered in two passes over the index:

1. Bounds alone: of the documents with the highest bounds for each query the
   exact scores are computed; the k-th best is a first threshold.
2. Bounds again, with the texts beside them.  Documents whose bound reaches
   the threshold of some query are scored exactly, highest bounds first, and
   each query's threshold rises to the k-th best score found so far.  What
   stays below its threshold cannot be among the k best.

Each task keeps k rows per query, whatever the ties and copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_path, id_and_text, per_process, written_at

#: Coordinates for common terms, and as many for the others.
WIDTH = 512
#: Most common terms in the table that every worker holds, and the longest one (bytes).
COMMON, COMMON_BYTES = 1 << 16, 64
#: Levels of impact: each is this much above the one below.
RATIO = 1.03
#: Terms whose coordinates a worker remembers; term counts it holds before it passes them on; bytes of text after which it does so anyway.
MEMORY, HELD_TERMS, HELD_BYTES = 1 << 20, 1 << 19, 256 << 20
#: Query terms in one batch of queries (a single query may have more).
BATCH_TERMS = 1 << 15
#: Documents scored for the first threshold, as a multiple of k.
FIRST = 3
#: Cells of the table of bounds that are computed at once, and documents scored between two looks at the thresholds.
CELLS, CHUNK = 1 << 21, 128

_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z become a-z, ASCII that is in no term becomes a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))
#: tf * 10^9 div (1000 tf + 12 m) is below this.
MOST = 1_000_000


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n, n_docs: int, n_terms: int):
    """m of documents with n terms (an int or an int64 array)."""
    return 100 - 25 + (25 * n * n_docs) // n_terms


def share(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def levels():
    """level[c]: what code c stands for, as a share of the most; code 0 is nothing."""
    import numpy as np

    out = RATIO ** (np.arange(256.0) - 255)
    out[0] = 0
    return out


class Coordinates(dict):
    """term -> weight * 2 * WIDTH + coordinate; the weight of terms that are not common is 1."""

    def __init__(self, common: dict[bytes, int]):
        self.common = common

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) > MEMORY:
            self.clear()
        at = xxhash.xxh64_intdigest(term, 11) % WIDTH
        own = self.common.get(term)
        out = self[term] = 2 * WIDTH + WIDTH + at if own is None else own * 2 * WIDTH + at
        return out


def _texts(batch) -> list[bytes]:
    import pyarrow as pa

    return batch.column("text").cast(pa.binary()).to_pylist()


@dataclass
class SketchIndex:
    """Written tables of an index; :meth:`drop` deletes them."""

    spark: SparkSession
    rows: DataFrame          # r, doc_id, n (terms), sketch, text of the documents that have terms
    df: DataFrame            # term, df
    n_docs: int
    n_terms: int
    most_weight: int
    common: dict[bytes, int]  # weights of the common terms
    paths: list[str]

    # ------------------------------------------------------------ build
    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "SketchIndex":
        import numpy as np

        spark = docs.sparkSession
        base = id_and_text(docs, id_col, text_col)

        def count(batches):
            import collections

            import pyarrow as pa

            n = total = held = 0
            found: collections.Counter = collections.Counter()

            def counted():
                out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64()), pa.nulls(len(found), pa.int64())],
                                                 names=["term", "df", "total"])
                found.clear()
                return out

            for batch in batches:
                held += batch.nbytes
                for text in _texts(batch):
                    own = terms(text)
                    if own:
                        n, total = n + 1, total + len(own)
                        found.update(set(own))
                        if len(found) > HELD_TERMS:
                            yield counted()
                if held > HELD_BYTES:
                    held = 0
                    yield counted()
            yield counted()
            if n:  # no term: the documents and all their terms
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([n]), pa.array([total])], names=["term", "df", "total"])

        counts = base.mapInArrow(count, "term binary, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        counts, counts_path = written_at(counts, "lexical-terms")
        whole = counts.filter("term is null").first()
        n_docs, n_terms = (whole["df"], whole["total"]) if whole else (0, 0)
        df = counts.filter("term is not null").select("term", "df")
        # the common terms: as many steps of falling df as fit
        step = F.floor(F.log2("df") * 16)
        short = df.filter(F.length("term") <= COMMON_BYTES).select("term", "df", step.alias("step"))
        taken, lowest = 0, None
        for s, c in sorted(map(tuple, short.groupBy("step").count().collect()), reverse=True):  # about a thousand steps at most
            if taken + c > COMMON:
                break
            taken, lowest = taken + c, s
        kept = short.filter(F.col("step") >= lowest).select("term", "df").toArrow().to_pylist() if lowest is not None else []  # COMMON rows
        common = {r["term"]: weight(n_docs, r["df"]) for r in kept}
        most_weight = max(common.values(), default=0)
        shared = spark.sparkContext.broadcast(common)
        key = ("lexical", counts_path)

        def fold(batches):
            import collections

            import pyarrow as pa

            known = per_process(key, lambda: Coordinates(shared.value))
            level = levels()
            for batch in batches:
                own = [terms(t) for t in _texts(batch)]
                some = np.flatnonzero([len(w) > 0 for w in own])
                if not len(some):
                    continue
                n = np.array([len(own[i]) for i in some], dtype=np.int64)
                found = [collections.Counter(own[i]) for i in some]
                size = np.array(list(map(len, found)))
                at = np.fromiter((known[t] for c in found for t in c), np.int64, size.sum())
                tf = np.fromiter((x for c in found for x in c.values()), np.int64, size.sum())
                doc = np.repeat(np.arange(len(some)), size)
                part = share(tf, length_norm(n, n_docs, n_terms)[doc])
                w, coordinate = at // (2 * WIDTH), at % (2 * WIDTH)
                most = np.where(coordinate < WIDTH, float(most_weight) * MOST, float(MOST))
                code = np.searchsorted(level[1:], w * part / np.maximum(most, 1) * (1 - 1e-12)) + 1  # the next level above
                code = np.where(w * part > 0, np.minimum(code, 255), 0).astype(np.uint8)
                sketch = np.zeros((len(some), 2 * WIDTH), dtype=np.uint8)
                np.maximum.at(sketch.reshape(-1), doc * (2 * WIDTH) + coordinate, code)
                chosen = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([chosen.column("r"), chosen.column("doc_id"), pa.array(n), pa.array([s.tobytes() for s in sketch], pa.binary()),
                                                  chosen.column("text")], names=["r", "doc_id", "n", "sketch", "text"])

        rows = base.withColumn("r", F.monotonically_increasing_id()).mapInArrow(fold, "r long, doc_id long, n long, sketch binary, text string")
        rows, rows_path = written_at(rows, "lexical-sketches")
        shared.destroy()
        return cls(spark, rows, df, n_docs, n_terms, most_weight, common, [counts_path, rows_path])

    def drop(self) -> None:
        for p in self.paths:
            delete_path(self.spark, p)

    # ------------------------------------------------------------ search
    def search(self, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score (see :func:`search`); a written table, independent of the index."""
        asked, asked_path = written_at(self._asked(items, id_col, text_col), "lexical-queries")
        out, paths = None, []
        for lo, hi in self._batches(asked):
            found, path = written_at(self._search_batch(asked.filter(F.col("q").between(lo, hi)), k), "lexical-found")
            out = found if out is None else out.unionByName(found)
            paths.append(path)
        if out is None:
            out = self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        delete_path(self.spark, asked_path)
        if len(paths) > 1:  # one table, and no plan that grows with the batches
            out, _ = written_at(out, "lexical-results")
            for p in paths:
                delete_path(self.spark, p)
        return out

    def _asked(self, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """q (one per item row), item_id, term, times."""

        def run(batches):
            import collections

            import pyarrow as pa

            for batch in batches:
                for q, item, text in zip(batch.column("q").to_pylist(), batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                    c = collections.Counter(terms(text))
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(c), pa.int64()), pa.array([item] * len(c), pa.int64()), pa.array(c.keys(), pa.binary()),
                                                      pa.array(c.values(), pa.int64())], names=["q", "item_id", "term", "times"])

        return id_and_text(items, id_col, text_col).withColumn("q", F.monotonically_increasing_id()).mapInArrow(run, "q long, item_id long, term binary, times long")

    def _batches(self, asked: DataFrame) -> list[tuple[int, int]]:
        """Ranges of q with at most ``BATCH_TERMS`` terms each, or one query alone.  Two numbers per query pass by the driver."""
        out: list[list[int]] = []
        size = 0
        for q, c in asked.groupBy("q").count().orderBy("q").toLocalIterator():
            if not out or size + c > BATCH_TERMS:
                out.append([q, q])
                size = 0
            out[-1][1] = q
            size += c
        return [(a, b) for a, b in out]

    def _search_batch(self, asked: DataFrame, k: int) -> DataFrame:
        import numpy as np

        spark = self.spark
        # df of the batch's terms; terms of no document give nothing
        known = self.df.join(F.broadcast(asked.select("term").distinct()), "term")
        t = asked.join(F.broadcast(known), "term").orderBy("q", "term").toArrow()  # BATCH_TERMS rows
        queries, q = np.unique(t.column("q").to_numpy(), return_inverse=True)
        item = dict(zip(t.column("q").to_pylist(), t.column("item_id").to_pylist(), strict=True))
        if not len(queries):
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        names = t.column("term").to_pylist()
        times = t.column("times").to_numpy()
        w = np.array([weight(self.n_docs, x) for x in t.column("df").to_pylist()], dtype=np.int64)
        place = Coordinates(self.common)
        at = np.array([place[x] % (2 * WIDTH) for x in names])
        starts = np.flatnonzero(np.r_[True, np.diff(q) > 0])
        # exact scores: the batch's different terms, each with the queries that hold it
        vocabulary = {x: i for i, x in enumerate(dict.fromkeys(names))}
        which = np.array([vocabulary[x] for x in names])
        order = np.argsort(which, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(which, minlength=len(vocabulary)))]
        shared = spark.sparkContext.broadcast((vocabulary, ends, q[order], (w * times)[order], at, w, times, starts))
        n_docs, n_terms, most_weight, n_queries = self.n_docs, self.n_terms, self.most_weight, len(queries)

        def bound_table():
            """value[i, code]: the most that the i-th query term can give where its coordinate holds the code."""
            *_, at, w, times, starts = shared.value
            level = levels() * (1 + 1e-9)
            common = np.minimum(np.ceil(level * float(most_weight) * MOST)[None, :], (w * float(MOST))[:, None])
            rare = np.ceil(level * MOST)[None, :] * w[:, None]
            return np.where((at < WIDTH)[:, None], common, rare) * times[:, None]

        def bounds(sketches, value, cells=CELLS):
            """Upper bounds (documents x queries) of a binary column of sketches, a block at a time: (first row, block)."""
            *_, at, _w, _times, starts = shared.value
            flat = np.frombuffer(sketches.buffers()[2], dtype=np.uint8)
            begin = sketches.offset
            first = np.frombuffer(sketches.buffers()[1], dtype=np.int32)[begin]
            s = flat[first: first + len(sketches) * 2 * WIDTH].reshape(-1, 2 * WIDTH)
            line = np.arange(len(at)) * 256
            step = max(1, cells // max(len(at), 1))
            values = value.reshape(-1)
            for lo in range(0, len(s), step):
                picked = values[line + s[lo: lo + step][:, at]]
                yield lo, np.add.reduceat(picked, starts, axis=1)

        def exact(texts: list[bytes], n):
            """Scores (documents x queries) of texts with n terms each."""
            import collections

            vocabulary, ends, by_q, by_w, *_ = shared.value
            doc, term, tf = [], [], []
            for i, text in enumerate(texts):
                c = collections.Counter(terms(text))
                for x in c.keys() & vocabulary.keys():
                    doc.append(i)
                    term.append(vocabulary[x])
                    tf.append(c[x])
            doc, term, tf = (np.array(x, dtype=np.int64) for x in (doc, term, tf))
            part = share(tf, length_norm(n, n_docs, n_terms)[doc])
            many = ends[term + 1] - ends[term]
            place = np.repeat(ends[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out = np.zeros((len(texts), n_queries), dtype=np.int64)
            np.add.at(out.reshape(-1), np.repeat(doc, many) * n_queries + by_q[place], by_w[place] * np.repeat(part, many))
            return out

        class Best:
            """The k best of each query so far: highest scores, then smallest ids, rows without id last."""

            def __init__(self, thresholds):
                self.thresholds = thresholds.copy()  # a document below cannot be among the k best
                self.q = self.score = self.doc = self.null = np.zeros(0, dtype=np.int64)

            def add(self, scores, ids, null):
                i, j = np.nonzero((scores >= self.thresholds[None, :]) & (scores > 0))
                q, score = np.r_[self.q, j], np.r_[self.score, scores[i, j]]
                doc, null = np.r_[self.doc, ids[i]], np.r_[self.null, null[i]]
                order = np.lexsort((doc, null, -score, q))
                q, score, doc, null = q[order], score[order], doc[order], null[order]
                first = np.flatnonzero(np.r_[True, np.diff(q) > 0]) if len(q) else np.zeros(0, dtype=np.int64)
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                last = rank == k - 1
                self.thresholds[q[last]] = np.maximum(self.thresholds[q[last]], score[last])
                keep = rank < k
                self.q, self.score, self.doc, self.null = q[keep], score[keep], doc[keep], null[keep]

            def batch(self):
                import pyarrow as pa

                return pa.RecordBatch.from_arrays([pa.array(self.q), pa.array(self.doc, mask=self.null.astype(bool)), pa.array(self.score)], names=["q", "doc_id", "score"])

        def ids_of(batch):
            import pyarrow.compute as pc

            ids = batch.column("doc_id")
            return ids.fill_null(0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)

        def highest(batches):
            """The rows with the highest bounds in this partition, for each query."""
            import pyarrow as pa

            value = bound_table()
            top = FIRST * k
            bound, row = np.zeros((0, n_queries)), np.zeros((0, n_queries), dtype=np.int64)
            for batch in batches:
                r = batch.column("r").to_numpy()
                for lo, b in bounds(batch.column("sketch"), value):
                    bound, row = np.r_[bound, b], np.r_[row, np.repeat(r[lo: lo + len(b), None], n_queries, axis=1)]
                    if len(bound) > top:
                        some = np.argpartition(-bound, top - 1, axis=0)[:top]
                        bound, row = np.take_along_axis(bound, some, axis=0), np.take_along_axis(row, some, axis=0)
            i, j = np.nonzero(bound > 0)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(row[i, j]), pa.array(bound[i, j])], names=["q", "r", "bound"])

        def score_all(batches):
            best = Best(np.zeros(n_queries, dtype=np.int64))
            for batch in batches:
                texts, n, (ids, null) = _texts(batch), batch.column("n").to_numpy(), ids_of(batch)
                for lo in range(0, len(texts), CHUNK):
                    best.add(exact(texts[lo: lo + CHUNK], n[lo: lo + CHUNK]), ids[lo: lo + CHUNK], null[lo: lo + CHUNK])
            yield best.batch()

        by_bound = Window.partitionBy("q").orderBy(F.col("bound").desc(), "r")
        first = self.rows.select("r", "sketch").mapInArrow(highest, "q long, r long, bound double")
        first = first.withColumn("rank", F.row_number().over(by_bound)).filter(F.col("rank") <= FIRST * k).select("r").distinct()
        chosen = self.rows.select("r", "doc_id", "n", "text").join(F.broadcast(first), "r", "left_semi")  # at most FIRST * k rows per query
        by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        scored = chosen.select("doc_id", "n", "text").mapInArrow(score_all, "q long, doc_id long, score long")
        kth = scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("q", "score").collect()  # a row per query
        thresholds = np.zeros(n_queries, dtype=np.int64)
        for x in kth:
            thresholds[x["q"]] = x["score"]
        begin = spark.sparkContext.broadcast(thresholds)

        def rescore(batches):
            value = bound_table()
            best = Best(begin.value)
            for batch in batches:
                column, n, (ids, null) = batch.column("text"), batch.column("n").to_numpy(), ids_of(batch)
                for lo, b in bounds(batch.column("sketch"), value):
                    over = (b - best.thresholds).max(axis=1)
                    order = np.argsort(-over, kind="stable")
                    for at in range(0, len(order), CHUNK):
                        some = order[at: at + CHUNK]
                        some = some[(b[some] >= best.thresholds).any(axis=1)]
                        if len(some):
                            texts = [column[int(lo + i)].as_py().encode() for i in some]
                            best.add(exact(texts, n[lo + some]), ids[lo + some], null[lo + some])
            yield best.batch()

        found = self.rows.select("doc_id", "n", "sketch", "text").mapInArrow(rescore, "q long, doc_id long, score long")
        names_of = spark.createDataFrame([(i, item[int(x)]) for i, x in enumerate(queries)], "q long, item_id long")
        found = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        return found.join(F.broadcast(names_of), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest
    scores above zero for each item, all if there are fewer; equal scores by
    ascending doc_id.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased.  N documents have a term, L is how many terms they have with
    repeats.  A term in df documents weighs floor(1000 ln((2N+2)/(2df+1))); a
    document with n terms has m = 75 + 25nN div L; a score sums weight *
    (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included.

    Null and empty texts have no terms: such documents count nowhere, such
    items give no rows.  Documents with a null id rank after equal scores with
    one.  Every row is a document or an item of its own, repeated rows too.
    Empty tables give no rows; other columns are not read.
    """
    index = SketchIndex.build(docs, id_col, text_col)
    out = index.search(items, k, item_col, item_text_col)
    index.drop()
    return out
