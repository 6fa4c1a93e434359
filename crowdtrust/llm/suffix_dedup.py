"""Repeated passages by sparse suffix arrays.

A passage is ``min_words`` consecutive words (runs without ASCII white space).
The dense suffix array of a corpus has an entry per word; this one keeps only
the suffixes that start at *minimisers*: of every ``WINDOW`` consecutive
k-word grams the one with the least hash.  They depend on content alone, so
two copies of a passage keep the same suffixes, the first of them within its
first ``WINDOW`` words.

1. The kept suffixes of all documents are sorted by their next
   ``min_words - WINDOW + 1`` words (as a hash: any fixed order of contents
   serves) and compared with their neighbours.  What has an equal neighbour
   may lie in a repeated passage, all else cannot.
2. Matches are extended left to the next kept suffix and right to the full
   length: all passages that begin in the ``WINDOW`` words up to such a suffix
   are sorted and compared with their neighbours, exactly.
3. Equal passages: the first by (doc_id, text, position) is the original;
   different texts under one doc_id, or without one, are documents of their own.  A word is
   *repeated* if it lies in a later copy and in no original; so of every
   passage one whole occurrence stays.

Texts that occur several times are compared once, by the smallest doc_id;
the other documents with that text are repeats as a whole.

Sorting is by range partition with ties split by document and position, and
each task compares neighbours in passing, so a passage that a third of all
documents share is no single task's load.  Only a row or two per partition go
to the driver, to tell whether a run goes on in the next partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, fresh, mix64, per_process, small_batches, written, written_at

#: Words in the grams that minimisers are chosen from, and grams per choice.
GRAM, WINDOW = 8, 26
_WORD, _SEQ = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int):
    """(base^i, base^-i) modulo 2^64 for i < n."""
    import numpy as np

    def build(size):
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out

    size = 1 << max(16, (n - 1).bit_length())
    up, down = per_process(("powers", base, size), lambda: build(size))
    return up[:n], down[:n]


def window_hashes(values, width: int, salt: int = 0):
    """Hash of every ``width`` consecutive values (uint64)."""
    import numpy as np

    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(_SEQ + 2 * salt, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: len(values) - width + 1])


def words(raw: bytes):
    """(first byte, end byte, hash) of each word."""
    import numpy as np

    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(_WORD, len(b) + 1)
    letters = per_process("letters", lambda: mix64(np.arange(1, 257, dtype=np.uint64)))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(letters[b] * up[:-1], out=total[1:])
    return first, end, mix64((total[end] - total[first]) * down[first])


def _slide(values, width: int, pick):
    """pick (minimum or maximum) of every ``width`` consecutive values."""
    step = 1
    out, left = values, width
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(grams):
    """Mask: is the gram the least of some WINDOW consecutive ones?"""
    import numpy as np

    if len(grams) < WINDOW:
        return np.zeros(len(grams), dtype=bool)
    low = _slide(grams, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, dtype=np.uint64)
    return grams == _slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d (the id; null: the least long), th, tq (96 bits of hash of the text), text, in small batches."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), *_text_hash(text), text.alias("text"))


def _text_hash(text, th: str = "th", tq: str = "tq") -> list:
    return [F.xxhash64(text).alias(th), F.shiftright(F.xxhash64(F.lit("second"), text), 32).cast("int").alias(tq)]


def runs(rows: DataFrame, key: list[str], order: list[str], owner: str) -> tuple[DataFrame, str]:
    """(rows, folder of the table they are in).  Rows that share ``key`` with another row, in ``order``, with ``before``
    (an earlier row has that key) and ``partner`` (the ``owner`` of the row
    before, for the first row of the row after).  Rows equal in all of key and
    order count once.  All columns are integers.  ``rows`` should be a written
    table, since they are read twice: once for the bounds of the ranges."""
    names = key + order
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types = None

        def chunks():
            """Columns of each batch, with the last two rows of the one before."""
            nonlocal types
            held = None
            for batch in batches:
                types = batch.schema
                columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                if held is not None:
                    columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
                new = np.ones(len(columns[0]), dtype=bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                held = [c[new] for c in columns]
                if len(held[0]) > 2:
                    yield held, False
                    held = [c[-2:] for c in held]
            if held is not None:
                yield held, True

        begun = False
        for columns, last in chunks():
            n = len(columns[0])
            same = np.logical_and.reduce([columns[i][1:] == columns[i][:-1] for i in range(len(key))])
            before = np.concatenate([[False], same])
            after = np.concatenate([same, [False]])
            own = columns[names.index(owner)]
            partner = np.where(before, np.roll(own, 1), np.roll(own, -1))
            edge = np.zeros(n, dtype=np.int32)
            # rows but the last have seen both neighbours; the first was told in the chunk before
            lo, hi = (1 if begun else 0), (n if last else n - 1)
            if not begun:
                edge[0] += 1
            if last:
                edge[-1] += 2
            begun = True
            out = np.flatnonzero(before | after | (edge > 0))
            out = out[(out >= lo) & (out < hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[out], types.field(x).type) for c, x in zip(columns, names, strict=True)]
                + [pa.array(before[out]), pa.array(after[out]), pa.array(partner[out], pa.int64()), pa.array(edge[out]), pa.array([part] * len(out), pa.int32())],
                names=[*names, "before", "after", "partner", "edge", "part"])

    ordered = rows.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
    schema = ", ".join(f"{n} {fields[n]}" for n in names) + ", before boolean, after boolean, partner long, edge int, part int"
    found, path = written_at(ordered.mapInArrow(compare, schema), "suffix-runs")

    ends = found.filter("edge > 0").select("part", "edge", *key, owner).collect()  # two rows per partition at most
    firsts = {r["part"]: r for r in ends if r["edge"] & 1}
    lasts = {r["part"]: r for r in ends if r["edge"] & 2}
    joints = []
    for p, q in zip(sorted(lasts), sorted(firsts)[1:], strict=False):
        if all(lasts[p][k] == firsts[q][k] for k in key):
            joints += [(p, 2, False, lasts[p][owner], firsts[q][owner]), (q, 1, True, firsts[q][owner], lasts[p][owner])]
    spark = rows.sparkSession
    # one row per end that goes on beyond its partition
    by_end: dict = {}
    for p, e, b, _, other in joints:
        row = by_end.setdefault(p, [p, False, None, False, None])
        row[(1, 3)[e == 2]], row[(2, 4)[e == 2]] = True, other
    more = spark.createDataFrame(list(map(tuple, by_end.values())), "part int, joins_before boolean, owner_before long, joins_after boolean, owner_after long")
    found = found.join(F.broadcast(more), "part", "left")
    is_first, is_last = F.col("edge").bitwiseAND(1) > 0, F.col("edge").bitwiseAND(2) > 0
    left = is_first & F.coalesce("joins_before", F.lit(False))
    right = is_last & F.coalesce("joins_after", F.lit(False))
    partner = F.when(left, F.col("owner_before")).when(right & ~F.col("before") & ~F.col("after"), F.col("owner_after")).otherwise(F.col("partner"))
    found = found.select(*names, (F.col("before") | left).alias("before"), (F.col("after") | right).alias("after"), partner.alias("partner"))
    return found.filter("before or after").drop("after"), path


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """Kept suffixes (h, th, tq, x: first word) of all texts and, with null x, a
    row (th, tq, d, n_words) per document of ``min_words`` or more words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("h", pa.int64()), ("th", pa.int64()), ("tq", pa.int32()), ("x", pa.int32()), ("d", pa.int64()), ("n_words", pa.int32())])
        for batch in batches:
            for d, th, tq, text in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "tq")), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                w = words(raw)[2]
                n = len(w)
                if n < min_words:
                    continue
                h = window_hashes(w, min_words - WINDOW + 1)
                at = np.flatnonzero(minimisers(window_hashes(w, GRAM, 1)))
                at = at[at < len(h)]
                k = len(at)
                nulls = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(h[at].view(np.int64), 0)), pa.array(np.full(k + 1, th)), pa.array(np.full(k + 1, tq, dtype=np.int32)),
                    pa.array([*at.tolist(), None], pa.int32()), pa.chunked_array([nulls, pa.array([d], pa.int64())]).combine_chunks(),
                    pa.chunked_array([pa.nulls(k, pa.int32()), pa.array([n], pa.int32())]).combine_chunks()], schema=schema)

    def joined(batches):
        """Larger batches: a row per document and suffix is small."""
        import pyarrow as pa

        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.mapInArrow(joined, "h long, th long, tq int, x int, d long, n_words int")


def passages(docs_with_suffixes: DataFrame, min_words: int) -> DataFrame:
    """From (d, th, tq, text, xs) all passages that begin in the WINDOW words up
    to a suffix in ``xs``: g, g2 (96 bits of hash), d, th, tq, x."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, th, tq, text, xs in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "tq")), batch.column("text"), batch.column("xs"), strict=True):
                w = words(text.as_buffer().to_pybytes())[2]
                g = window_hashes(w, min_words)
                g2 = window_hashes(w, min_words, 2)
                near = np.zeros(len(w) + 1, dtype=np.int64)
                at = np.asarray(xs.values.to_numpy(zero_copy_only=False))
                np.add.at(near, np.maximum(at - WINDOW + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                x = np.flatnonzero(np.cumsum(near)[: len(g)] > 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[x].view(np.int64)), pa.array((g2[x] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(len(x), d)),
                    pa.array(np.full(len(x), th)), pa.array(np.full(len(x), tq, dtype=np.int32)), pa.array(x.astype(np.int32))], names=["g", "g2", "d", "th", "tq", "x"])

    return docs_with_suffixes.select("d", "th", "tq", "text", "xs").mapInArrow(run, "g long, g2 int, d long, th long, tq int, x int")


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, copies), written tables.  texts: th, tq, d (the document that
    stands for the text), later, first: the passages, by first word, that are
    later copies and originals.  copies: th, tq, d, n_words, of: documents
    whose whole text is that of document ``of``.  Every other table that was
    written on the way is deleted once its reader is written."""
    if min_words < GRAM + WINDOW:
        raise ValueError(f"min_words must be at least {GRAM + WINDOW}")
    spark, text_key = docs.sparkSession, ["th", "tq"]
    keyed = _keyed(docs, id_col, text_col)
    kept, kept_path = written_at(suffixes(keyed, min_words), "suffix-kept")
    whole = kept.filter("x is null").select("th", "tq", "d", "n_words")
    # written, so that the join below may split a text that very many documents have
    stands, stands_path = written_at(whole.groupBy(*text_key).agg(F.min("d").alias("of"), F.count("*").alias("n")), "suffix-texts")
    copies = written(whole.join(stands.filter("n > 1").select("th", "tq", "of"), text_key).filter("d <> of").distinct(), "suffix-copies")
    hits, hits_path = runs(kept.filter("x is not null").select("h", "th", "tq", "x"), ["h"], ["th", "tq", "x"], "th")
    xs = hits.groupBy(*text_key).agg(F.collect_list("x").alias("xs"))  # one document's suffixes
    xs = xs.join(stands.select("th", "tq", "of"), text_key).withColumnRenamed("of", "d")
    texts = keyed.join(xs, [*text_key, "d"])
    if _has_repeated_rows(whole):
        texts = texts.dropDuplicates([*text_key, "d"])
    found, found_path = written_at(passages(texts, min_words), "suffix-passages")
    for p in (kept_path, hits_path, stands_path):
        delete_path(spark, p)
    # different texts may share an id (all that have none do): a passage belongs to its text
    same, same_path = runs(found, ["g", "g2"], ["d", "th", "tq", "x"], "d")
    delete_path(spark, found_path)
    found = same.groupBy("th", "tq", "d").agg(
        F.collect_list(F.when(F.col("before"), F.struct("x", "partner"))).alias("later"),
        F.collect_list(F.when(~F.col("before"), F.struct("x", "partner"))).alias("first"))  # one text's passages
    out = written(found, "suffix-repeats")
    delete_path(spark, same_path)
    return out, copies


def _has_repeated_rows(whole: DataFrame) -> bool:
    return not whole.groupBy("th", "tq", "d").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def islands(later, first, min_words: int):
    """Word ranges (from, to, repeated, partner): what to cut, and originals."""
    import numpy as np

    def cover(starts):
        edge = np.zeros(size + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + min_words, -1)
        return np.cumsum(edge)[:-1] > 0

    a, b = (np.array([s["x"] for s in side], dtype=np.int64) for side in (later, first))
    size = int(max([*a, *b])) + min_words
    original = cover(b)
    out = []
    for mask, repeated, side, starts in ((cover(a) & ~original, True, later, a), (original, False, first, b)):
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        order = np.argsort(starts)
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = int(np.searchsorted(starts[order], lo - min_words, side="right"))
            out.append((lo, hi, repeated, int(side[order[min(k, len(order) - 1)]]["partner"])))
    return out


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per span: doc_id, first_word, end_word (exclusive), repeated
    (true: a later copy; false: the original that stays), partner_doc_id (a
    document with the same passage; it may be the same document).

    Null text counts as empty; texts of fewer than ``min_words`` words have no
    spans; rows repeated in full are one document; documents with a null id
    and equal texts, too; different texts under one id (or a null one) are
    compared like any others, and their spans bear that id; an empty table
    gives no rows; other columns are not read.
    """
    texts, copies = repeats(docs, min_words, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(d, *s) for d, later, first in zip(*(batch.column(c).to_pylist() for c in ("d", "later", "first")), strict=True)
                    for s in islands(later, first, min_words)]
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "lo", "hi", "repeated", "partner"), r, strict=True)) for r in rows],
                                             schema=pa.schema([("d", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("repeated", pa.bool_()), ("partner", pa.int64())]))

    spans = texts.select("d", "later", "first").mapInArrow(run, "d long, lo int, hi int, repeated boolean, partner long")
    spans = spans.union(copies.select("d", F.lit(0), "n_words", F.lit(True), "of"))
    # a text that has copies is their original as a whole, but for what it repeats itself
    spans = spans.union(copies.groupBy("of").agg(F.max("n_words").alias("n"), F.min("d").alias("c")).select("of", F.lit(0), "n", F.lit(False), "c"))
    none = F.lit(-(1 << 63))
    return spans.select(F.nullif("d", none).alias("doc_id"), F.col("lo").alias("first_word"), F.col("hi").alias("end_word"), "repeated",
                        F.nullif("partner", none).alias("partner_doc_id"))


def cut_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents without their repeated words; a document of which no word
    is left goes.  ``length_col``, where there is one, is set anew for texts
    that were cut.  All other columns stay; texts without repeats stay as they
    are, null and empty ones included.  Rows repeated in full are one document
    and stay or are cut alike."""
    texts, copies = repeats(docs, min_words, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cuts = [[{"lo": lo, "hi": hi} for lo, hi, repeated, _ in islands(later, first, min_words) if repeated]
                    for later, first in zip(*(batch.column(c).to_pylist() for c in ("later", "first")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("th"), batch.column("tq"), pa.array(cuts, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                                             names=["th", "tq", "cuts"])

    spans = texts.select("th", "tq", "later", "first").mapInArrow(run, "th long, tq int, cuts array<struct<lo:int,hi:int>>").filter("size(cuts) > 0")
    stands = copies.groupBy("th", "tq").agg(F.min("of").alias("of"))
    spans = spans.join(stands, ["th", "tq"], "full_outer")

    taken = [*docs.columns]
    name = {}
    for x in ("th", "tq", "of", "cuts", "key", "key2"):
        name[x] = fresh(taken, x)
        taken.append(name[x])
    spans = spans.select(F.col("th").alias(name["key"]), F.col("tq").alias(name["key2"]), F.col("of").alias(name["of"]), F.col("cuts").alias(name["cuts"]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    all_ = docs.select("*", *_text_hash(text, name["th"], name["tq"]))
    all_ = all_.join(spans, (F.col(name["th"]) == F.col(name["key"])) & (F.col(name["tq"]) == F.col(name["key2"])), "left")
    all_ = all_.filter(F.col(name["of"]).isNull() | (d == F.col(name["of"])))  # whole copies go

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            t, c = batch.schema.get_field_index(text_col), batch.column(name["cuts"])
            new = [x.as_py() if not spans.is_valid else without(x.as_py() or "", [(s["lo"], s["hi"]) for s in spans.as_py()])
                   for x, spans in zip(batch.column(t), c, strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[t] = pa.array(new, batch.schema.field(t).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    all_ = all_.drop(*(name[x] for x in ("th", "tq", "key", "key2", "of")))
    was_cut = F.size(F.coalesce(F.col(name["cuts"]), F.array())) > 0
    out = all_.mapInArrow(cut, all_.schema).filter(~was_cut | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(was_cut, F.char_length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without words lo to hi of each cut and the white space behind them."""
    raw = text.encode()
    first = words(raw)[0].tolist()
    out, at = [], 0
    for lo, hi in sorted(cuts):
        out.append(raw[at: first[lo]])
        at = first[hi] if hi < len(first) else len(raw)
    return (b"".join(out) + raw[at:]).decode()
