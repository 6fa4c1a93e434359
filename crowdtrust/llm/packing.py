"""Packing token sequences by cutting-stock column generation.

A document's ids are cut into full pieces of ``capacity`` ids, each a sequence
of its own, and one remainder.  The remainders' *length histogram* (at most
``capacity`` - 1 classes, whatever the input) is a cutting-stock problem: how
often is each pattern, a multiset of lengths that fits one sequence, used?
Its linear program is solved by column generation on the driver: a revised
simplex starts from a greedy triangular basis, and a knapsack dynamic program
over the dual prices finds the patterns that would better it.  Rounded down,
the pattern counts are dealt to the documents of each length class by rank.
What rounding leaves over, and what lay in patterns with waste, is laid end to
end and cut at sequence borders; the last sequences get power-of-two lengths.
So no sequence is padded, and only these leftovers are cut.

The plan: tokenise once and write the ids; count (part, length) pairs, which
gives every document its rank without sorting or gathering a length class;
solve; read the ids again and compute each piece's place by arithmetic.  The
table of ranks goes by broadcast only below ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, written
from .tokens import unit_encoder

#: Most bytes of per-part rank tables that are broadcast; a shuffled join beyond.
BROADCAST_BYTES = 32 << 20
#: The simplex ends after so many pivots, or at this relative gap to its bound; what it then leaves over is cut, not padded.
MAX_PIVOTS, GAP = 600, 1e-3

#: Pieces of text whose ids a worker remembers (see ``tokens.Units``): memory against time.
WORKER_UNITS = 600_000

_TOKENS = "part int, doc_id long, ids binary, n long, full long, rem int, rank_in_part long, full_before long"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text",
              worker_units: int | None = None) -> DataFrame:
    """Written table: a row per document with its ids and, within the task
    that made it, its rank among equal remainders and the full pieces before."""

    def run(batches):
        from array import array

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        units, end = unit_encoder(vocabulary, worker_units), array("I", [end_id]).tobytes()
        ranks, before = [0] * capacity, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                ids = [x + end for x in units.encode_all(b.column("text"))]
                rows = []
                for x in ids:
                    full, rem = divmod(len(x) // 4, capacity)
                    rows.append((len(x) // 4, full, rem, ranks[rem], before))
                    ranks[rem] += 1
                    before += full
                n, full, rem, rank, full_before = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(full, pa.int64()), pa.array(rem, pa.int32()), pa.array(rank, pa.int64()), pa.array(full_before, pa.int64())],
                    names=["part", "doc_id", "ids", "n", "full", "rem", "rank_in_part", "full_before"])
        pa.default_memory_pool().release_unused()  # the worker may stay, the memory is needed elsewhere

    return written(id_and_text(docs, id_col, text_col).mapInArrow(run, _TOKENS), "packing-ids")


def best_patterns(prices, lengths, capacity: int):
    """For each length class the dearest pattern that holds it (unbounded
    knapsack dynamic program); returns (columns m x k, their values)."""
    import numpy as np

    m = len(lengths)
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(lengths, c, side="right")
        value[c] = value[c - 1]
        if fit:
            gains = value[c - lengths[:fit]] + prices[:fit]
            k = int(gains.argmax())
            if gains[k] > value[c] + 1e-12:
                value[c], choice[c] = gains[k], k
    top = np.argsort(-(value[capacity - lengths] + prices))[:64]
    columns = np.zeros((m, len(top)))
    for j, k in enumerate(top):
        columns[k, j] += 1
        c = capacity - lengths[k]
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                columns[choice[c], j] += 1
                c -= lengths[choice[c]]
    return columns, prices @ columns


def first_basis(lengths, target, capacity: int):
    """A basis to start from: fill up the longest class still in demand with
    the longest others that leave no gap, use that pattern until a class runs
    out, and so on.  Each pattern ends one class and holds none that ended
    before, so the columns are triangular and the uses meet demand exactly."""
    import numpy as np

    left = dict(zip(lengths.tolist(), target.tolist(), strict=True))
    row = {x: i for i, x in enumerate(left)}
    basis = np.zeros((len(left), len(left)))
    for j in range(len(row)):
        order = sorted(left, reverse=True)
        sums = 1  # bit c: some multiset of the classes left has total c
        for x in order:
            step = x
            while step <= capacity:
                sums |= sums << step
                step *= 2
            sums &= (1 << capacity + 1) - 1
        held, room = {order[0]: 1}, capacity - order[0]
        while room > 0:
            x = next((x for x in order if x <= room and sums >> room - x & 1), None) or next((x for x in order if x <= room), None)
            if x is None:
                break
            held[x] = held.get(x, 0) + 1
            room -= x
        ends = min(held, key=lambda x: left[x] / held[x])
        times = left[ends] / held[ends]
        for x, k in held.items():
            basis[row[x], j] = k
            left[x] = max(left[x] - times * k, 0.0)
        del left[ends]
    return basis


def column_generation(lengths, demand, capacity: int):
    """Patterns (m x m) and how often to use each (real numbers) such that
    demand is met exactly with about the fewest sequences."""
    import numpy as np

    lengths, m = np.asarray(lengths), len(lengths)
    # a little more demand, different for each class, keeps the simplex from stalling on ties
    target = np.asarray(demand, dtype=float) + 1e-6 * (1 + (np.arange(m) * 0.618033988749895) % 1)
    basis = first_basis(lengths, target, capacity)
    inverse = np.linalg.inv(basis)
    used = np.maximum(inverse @ target, 0)
    pool = np.zeros((m, 0))
    for _ in range(MAX_PIVOTS):
        prices = inverse.sum(axis=0)
        gain = prices @ pool - 1 if pool.shape[1] else np.array([0.0])
        if gain.max() <= 1e-7:
            pool, values = best_patterns(prices, lengths, capacity)
            # lower bounds of the linear program: by its prices, and by volume
            least = max(used.sum() / values.max(), lengths @ target / capacity)
            if used.sum() <= least * (1 + GAP):
                break
            gain = values - 1
        column = pool[:, int(gain.argmax())]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        used = np.maximum(inverse @ target, 0)
    return basis.astype(int), used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int, int]:
    """From {remainder length: documents}: a row per length (length, runs,
    first rank on the tape, its place there), the number of sequences by
    pattern, and the length of the tape.  A run is (first rank, end rank,
    first sequence, copies per sequence, offset of the first copy)."""
    import numpy as np

    lengths = sorted(histogram)
    runs: dict[int, list[tuple]] = {x: [] for x in lengths}
    dealt = dict.fromkeys(lengths, 0)
    sequences = 0
    if lengths:
        patterns, used = column_generation(lengths, [histogram[x] for x in lengths], capacity)
        for j in np.argsort(-used, kind="stable"):
            times = int(used[j] + 1e-4)
            held = [(lengths[i], int(patterns[i, j])) for i in np.flatnonzero(patterns[:, j])]
            total = sum(x * k for x, k in held)
            if held:
                times = min([times, *((histogram[x] - dealt[x]) // k for x, k in held)])
            if times <= 0 or total != capacity and total & (total - 1):
                continue  # padded sequences: their documents go to the tape
            offset = 0
            for x, k in held:
                runs[x].append((dealt[x], dealt[x] + times * k, sequences, k, offset))
                dealt[x] += times * k
                offset += x * k
            sequences += times
    rows, tape = [], 0
    for x in lengths:
        rows.append((x, runs[x], dealt[x], tape))
        tape += (histogram[x] - dealt[x]) * x
    return rows, sequences, tape


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         worker_units: int = WORKER_UNITS) -> DataFrame:
    """Every document's ids (the text's, then ``end_id``) packed into
    sequences of ``capacity`` ids; one row per piece.

    Columns: doc_id, start (ids of the document before the piece), length,
    ids (little-endian uint32 bytes), doc_tokens, sequence_id (dense from 0),
    offset, sequence_length.  Sequences are gapless and full: ``capacity``
    long, but for at most log2(capacity) last ones whose lengths are powers
    of two.  Null text counts as empty (one id); null doc_ids and repeated
    rows are documents of their own; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    ids = tokenised(docs, vocabulary, end_id, capacity, id_col, text_col, worker_units)
    counts = ids.groupBy("part", "rem").agg(F.count("*").alias("n_docs"), F.sum("full").alias("n_full"))
    counts = written(counts, "packing-counts")  # parts x capacity rows of a few bytes
    histogram = {r["rem"]: r["n"] for r in counts.filter("rem > 0").groupBy("rem").agg(F.sum("n_docs").alias("n")).collect()}  # < capacity rows
    n_parts, n_full = counts.agg(F.countDistinct("part"), F.coalesce(F.sum("n_full"), F.lit(0))).first()
    lengths, by_pattern, tape = plan(histogram, capacity)

    # ranks of equal remainders in earlier parts, as one map per part; full pieces of earlier parts
    earlier = counts.withColumn("r", F.coalesce(F.sum("n_docs").over(
        Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = earlier.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rem", "r"))).alias("ranks_before"), F.sum("n_full").alias("n_full"))
    earlier = earlier.withColumn("full_start", F.coalesce(F.sum("n_full").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_full")  # a row per part
    if n_parts * capacity * 12 <= BROADCAST_BYTES:
        earlier = F.broadcast(earlier)
    by_length = spark.createDataFrame(
        lengths or [(0, [], 0, 0)],
        "rem int, runs array<struct<lo:long,hi:long,sequence:long,copies:long,offset:long>>, tape_from long, tape_at long")

    d = ids.join(earlier, "part").join(F.broadcast(by_length), "rem", "left")  # fewer rows than capacity
    rank = F.col("rank_in_part") + F.col("ranks_before")[F.col("rem")]
    d = d.withColumn("rank", rank).withColumn("run", F.expr("get(filter(runs, r -> r.lo <= rank and rank < r.hi), 0)"))

    whole = tape // capacity * capacity
    borders, left = [whole], tape - whole  # where the sequences of the tape's end begin
    for bit in reversed(range(capacity.bit_length())):
        if left >> bit & 1:
            borders.append(borders[-1] + (1 << bit))
    ends = ", ".join(f"{b}L" for b in borders)
    first_tape, tape_full = n_full + by_pattern, whole // capacity
    d = d.withColumn("x", F.expr("tape_at + (rank - tape_from) * rem")).withColumn("cuts", F.expr(f"""
        array_sort(array_distinct(filter(
            concat(array(x, x + rem, if((x div {capacity} + 1) * {capacity} <= {whole}, (x div {capacity} + 1) * {capacity}, x)), array({ends})),
            c -> c >= x and c <= x + rem)))"""))
    pieces = F.expr(f"""concat(
        transform(if(full > 0, sequence(0L, full - 1), array()),
            j -> named_struct('start', j * {capacity}, 'length', {capacity}L, 'sequence_id', full_start + full_before + j,
                              'offset', 0L, 'sequence_length', {capacity}L)),
        if(rem = 0, array(), if(run is not null,
            array(named_struct('start', full * {capacity}, 'length', cast(rem as long),
                'sequence_id', {n_full} + run.sequence + (rank - run.lo) div run.copies,
                'offset', run.offset + (rank - run.lo) % run.copies * rem, 'sequence_length', -1L)),
            transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> if(c < {whole},
                named_struct('start', full * {capacity} + c - x, 'length', cuts[i + 1] - c,
                    'sequence_id', {first_tape} + c div {capacity}, 'offset', c % {capacity}, 'sequence_length', {capacity}L),
                named_struct('start', full * {capacity} + c - x, 'length', cuts[i + 1] - c,
                    'sequence_id', {first_tape + tape_full} + size(filter(array({ends}), b -> b <= c)) - 1,
                    'offset', c - array_max(filter(array({ends}), b -> b <= c)), 'sequence_length', 0L))))))""")
    d = d.select("doc_id", F.col("n").alias("doc_tokens"), "ids", F.explode(pieces).alias("p"))
    return d.select("doc_id", "p.start", "p.length", F.expr("substring(ids, cast(4 * p.start + 1 as int), cast(4 * p.length as int))").alias("ids"),
                    "doc_tokens", "p.sequence_id", "p.offset", "p.sequence_length")
