"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected to ``DIMS`` random directions, shifted, and placed
on a Hilbert curve, for ``CURVES`` independent projections and shifts.  Along
each curve the keys are sorted by range partition.  A query's candidates are
the vectors of its own and the neighbouring windows of each curve; they are
scored by the original vectors in double precision, and the best of all
curves are merged and ranked.

Largest inner products become least distances by one more component: with R
the longest vector's length, x is placed as (x, sqrt(R^2 - |x|^2)) / R and a
query as (q, 0) / |q|.  A few long vectors would crowd all others together
there, so vectors are split into bands of similar length, each with an R, a
grid and curves of its own.  Every band is searched.

How many curves are searched, and how wide a window, is measured: for
``SAMPLE`` queries chosen by hash the true neighbours are found by one pass
over all vectors, and their places along the curves tell what each number of
curves needs to hold ``RECALL`` of them; the number that costs least is taken.  Where vectors
lie in clusters a few narrow windows do; without structure the neighbours found
depend on the share of vectors that is looked at, and windows grow with the
table.  They are handled in blocks of at most ``BLOCK`` vectors, so memory does
not.  Vectors that are equal have equal keys and are told apart by id, so many
copies fill many blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, written, written_at
from .vectors import dimension, matrix, top_per_query, usable

CURVES, DIMS, KEY_BITS = 24, 10, 6
#: Queries whose true neighbours are looked up, and the share of them that the windows shall hold.
SAMPLE, RECALL = 96, 0.95
#: Numbers of curves to choose from.
CHOICES = (4, 8, 16, 24)
#: One more curve costs as much as scoring this share of all pairs.
CURVE_COST = 0.001
#: Least window to either side; blocks hold at least and at most so many vectors, a window up to ``REACH`` of less than the most.
MIN_WINDOW, MIN_BLOCK, BLOCK, REACH = 64, 64, 16384, 2
#: Lengths are counted in steps of 2^(1 / (2 x LENGTH_STEPS)); a band spans so many steps.
LENGTH_STEPS, BAND_STEPS = 8, 5
#: Pairs scored at once.
PAIRS = 500_000
SEED = 20


def hilbert_keys(cells, bits: int):
    """Place of each grid cell (n x d whole numbers below 2^bits) on the
    Hilbert curve: Gray code of the coordinates' bits, each level turned and
    reflected by the levels above."""
    import numpy as np

    x = cells.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap if i else 0
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in reversed(range(bits)):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def curves(dim: int):
    """(projections CURVES x dim x DIMS, shifts CURVES x DIMS), fixed by SEED.
    Curves take turns at the directions of random orthogonal bases, so that
    those of one basis see different parts of a vector."""
    import numpy as np

    r = np.random.default_rng(SEED)
    each = max(1, dim // DIMS)  # curves of one basis
    out = []
    while len(out) < CURVES:
        basis = np.linalg.qr(r.normal(size=(max(dim, DIMS), max(dim, DIMS))))[0][:dim]
        out += [basis[:, c * DIMS: (c + 1) * DIMS] for c in range(each)]
    return np.stack(out[:CURVES]), r.random((CURVES, DIMS))


def layout(window: int) -> tuple[int, int]:
    """(vectors of a block, neighbouring blocks to either side).  A query sees
    ``window`` vectors to either side on average over its places in its block."""
    reach = max(-(-window // BLOCK), min(REACH, max(1, window // MIN_BLOCK)))
    return -(-2 * window // (2 * reach + 1)), reach


def choose(nearness) -> tuple[int, float]:
    """Number of curves that costs least, and the share of a band's vectors
    that a window to either side must hold, from the distances of true
    neighbours along each curve (neighbours x CURVES, as such shares).  The
    size of the table does not count."""
    import numpy as np

    found = []
    for c in sorted({min(c, CURVES) for c in CHOICES}):
        share = float(np.quantile(nearness[:, :c].min(axis=1), RECALL, method="higher")) if len(nearness) else 0.0
        found.append((c * (2 * share + CURVE_COST), c, share))
    return min(found)[1:]


def true_neighbours(rows: DataFrame, is_query, k: int, dim: int):
    """(query ids, vec_ids, scores) of the nearest of ``SAMPLE`` queries, by one pass over all vectors."""
    import numpy as np

    spark = rows.sparkSession
    some = rows.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
    if not some.num_rows:
        return (np.array([], dtype=np.int64),) * 2 + (np.array([]),)
    state = spark.sparkContext.broadcast((some.column("vec_id").to_numpy(), matrix(some.column("v").combine_chunks(), dim)))

    def nearest(batches):
        import pyarrow as pa

        ids, q = state.value
        held = (np.array([], dtype=np.int64),) * 2 + (np.array([]),)
        for batch in batches:
            own, v = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dim)
            for at in range(0, len(own), 4096):
                held = tuple(np.concatenate(x) for x in zip(held, best(ids, q, own[at: at + 4096], v[at: at + 4096], k), strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(x[order] for x in held)
                keep = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = tuple(x[keep] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query_id", "vec_id", "score"])

    found = top_per_query(rows.select("vec_id", "v").mapInArrow(nearest, "query_id long, vec_id long, score double"), k).toArrow()  # SAMPLE x k rows at most
    state.destroy()
    return tuple(found.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))


def bands(steps: list[tuple[int, int, float, float]]) -> list[tuple[float, float]]:
    """(least, greatest) squared length of each band, the longest vectors
    first, from (step, vectors, least, greatest) of each step of length.  A
    band reaches over ``BAND_STEPS`` steps, further while a window holds it
    whole, and takes in all that are shorter once these are no more than it
    has: short vectors do not crowd it."""
    steps = sorted(steps, reverse=True)
    below = sum(n for _, n, _, _ in steps)
    out: list[list[float]] = []
    top = held = 0
    for step, n, least, greatest in steps:
        if not out or not (top - step < BAND_STEPS or held + n <= MIN_WINDOW or below <= held):
            out.append([least, greatest])
            top, held = step, 0
        out[-1][0] = least
        held += n
        below -= n
    return [(a, b) for a, b in out]


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product of the original
    vectors): the k nearest found for each query, nearest first, ties to the
    smaller vec_id; all candidates if there are fewer than k.

    ``is_query``: condition on column vec_id.  Candidates are all vectors but
    the query's own.  Vectors that are null, zero or have null or non-finite
    components, and rows without id, take no part; a repeated vec_id counts
    once (the least of its vectors); shorter vectors are as if filled up with
    zeros; an empty table gives no rows; other columns are not read.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows, rows_path = usable(vectors, id_col, vector_col, "ann-vectors")
    rows = rows.filter(F.exists("v", lambda x: x != 0))
    dim = dimension(rows)
    square = F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")
    lengths = rows.select(square.alias("s")).groupBy(F.floor(F.log2(F.greatest("s", F.lit(1e-300))) * LENGTH_STEPS).alias("step")).agg(F.count("*"), F.min("s"), F.max("s")).collect()  # a row per step
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parted = bands([tuple(r) for r in lengths])
    longest = [max(float(np.sqrt(b)), 1e-150) for _, b in parted]
    # the first band whose least length is not above the vector's
    band = F.coalesce(*[F.when(F.col("s") >= a, F.lit(i)) for i, (a, _) in enumerate(parted[:-1])], F.lit(len(parted) - 1))
    banded = rows.withColumn("s", square).withColumn("band", band.cast("int")).drop("s")
    projections, shifts = curves(dim + 1)

    def placed(v, r):
        """Projections of candidates in a band with longest length r, or of queries (r is None)."""
        length = np.sqrt((v ** 2).sum(axis=1))
        if r is None:
            y = np.concatenate([v / length[:, None], np.zeros((len(v), 1))], axis=1)
        else:
            y = np.concatenate([v, np.sqrt(np.maximum(r ** 2 - length ** 2, 0))[:, None]], axis=1) / r
        return np.einsum("nd,cdk->cnk", y, projections, optimize=True)

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((len(longest), 3, CURVES, DIMS))
        for batch in batches:
            of, v = batch.column("band").to_numpy(), matrix(batch.column("v"), dim)
            for b in np.unique(of):
                y = placed(v[of == b], longest[b])
                total[b] += np.stack([np.full((CURVES, DIMS), y.shape[1]), y.sum(axis=1), (y ** 2).sum(axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "t"])

    total = np.zeros(len(longest) * 3 * CURVES * DIMS)
    for r in banded.select("band", "v").mapInArrow(moments, "i long, t double").groupBy("i").agg(F.sum("t").alias("t")).collect():  # bands x 3 x CURVES x DIMS rows
        total[r["i"]] = r["t"]
    count, first, second = total.reshape(len(longest), 3, CURVES, DIMS).swapaxes(0, 1)
    mean = first / count
    spread = np.sqrt(np.maximum(second / count - mean ** 2, 1e-18))
    sizes = [int(c) for c in count[:, 0, 0]]  # vectors of each band

    def keys(as_query):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                all_ids, of, vs = batch.column("vec_id").to_numpy(), batch.column("band").to_numpy(), matrix(batch.column("v"), dim)
                for b in range(len(longest)):
                    own = slice(None) if as_query else of == b
                    ids, v = all_ids[own], vs[own]
                    for at in range(0, len(ids), BLOCK):
                        y = (placed(v[at: at + BLOCK], None if as_query else longest[b]) - mean[b][:, None]) / spread[b][:, None]
                        unit = 1 / (1 + np.exp(np.clip(-1.702 * y, -40, 40)))  # about the normal distribution's, so that cells are filled alike
                        unit = unit / 2 + shifts[:, None] / 2  # the shift moves the grid by up to half the curve's range
                        cells = np.minimum((unit * (1 << KEY_BITS)).astype(np.int64), (1 << KEY_BITS) - 1)
                        key = hilbert_keys(cells.reshape(-1, DIMS), KEY_BITS)
                        m = y.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(np.arange(b * CURVES, (b + 1) * CURVES, dtype=np.int32), m)), pa.array(key), pa.array(np.tile(ids[at: at + BLOCK], CURVES)),
                             pa.array(np.full(m * CURVES, as_query))], names=["curve", "key", "vec_id", "query"])
        return run

    schema = "curve int, key long, vec_id long, query boolean"
    # curves of all bands are numbered through
    both = banded.mapInArrow(keys(False), schema).union(banded.filter(is_query).mapInArrow(keys(True), schema))
    order = ["curve", "key", "vec_id", "query"]

    def number(batches):
        """Candidates before each row, within the partition."""
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = ~batch.column("query").to_numpy(zero_copy_only=False)
            at = before + np.cumsum(own) - own
            before += int(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, dtype=np.int32)), *(batch.column(c) for c in ("curve", "vec_id", "query")), pa.array(at)],
                                             names=["part", "curve", "vec_id", "query", "at"])

    both, keys_path = written_at(both, "ann-keys")
    places, places_path = written_at(both.repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(number, "part int, curve int, vec_id long, query boolean, at long"), "ann-places")
    delete_path(spark, keys_path)
    start, starts = 0, []
    for r in places.filter("not query").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per partition
        starts.append((r["part"], start))
        start += r["n"]
    held = {p for p, _ in starts}
    for r in places.select("part").distinct().orderBy("part").collect():
        if r["part"] not in held:  # queries alone
            starts.append((r["part"], max((s for p, s in starts if p < r["part"]), default=0)))
    offsets = spark.createDataFrame(starts, "part int, start long")
    # every curve of a band has all its vectors, so the place within the curve is what is over those of the curves before
    before = np.cumsum([0, *np.repeat(sizes, CURVES)]).tolist()
    per_curve = spark.createDataFrame([(c, c // CURVES, before[c]) for c in range(len(before) - 1)], "curve int, band int, before long")
    places = places.join(F.broadcast(offsets), "part").join(F.broadcast(per_curve), "curve")
    places = places.select("curve", "band", "vec_id", "query", F.expr("at + start - before").alias("place"))

    # distances along the curves between the sample's queries and their true neighbours
    q_ids, ids, scores = true_neighbours(rows, is_query, k, dim)
    twice = np.zeros(len(ids), dtype=bool)  # equal scores: copies, of which any is as near
    if len(ids):
        order = np.lexsort((scores, q_ids))
        same = (np.diff(q_ids[order]) == 0) & (np.diff(scores[order]) == 0)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
    q_ids, ids = q_ids[~twice], ids[~twice]
    asked = [(int(x), True) for x in np.unique(q_ids)] + [(int(x), False) for x in np.unique(ids)]  # SAMPLE x (k + 1) rows at most
    at = places.join(F.broadcast(spark.createDataFrame(asked, "vec_id long, query boolean")), ["vec_id", "query"]).toArrow()
    at = dict(zip(zip(*(at.column(c).to_pylist() for c in ("vec_id", "query", "curve")), strict=True), at.column("place").to_pylist(), strict=True))
    band_of = {v: c // CURVES for v, is_q, c in at if not is_q}
    nearness = np.array([[abs(at[q, True, c] - at[v, False, c]) / sizes[band_of[v]] for c in range(band_of[v] * CURVES, (band_of[v] + 1) * CURVES)]
                         for q, v in zip(q_ids.tolist(), ids.tolist(), strict=True)]).reshape(-1, CURVES)
    searched, share = choose(nearness)
    per_band = []
    for b, n in enumerate(sizes):
        size, reach = layout(max(MIN_WINDOW, int(np.ceil(share * n)) + 1))
        per_band.append((b, size, reach, (sizes[b] - 1) // size))
    places = places.filter(F.col("curve") % CURVES < searched).join(F.broadcast(spark.createDataFrame(per_band, "band int, size int, reach int, last int")), "band")
    places = places.withColumn("block", F.least(F.expr("cast(place div size as int)"), F.col("last")))
    to = F.explode(F.when(F.col("query"), F.sequence(F.col("block") - F.col("reach"), F.col("block") + F.col("reach"))).otherwise(F.array("block")))
    dealt = places.select("curve", "vec_id", "query", "last", to.alias("block")).filter("block between 0 and last").drop("last")
    dealt = dealt.join(rows, "vec_id").repartition("curve", "block").sortWithinPartitions("curve", "block", "query")

    def score(batches):
        """Candidates of a block come first, then its queries in batches."""
        import pyarrow as pa

        key, ids, parts = None, [], []
        for batch in batches:
            curve, blk = batch.column("curve").to_numpy(), batch.column("block").to_numpy()
            is_q = batch.column("query").to_numpy(zero_copy_only=False)
            own, v = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dim)
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(blk) != 0) | (np.diff(is_q.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if a == b:
                    continue
                if (curve[a], blk[a]) != key:
                    key, ids, parts = (curve[a], blk[a]), [], []
                if not is_q[a]:
                    ids.append(own[a:b])
                    parts.append(v[a:b])
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                c_ids, c = ids[0], parts[0]
                some = max(1, PAIRS // len(c_ids))
                for lo in range(a, b, some):
                    hi = min(lo + some, b)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(own[lo:hi], v[lo:hi], c_ids, c, k)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(score, "query_id long, vec_id long, score double")
    merged = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = written(top_per_query(merged, k), "ann-found")  # k rows per query
    delete_path(spark, places_path)
    delete_path(spark, rows_path)
    return out


def best(q_ids, q, c_ids, c, k: int):
    """(query ids, ids, scores): each query's k highest scores among the
    candidates but itself, ties to smaller ids.  A matrix product finds those
    that may be among them, up to its rounding; they are scored exactly."""
    import numpy as np

    s = q @ c.T
    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    if s.shape[1] > k:
        slack = 1e-12 * np.sqrt((q ** 2).sum(axis=1)) * np.sqrt((c ** 2).sum(axis=1).max())
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
    else:
        kth = np.full(len(s), -np.inf)
    i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
    exact = exactly(q[i], c[j])
    order = np.lexsort((c_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, np.arange(len(s)))
    keep = np.arange(len(i)) - first[i] < k
    return q_ids[i[keep]], c_ids[j[keep]], exact[keep]


def exactly(a, b):
    """Row-wise inner products; the order of summation is the same for every
    pair, wherever it is computed."""
    import numpy as np

    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total
