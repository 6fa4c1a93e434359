"""Exact top-k search by distributed histogram selection.

Queries go in groups of ``GROUP`` (a broadcast of fixed size); for each group:

1. Every candidate is scored against every query of the group, a block of rows
   at a time.  A query's scores lie between bounds known from the norms; that
   interval is cut into ``BINS`` bins and scores are counted.  Counts of all
   partitions are added up, and the bin that holds the k-th highest score
   becomes the next interval, until it is one score wide: the k-th value.
2. A last pass keeps scores above it, and of those equal to it the smallest
   ids, as many as are missing.

A partition sends only the bins down to where its own scores already make up
what is sought, since the k-th value cannot lie below.  So what is shuffled is
about k rows per query and partition, however many candidates tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import dimension, matrix, top_per_query, usable

#: Queries of one group and bins per refinement.
GROUP, BINS = 4096, 512
#: Candidates scored at once.
BLOCK = 1024


def products(q, c, exact_float: bool):
    """All inner products as whole numbers (int64)."""
    import numpy as np

    if exact_float:  # every partial sum is below 2^53
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def quantised(values, scale: int):
    import numpy as np

    return np.floor(values * float(scale)).astype(np.int64)


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k highest
    inner products of the vectors floor(scale * x), fewer if there are fewer
    candidates; ties to the smaller vec_id.

    ``is_query``: condition on column vec_id.  Candidates are all vectors but
    the query's own.  Vectors that are null or have null or non-finite
    components, and rows without id, take no part; a repeated vec_id counts
    once (the least of its vectors); shorter vectors are as if filled up with
    zeros; an empty table gives no rows; other columns are not read.  Products
    must stay below 2^61.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows, _ = usable(vectors, id_col, vector_col, "topk-vectors")
    dim = dimension(rows)
    largest = rows.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()[0] or 0.0
    exact_float = dim * (largest * scale + 1) ** 2 < 2.0 ** 53
    norm = rows.agg(F.max(F.expr(f"aggregate(v, 0d, (s, x) -> s + pow(abs({scale} * x) + 1, 2))"))).first()[0] or 0.0
    queries = rows.filter(is_query)
    out = None
    for lo, hi in _id_ranges(queries.select("vec_id"), GROUP):
        group = queries.filter(F.col("vec_id").between(lo, hi)).orderBy("vec_id").toArrow()  # GROUP rows at most
        ids = group.column("vec_id").to_numpy()
        q = quantised(matrix(group.column("v").combine_chunks(), dim), scale)
        found = _search_group(spark, rows.select("vec_id", "v"), ids, q, k, scale, dim, exact_float, float(norm))
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return top_per_query(out, k)


def _id_ranges(ids: DataFrame, size: int) -> list[tuple[int, int]]:
    """Ranges of ids with at most ``size`` of the (distinct) ids each."""
    found = []
    at = None
    while True:
        rest = ids if at is None else ids.filter(F.col("vec_id") > at)
        first = rest.orderBy("vec_id").limit(size).agg(F.min("vec_id"), F.max("vec_id")).first()
        if first[0] is None:
            return found
        found.append((first[0], first[1]))
        at = first[1]


def _search_group(spark, rows, ids, q, k, scale, dim, exact_float, norm):
    import numpy as np

    n = len(ids)
    bound = np.ceil(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt(norm)).astype(np.int64) + 1
    low, width = -bound, 2 * bound + 1  # the interval that holds the sought value
    need = np.full(n, k, dtype=np.int64)  # its rank within the interval
    few = np.zeros(n, dtype=bool)  # fewer candidates than k: all of them are wanted

    while (width > 1).any():
        step = -(-width // BINS)
        state = spark.sparkContext.broadcast((ids, q, low, width, step, need))

        def count(batches, state=state):
            import pyarrow as pa

            ids, q, low, width, step, need = state.value
            total = np.zeros((len(ids), BINS), dtype=np.int64)
            seen = False
            for batch in batches:
                own, c = batch.column("vec_id").to_numpy(), quantised(matrix(batch.column("v"), dim), scale)
                for at in range(0, len(own), BLOCK):
                    seen = True
                    s = products(q, c[at: at + BLOCK], exact_float) - low[:, None]
                    inside = (s >= 0) & (s < width[:, None]) & (own[at: at + BLOCK][None, :] != ids[:, None])
                    i, j = np.nonzero(inside)
                    total += np.bincount(i * BINS + s[i, j] // step[i], minlength=total.size).reshape(total.shape)
            if not seen:
                return
            above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total  # in higher bins
            i, b = np.nonzero((total > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(total[i, b])], names=["i", "b", "n"])

        bins = rows.mapInArrow(count, "i long, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("i").orderBy(F.col("b").desc())
        sought = spark.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "i long, need long")  # a row per query of the group
        held = (bins.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(sought), "i")
                .filter("upto >= need and upto - n < need").toArrow())
        i, b, c, upto = (held.column(x).to_numpy() for x in ("i", "b", "n", "upto"))
        there = np.zeros(n, dtype=bool)
        there[i] = True
        few |= ~there
        need[i] -= upto - c
        low[i] += b * step[i]
        width = np.where(there, np.minimum(step, width), 1)
        low = np.where(few, -bound, low)
        width = np.where(few, 1, width)

    # low is the k-th value (few: below all scores); need: how many with that value
    state = spark.sparkContext.broadcast((ids, q, np.where(few, -bound - 1, low), np.where(few, 0, need)))

    def keep(batches):
        import pyarrow as pa

        ids, q, kth, need = state.value
        ties: list = [[] for _ in ids]
        for batch in batches:
            own, c = batch.column("vec_id").to_numpy(), quantised(matrix(batch.column("v"), dim), scale)
            for at in range(0, len(own), BLOCK):
                o = own[at: at + BLOCK]
                s = products(q, c[at: at + BLOCK], exact_float)
                other = o[None, :] != ids[:, None]
                i, j = np.nonzero((s > kth[:, None]) & other)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(o[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])
                tie = (s == kth[:, None]) & other
                for i in np.flatnonzero(tie.any(axis=1)):
                    ties[i] = sorted(ties[i] + o[tie[i]].tolist())[: need[i]]
        rows = [(int(ids[i]), v, int(kth[i])) for i, t in enumerate(ties) for v in t]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(keep, "query_id long, vec_id long, score long")
