"""What the two vector searches share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written_at


def usable(vectors: DataFrame, id_col: str, vector_col: str, name: str) -> tuple[DataFrame, str]:
    """Written table (vec_id, v: array<double>), and its folder, of the vectors that take part:
    id and vector non-null, no null, infinite or NaN component.  A repeated
    vec_id counts once, with the least of its vectors."""
    small_batches(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return written_at(rows.groupBy("vec_id").agg(F.min("v").alias("v")), name)


def matrix(column, dim: int):
    """An Arrow list column as rows of ``dim`` doubles; shorter vectors end in zeros."""
    import numpy as np

    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat[offsets[0]: offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    for i, (a, n) in enumerate(zip(offsets, sizes, strict=False)):
        out[i, :n] = flat[a: a + n]
    return out


def dimension(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


def top_per_query(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query (ties to the
    smaller vec_id) from a bounded number of rows per query."""
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
