"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtrust.session import scratch_path


def per_process(key, build: Callable):
    """``build()`` once per Python worker process; later calls with the same
    (hashable) key return the same object."""
    store = sys.modules.setdefault("_crowdtrust_llm_kept", types.ModuleType("_crowdtrust_llm_kept")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a zstd Parquet table below the shared checkpoint
    folder and reread: cuts the lineage and survives the loss of executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`written`, with the table's folder for :func:`delete_path`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote below the checkpoint folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that no column in ``taken`` has (case-insensitively)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


#: Most bytes of rows in an Arrow batch between the JVM and Python (a larger row is a batch of its own).
ARROW_BYTES = 6 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to ``ARROW_BYTES``: by
    default a batch of long texts takes 64 MB, several times over, in each
    task.  Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key, "67108864") if c.isdigit()))
    if now > ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long, may be null) and the text (null becomes empty), in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mix64(x):
    """Finaliser of a 64-bit hash (numpy uint64 array in, array out)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
