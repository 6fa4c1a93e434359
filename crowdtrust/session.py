"""Session helpers: building a session for tests/bench and locating the
shared checkpoint folder that iterative jobs write their state to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "crowdtrust", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench.  On a cluster the caller's own
    session is used instead; nothing in the library depends on these knobs."""
    master = master or os.environ.get("CROWDTRUST_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The session's setting wins.  Only when it is unset *and* Spark runs in
    local mode (tests) do we create a private folder; on a cluster an unset
    checkpoint dir is a configuration error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            root = os.path.dirname(current.rstrip("/"))
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...)")
        root = tempfile.mkdtemp(prefix="crowdtrust-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/crowdtrust/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the checkpoint root."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unique_table_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, keys=()) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint root and reread: what
    a checkpoint does, but columns that are not asked for are not read.  With
    ``keys`` it lies in buckets by these, and a join by them exchanges the other
    side alone."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not keys:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), unique_table_name(f"ct_{name}")
    df.repartition(n, *keys).write.option("path", path).bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)
