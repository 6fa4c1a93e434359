"""Readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtrust.operators.prepare import dense_index
from crowdtrust.sources.csv_scan import named_file, read_csv_by_header, read_quoted_csv

VOTES_SCHEMA = T.StructType([T.StructField("prompt_id", T.LongType()), T.StructField("annotator_id", T.LongType()),
                             T.StructField("vote", T.IntegerType())])
PROMPTS_SCHEMA = T.StructType([T.StructField("prompt_id", T.LongType()), T.StructField("text_a", T.StringType()),
                               T.StructField("text_b", T.StringType()), T.StructField("truth_is_a", T.IntegerType())])
PAIRS_SCHEMA = T.StructType([T.StructField("chosen", T.StringType()), T.StructField("rejected", T.StringType())])
WORKER_TRUTH_SCHEMA = T.StructType([T.StructField("annotator_id", T.LongType()),
                                    T.StructField("true_acc", T.DoubleType())])


# Limits of a spine over 0..max(id), see dense_ids.
SPARSE, SPARSE_FROM = 1_000, 100_000_000


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet", first: int | None = None,
               order_cols: list[str] | None = None) -> DataFrame:
    """IO1: raw (chosen, rejected) pairs of one split; ``first`` keeps the
    first so many rows in ``order_cols`` order (numbered across partitions,
    no single sorting task)."""
    r = spark.read.schema(PAIRS_SCHEMA) if fmt == "json" else spark.read
    df = r.format(fmt).load(path)
    if first is None:
        return df
    keys = order_cols or ["chosen", "rejected"]
    return dense_index(df, keys, "_i").filter(F.col("_i") < first).drop("_i")


def read_votes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO2: typed vote table (no schema inference)."""
    if fmt == "csv":
        return spark.read.schema(VOTES_SCHEMA).option("header", True).csv(path)
    return spark.read.format(fmt).load(path).select(
        F.col("prompt_id").cast("bigint"), F.col("annotator_id").cast("bigint"), F.col("vote").cast("int"))


def read_prompts_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO3: prompts whose text holds newlines and quotes; a file is read by
    as many tasks as it has byte ranges."""
    return read_quoted_csv(spark, path, PROMPTS_SCHEMA)


def read_worker_truth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """IO4: first existing path; ``true_accuracy`` is renamed ``true_acc``."""
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm_fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            df = spark.read.option("header", True).option("inferSchema", False).csv(p) if p.endswith(".csv") \
                else spark.read.parquet(p)
            if "true_accuracy" in df.columns:
                df = df.withColumnRenamed("true_accuracy", "true_acc")
            return df.select(F.col("annotator_id").cast("bigint"), F.col("true_acc").cast("double"))
    raise FileNotFoundError(f"none of {paths} exists")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """IO5–IO7, IO11, IO12: write a result table (parquet by default, CSV quoting all fields)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # RFC 4180 quoting (quotes doubled), so text with quotes and newlines round-trips (IO3)
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def append_frames(frames: DataFrame, path: str, run_id: str) -> None:
    """IO8: append per-iteration parameter frames partitioned by run and iteration."""
    (frames.withColumn("run_id", F.lit(run_id)).write.mode("append")
     .partitionBy("run_id", "iteration").parquet(path))


def scan_frames_natural(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """IO9: read a folder of per-iteration CSV frames; the frame number is
    the first number in the file name, ordered numerically.  Columns are taken
    by the names in each file's own header."""
    rows = read_csv_by_header(spark, os.path.join(path, pattern))
    # plain ``frame_<i>.csv`` files or Spark's folders of that name with part files
    rows = rows.withColumn("file_name", named_file(F.col("file"), ".csv"))
    value = lambda c: F.element_at("fields", c)
    return (rows.select(value("annotator_id").cast("bigint").alias("annotator_id"), value("inferred_acc").cast("double").alias("inferred_acc"),
                        F.regexp_extract("file_name", r"(\d+)", 1).cast("int").alias("frame"), "file_name")
            .orderBy("frame", "annotator_id"))


def scan_metric_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """IO10: glob-scan ``*_metrics.csv``; run name from the file name.  Each
    file's columns go by its own header; files without a column ``epoch`` are
    left out, as are rows without an epoch; other missing columns are null."""
    rows = read_csv_by_header(spark, path_glob).filter(F.map_contains_key("fields", "epoch"))
    # a plain file ``<run>_metrics.csv`` or Spark's folder of that name with part files
    run = F.regexp_replace(named_file(F.col("file"), "_metrics.csv"), r"_metrics\.csv$", "")
    value = lambda c, t: F.element_at("fields", c).cast(t).alias(c)
    return rows.select(run.alias("run"), value("epoch", "int"), value("train_loss", "double"),
                       value("test_accuracy", "double")).filter(F.col("epoch").isNotNull())


def dense_ids(df: DataFrame, id_col: str, defaults: dict, max_id: int | None = None) -> DataFrame:
    """IO13: spine ``0..max(id)`` left-joined to ``df``; missing ids get
    ``defaults``.  Ids are taken to be numbers of an array: a spine of over
    ``SPARSE`` times as many rows as there are ids (and of ``SPARSE_FROM`` or
    more) is refused unless the caller names ``max_id``."""
    spark = df.sparkSession
    if max_id is None:
        max_id, n = df.agg(F.max(id_col), F.count(id_col)).first()
        if max_id is not None and max_id >= max(SPARSE_FROM, SPARSE * n):
            raise ValueError(f"{n} ids up to {max_id}: a row for each number below would be almost all empty; give max_id if that is meant")
    spine = spark.range(0, 0 if max_id is None else max_id + 1).withColumnRenamed("id", id_col)
    out = spine.join(df, id_col, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
