"""Preparation operators: orientation, seeded sampling, dense ids, oracle
votes, vote validation and winner/loser orientation (SURVEY §2.2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtrust.functions.columns import hash32
from crowdtrust.session import scratch_path

ORACLE_ANNOTATOR = 999  # fixed value: the dummy annotator id of oracle votes


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Append a 0-based sequential index in ``order_cols`` order.

    Distributed zipWithIndex: the rows are range-partitioned, sorted inside
    their partition and written once to the shared folder together with their
    partition and place in it.  Rows per partition are counted on that written
    table and become offsets (one row per partition).  Counting and numbering
    read the same rows, so no second range partitioning with other bounds can
    come between them.  No global single-task window.  Pass the columns that
    are needed alone: a heavy payload is better joined back by its key.
    ``order_cols`` must identify rows uniquely for the index to be
    deterministic; ids are 0..n-1 in any case.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_row", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)).drop("_mid")
    path = scratch_path(spark, "dense_index")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    # one row per partition: the offset table is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_row")).cast("bigint")).drop("_pid", "_row", "_off")


def orientation_bit(prompt_id: Column | str, seed: int = 42) -> Column:
    c = F.col(prompt_id) if isinstance(prompt_id, str) else prompt_id
    return F.pmod(hash32(F.concat(F.lit(f"{seed}|orient|"), c.cast("string"))), F.lit(2)).cast("int")


def orient_pairs(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Reproducible random A/B orientation of (chosen, rejected) pairs."""
    bit = orientation_bit("prompt_id", seed)
    return pairs.select(
        "prompt_id",
        F.when(bit == 1, F.col("chosen")).otherwise(F.col("rejected")).alias("text_a"),
        F.when(bit == 1, F.col("rejected")).otherwise(F.col("chosen")).alias("text_b"),
        bit.alias("truth_is_a"))


def seeded_sample(df: DataFrame, key: str, cap: int | None, seed: int = 42) -> DataFrame:
    """Seeded shuffle and cap ``min(cap, n)`` of a split.  The cap is the
    feature here (a first-N slice of a shuffled split); with ``cap=None``
    the whole split is returned.  Rows come in the order of the seeded hash.

    The cap is found by selection, not by a sort that ends in one task: a
    histogram of the 32-bit hash is refined three times, to the hash value
    that holds the cap-th row; rows below it are in.  Of those with that very
    value the smallest keys go first, of equal keys any rows."""
    h = hash32(F.concat(F.lit(f"{seed}|shuffle|"), F.col(key).cast("string")))
    rows = df.withColumn("_h", h)
    if cap is not None:
        rows = _lowest(rows, key, cap)
    return rows.orderBy("_h", key).drop("_h")


def _lowest(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """The ``cap`` rows with the lowest (``_h``, key); ``_h`` has 32 bits."""
    if cap <= 0:
        return rows.limit(0)
    low, need = 0, cap  # the sought row is the need-th of those with _h >= low
    for bits in (20, 8, 0):
        size = 1 << {20: 32, 8: 20, 0: 8}[bits]  # of the interval that holds it
        inside = (F.col("_h") >= low) & (F.col("_h") < low + size)
        bins = rows.filter(inside).groupBy(F.shiftright(F.col("_h") - low, bits).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        upto = 0
        for b, n in sorted(map(tuple, bins.collect())):  # 4,096 rows at most
            if upto + n >= need:
                low, need = low + (b << bits), need - upto
                break
            upto += n
        else:
            return rows  # fewer than cap
    ties = rows.filter(F.col("_h") == low)
    # keys that share a hash: one in 2^32 of all
    keys = ties.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()
    whole, part = [], None
    for r in sorted(keys, key=lambda r: (r[0] is not None, r[0])):
        if need >= r["n"]:
            whole.append(r[0])
        elif need > 0:
            part = (r[0], need)
        need -= min(need, r["n"])
    has = lambda k: F.col(key).isNull() if k is None else F.col(key) == F.lit(k)
    out = rows.filter((F.col("_h") < low) | ((F.col("_h") == low) & reduce(Column.__or__, map(has, whole), F.lit(False))))
    if part is None:
        return out
    # rows of the one key of which only some fit are numbered across partitions
    some = dense_index(ties.filter(has(part[0])).withColumn("_any", F.monotonically_increasing_id()), ["_any"], "_i")
    return out.unionByName(some.filter(F.col("_i") < part[1]).drop("_any", "_i"))


def sequential_prompt_ids(df: DataFrame, order_cols: list[str], name: str = "prompt_id") -> DataFrame:
    """Dense 0-based prompt ids in the given order."""
    return dense_index(df, order_cols, name)


def regular_graph_trim(prompts: DataFrame, workers_per_task: int, n_annotators: int,
                       id_col: str = "prompt_id") -> tuple[DataFrame, int, int]:
    """Keep the first ``tasks`` prompts so that tasks*L == N*R exactly.

    R = T*L // N and tasks = N*R // L (the reference's regular-graph
    arithmetic).  Returns (trimmed prompts, R, tasks).
    """
    total = prompts.count()
    r = (total * workers_per_task) // n_annotators
    tasks = (n_annotators * r) // workers_per_task
    kept = dense_index(prompts.select(id_col), [id_col], "_i").filter(F.col("_i") < tasks).select(id_col)
    return prompts.join(kept, id_col, "left_semi"), r, tasks


def oracle_votes(prompts: DataFrame) -> DataFrame:
    """P5: one vote per prompt by the dummy oracle annotator, vote = truth."""
    return prompts.select("prompt_id", F.lit(ORACLE_ANNOTATOR).cast("bigint").alias("annotator_id"),
                          F.col("truth_is_a").cast("int").alias("vote"))


def validate_votes(votes: DataFrame) -> DataFrame:
    """Typed votes, 1 = A preferred, 0 = B; other values are dropped."""
    return (votes.select(F.col("prompt_id").cast("bigint"), F.col("annotator_id").cast("bigint"),
                         F.col("vote").cast("int"))
            .filter(F.col("vote").isin(0, 1)))


def vote_correctness(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """Votes joined with the hidden truth and a ``correct`` flag."""
    return votes.join(truth, "prompt_id").withColumn(
        "correct", (F.col("vote") == F.col("truth_is_a")).cast("int"))


def winner_loser(df: DataFrame, vote_col: str = "vote") -> DataFrame:
    """Swap A/B log-probs when the vote prefers B."""
    v = F.col(vote_col) == 1
    return df.withColumns({
        "pi_w": F.when(v, F.col("pi_a")).otherwise(F.col("pi_b")),
        "pi_l": F.when(v, F.col("pi_b")).otherwise(F.col("pi_a")),
        "ref_w": F.when(v, F.col("ref_a")).otherwise(F.col("ref_b")),
        "ref_l": F.when(v, F.col("ref_b")).otherwise(F.col("ref_a")),
    })


def hard_label(c: Column | str, threshold: float = 0.5) -> Column:
    """P10: strict ``> 0.5``; a tie predicts B (0)."""
    c = F.col(c) if isinstance(c, str) else c
    return (c > F.lit(threshold)).cast("int")
