"""Fixture tables derived from the driver's testdata parquet files.

The reference simulates its crowd with an unseeded RNG; here every random
draw is a hash of row keys, so Spark and the DuckDB oracle build the very
same rows (see FIXTURES.md, part B).  All builders are lazy DataFrame plans
over the given tables: they scale with them and never collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtrust.functions.columns import hash32, unit_hash
from crowdtrust.operators.prepare import dense_index

# Simulated worker accuracy by (id % 10) band, shared with the
# SQL oracle: ids ending 0-1 expert 0.95, 2-6 average 0.75, 7-8 spammer 0.50,
# 9 adversary 0.10.
EXPERT_ACC, AVERAGE_ACC, SPAMMER_ACC, ADVERSARY_ACC = 0.95, 0.75, 0.50, 0.10

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def band_accuracy(annotator_id) -> "F.Column":
    """True accuracy of a simulated worker from its id band."""
    m = F.pmod(F.col(annotator_id) if isinstance(annotator_id, str) else annotator_id, F.lit(10))
    return (F.when(m <= 1, F.lit(EXPERT_ACC))
            .when(m <= 6, F.lit(AVERAGE_ACC))
            .when(m <= 8, F.lit(SPAMMER_ACC))
            .otherwise(F.lit(ADVERSARY_ACC)))


def truth_bit(prompt_id) -> "F.Column":
    c = F.col(prompt_id) if isinstance(prompt_id, str) else prompt_id
    return F.pmod(hash32(F.concat(F.lit("truth|"), c.cast("string"))), F.lit(2)).cast("int")


# ---------------------------------------------------------------- B1 votes
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote per lineitem row: task = order, annotator = supplier."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    truth = truth_bit("l_orderkey")
    u = unit_hash(F.concat_ws("|", F.col("l_orderkey").cast("string"),
                              F.col("l_linenumber").cast("string"),
                              F.col("l_suppkey").cast("string")))
    vote = F.when(u < band_accuracy("l_suppkey"), truth).otherwise(1 - truth)
    return li.select(F.col("l_orderkey").cast("bigint").alias("prompt_id"),
                     F.col("l_suppkey").cast("bigint").alias("annotator_id"),
                     vote.cast("int").alias("vote"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden label per prompt (one row per order, with or without votes)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return o.select(F.col("o_orderkey").cast("bigint").alias("prompt_id"),
                    truth_bit("o_orderkey").alias("truth_is_a"))


def worker_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.select(F.col("s_suppkey").cast("bigint").alias("annotator_id"),
                    band_accuracy("s_suppkey").cast("double").alias("true_acc"))


# ---------------------------------------------------------------- B2 pairs
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs: high-quality documents (chosen) against low-quality
    ones (rejected) of the same language.

    Both sides are ranked inside their language by (hash, id).  With n chosen
    and m rejected documents there are max(n, m) pairs, number i being chosen
    i mod n with rejected i mod m, so every labelled document of a language
    that has both kinds occurs at least once and the output is linear.  Only
    ids are ranked and numbered; the texts are joined last.
    """
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents")
    lab = docs.select("doc_id", "lang").join(labels, "doc_id").withColumn("h", hash32(F.col("doc_id").cast("string")))

    def ranked(quality: int, name: str) -> tuple[DataFrame, DataFrame]:
        own = lab.filter(F.col("quality") == quality).select("lang", "h", F.col("doc_id").alias(name))
        own = dense_index(own, ["lang", "h", name], "g")
        first = own.groupBy("lang").agg(F.min("g").alias("g0"), F.count("*").alias(f"n_{name}"))  # a row per language
        return own.join(F.broadcast(first), "lang").select("lang", name, (F.col("g") - F.col("g0")).alias("pos")), first.drop("g0")

    good, n_good = ranked(1, "chosen_id")
    bad, n_bad = ranked(0, "rejected_id")
    counts = F.broadcast(n_good.join(n_bad, "lang"))
    slots = F.greatest("n_chosen_id", "n_rejected_id")

    def spread(side: DataFrame, name: str) -> DataFrame:
        """Rank r of n stands in slots r, r + n, r + 2n, ... of the language."""
        n = F.col(f"n_{name}")
        x = side.join(counts, "lang").filter(F.col("pos") < slots)
        return x.select("lang", name, F.explode(F.sequence(F.col("pos"), slots - 1, n)).alias("slot"))

    ids = spread(good, "chosen_id").join(spread(bad, "rejected_id"), ["lang", "slot"])
    ids = dense_index(ids.select("rejected_id", "chosen_id", "slot", "lang"), ["rejected_id", "chosen_id", "slot"], "prompt_id")
    out = (ids.join(docs.select(F.col("doc_id").alias("chosen_id"), F.col("text").alias("chosen")), "chosen_id")
           .join(docs.select(F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected")), "rejected_id"))
    return out.select(F.col("prompt_id").cast("bigint"), "chosen", "rejected", "lang",
                      F.col("chosen_id").cast("bigint"), F.col("rejected_id").cast("bigint"))


# ---------------------------------------------------------------- B3 votes on pairs
PAIR_CROWD = 30
PAIR_SLOTS = 3


def pair_votes(prompts: DataFrame) -> DataFrame:
    """Three hashed crowd votes per oriented prompt (needs ``truth_is_a``)."""
    p = prompts.select("prompt_id", "truth_is_a")
    p = p.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SLOTS - 1))))
    pid = F.col("prompt_id").cast("string")
    ann = F.pmod(hash32(F.concat_ws("|", pid, F.lit("a"), F.col("slot").cast("string"))), F.lit(PAIR_CROWD))
    u = unit_hash(F.concat_ws("|", pid, F.lit("v"), F.col("slot").cast("string")))
    p = p.withColumn("annotator_id", ann.cast("bigint"))
    vote = F.when(u < band_accuracy("annotator_id"), F.col("truth_is_a")).otherwise(1 - F.col("truth_is_a"))
    return p.select("prompt_id", "annotator_id", vote.cast("int").alias("vote"))


# ---------------------------------------------------------------- B4 log-prob table
def logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-derived policy/reference sequence log-probs in [-200, -50] per order."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("prompt_id"))
    pid = F.col("prompt_id").cast("string")

    def lp(tag):
        return (F.lit(-200.0) + F.lit(150.0) * unit_hash(F.concat(F.lit(tag + "|"), pid))).alias(tag)

    return o.select("prompt_id", lp("pi_a"), lp("pi_b"), lp("ref_a"), lp("ref_b"))


# ---------------------------------------------------------------- B5 vote stream
STREAM_PROMPTS = 500


def event_votes(events: DataFrame) -> DataFrame:
    """Votes carried by the events table (works on a static or streaming frame)."""
    return events.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("ts"),
        F.pmod(F.col("event_id"), F.lit(STREAM_PROMPTS)).cast("bigint").alias("prompt_id"),
        F.col("user_id").cast("bigint").alias("annotator_id"),
        (F.col("value") > 20).cast("int").alias("vote"))
