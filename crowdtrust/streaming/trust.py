"""Structured Streaming extensions.

X1 – running trust per prompt from a vote stream with frozen annotator
accuracies: the one-coin E-step is two running sums per prompt
(Σ ln(v ? α : 1−α), Σ ln(v ? 1−α : α)), so the streaming aggregate is
incrementally exact and equals the batch E-step on all votes seen so far.
Either every prompt stays open, or a prompt is closed after a time without
votes and its state is dropped (:func:`closed_trust`).

X2 – annotator agreement with the trusted label per event-time window,
without loss in whatever order the files come, or with a watermark that the
caller names to bound the state.  Repeated deliveries of an event count once.

Both run on any streaming source of votes.  Results go to a change-log
table: every micro-batch appends the rows it updated, tagged with its
batch id, to parquet in the shared checkpoint folder (update mode keeps the
state small and emits windows as soon as they change); readers take the
latest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtrust.functions.columns import two_class_posterior
from crowdtrust.operators.baselines import vote_accuracy
from crowdtrust.operators.prepare import hard_label
from crowdtrust.operators.votes import BROADCAST_ROW_LIMIT
from crowdtrust.session import scratch_path
from crowdtrust.sources.fixtures import event_votes

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_vote_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None,
                      glob: str = "events*.parquet") -> DataFrame:
    """Vote stream over the parquet event files of a folder (B5).  A
    micro-batch takes all files there are, unless ``files_per_trigger`` says less."""
    ev = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if files_per_trigger:
        ev = ev.option("maxFilesPerTrigger", files_per_trigger)
    return event_votes(ev.parquet(folder))


def _sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def stream_trust(votes: DataFrame, alpha: DataFrame, alpha_col: str = "alpha") -> DataFrame:
    """(prompt_id, n_votes, trust_weight) as a running aggregate.

    ``votes`` is a streaming (or static) frame of (prompt_id, annotator_id,
    vote); ``alpha`` a static per-annotator table, broadcast after a size
    check, otherwise a shuffled stream-static join.  Annotators that it does
    not list vote with the initial accuracy.  The state is one row per prompt
    for good: a late vote still counts."""
    j = vote_accuracy(votes, alpha, alpha_col)
    la, l1a = F.log(F.col("_a")), F.log(1.0 - F.col("_a"))
    agg = j.groupBy("prompt_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_votes"),
        F.sum(F.when(F.col("vote") == 1, la).otherwise(l1a)).alias("_sa"),
        F.sum(F.when(F.col("vote") == 1, l1a).otherwise(la)).alias("_sb"))
    half = F.log(F.lit(0.5))
    return agg.select("prompt_id", "n_votes",
                      two_class_posterior(half + F.col("_sa"), half + F.col("_sb")).alias("trust_weight"))


def closed_trust(votes: DataFrame, alpha: DataFrame, idle: str, lateness: str = "0 seconds", alpha_col: str = "alpha") -> DataFrame:
    """X1 with bounded state: (prompt_id, opened, closed, n_votes, trust_weight).

    A prompt is closed when ``idle`` has gone by, in event time, without a
    vote on it; then its trust is emitted once, as final (append mode), and
    its state is forgotten.  So the state holds the prompts of the last
    ``idle`` + ``lateness`` and not all there ever were.  A vote after that
    opens the prompt anew, in a row of its own; a vote that comes more than
    ``lateness`` behind the newest one may be dropped, which the caller says
    by naming it.  On a static frame: the rows of all sessions."""
    v = votes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    j = vote_accuracy(v, alpha, alpha_col)
    la, l1a = F.log(F.col("_a")), F.log(1.0 - F.col("_a"))
    agg = j.groupBy(F.session_window("ts", idle).alias("w"), "prompt_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_votes"),
        F.sum(F.when(F.col("vote") == 1, la).otherwise(l1a)).alias("_sa"),
        F.sum(F.when(F.col("vote") == 1, l1a).otherwise(la)).alias("_sb"))
    half = F.log(F.lit(0.5))
    return agg.select("prompt_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n_votes",
                      two_class_posterior(half + F.col("_sa"), half + F.col("_sb")).alias("trust_weight"))


def windowed_agreement(votes: DataFrame, labels: DataFrame, window: str = "1 day",
                       watermark: str | None = None, label_col: str = "label") -> DataFrame:
    """Per (annotator, event-time window) the number of votes and the
    share that agree with the trusted label; an event that is delivered
    again counts once.

    Without ``watermark`` no vote is ever late: files may arrive in any order
    and the state (event ids and window counts) grows with the stream.  A
    watermark bounds the state; the caller thereby says that votes later than
    it may be dropped."""
    v = votes.withColumn("ts", F.col("ts").cast("timestamp"))  # event time in the session time zone
    if watermark:
        v = v.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    else:
        v = v.dropDuplicates(["event_id"])
    lab = labels.select("prompt_id", F.col(label_col).cast("int").alias("_label"))
    j = v.join(_sized_broadcast(lab), "prompt_id")
    agg = j.groupBy(F.window("ts", window).alias("w"), "annotator_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_votes"),
        F.sum((F.col("vote") == F.col("_label")).cast("int")).cast("bigint").alias("n_agree"))
    return agg.select("annotator_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n_votes", "n_agree", (F.col("n_agree") / F.col("n_votes")).alias("agreement"))


def run_changelog(stream: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = True,
                  output_mode: str = "update"):
    """Run ``stream`` in update mode, appending each micro-batch's updated
    rows with its ``batch_id`` to parquet at ``path``; returns the query
    (already finished when ``available_now``)."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream_ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return q


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current view of a change-log table: the newest row per key."""
    df = spark.read.parquet(path)
    values = [c for c in df.columns if c not in (*keys, "batch_id")]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*").select(*[c for c in df.columns if c != "batch_id"])


def trusted_labels(trust: DataFrame, col: str = "trust_weight") -> DataFrame:
    return trust.select("prompt_id", hard_label(F.round(col, 6)).alias("label"))
