"""The streaming results over several micro-batches equal the batch
computation; re-delivered events are dropped inside the watermark."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from crowdtrust.operators import baselines
from crowdtrust.session import scratch_path
from crowdtrust.sources import fixtures as fx
from crowdtrust.streaming import trust as stm


@pytest.fixture(scope="module")
def event_folder(spark):
    ev = fx.read_table(spark, SF0001, "events")
    folder = scratch_path(spark, "events_in")
    ev.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"{folder}/events_0.parquet")
    ev.filter("event_id % 2 = 1").coalesce(1).write.parquet(f"{folder}/events_1.parquet")
    # a re-delivery of some events, later in arrival order
    ev.filter("event_id % 5 = 0").coalesce(1).write.parquet(f"{folder}/events_2.parquet")
    return folder


def _stream(spark, folder):
    return stm.event_vote_stream(spark, folder, glob="part-*.parquet", files_per_trigger=1)


def test_stream_trust_equals_batch_e_step(spark, event_folder):
    alpha = spark.range(0, 200).select(F.col("id").alias("annotator_id"),
                                       (0.3 + (F.col("id") % 7) / 10.0).alias("alpha"))
    path = scratch_path(spark, "x1_test")
    first = fx.read_table(spark, SF0001, "events").filter("event_id % 2 = 0")
    q = stm.run_changelog(stm.stream_trust(_stream(spark, f"{event_folder}/events_[01].parquet"), alpha), path)
    assert q.lastProgress is not None
    got = {r["prompt_id"]: (r["n_votes"], r["trust_weight"]) for r in stm.latest_rows(spark, path, ["prompt_id"])
           .collect()}
    batch_votes = fx.event_votes(fx.read_table(spark, SF0001, "events")).select("prompt_id", "annotator_id", "vote")
    exp = {r["prompt_id"]: r["trust_weight"] for r in baselines.onecoin_e_step(batch_votes, alpha).collect()}
    assert set(got) == set(exp)
    assert all(got[p][1] == pytest.approx(exp[p], abs=1e-12) for p in exp)
    assert sum(v[0] for v in got.values()) == batch_votes.count()
    # more than one micro-batch was appended to the change log
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 2
    assert first.count() > 0


def test_windowed_agreement_drops_redelivered_events(spark, event_folder):
    labels = spark.range(0, 500).select(F.col("id").alias("prompt_id"), (F.col("id") % 2).cast("int").alias("label"))
    path = scratch_path(spark, "x2_test")
    stm.run_changelog(stm.windowed_agreement(_stream(spark, f"{event_folder}/events_[012].parquet"), labels,
                                             watermark="400 days"), path)
    got = stm.latest_rows(spark, path, ["annotator_id", "window_start"])
    ev = fx.event_votes(fx.read_table(spark, SF0001, "events"))
    exp = (ev.join(labels, "prompt_id").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"),
                                                 "annotator_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vote") == F.col("label")).cast("int")).alias("a")))
    e = {(r["annotator_id"], r["w"]["start"]): (r["n"], r["a"]) for r in exp.collect()}
    g = {(r["annotator_id"], r["window_start"]): (r["n_votes"], r["n_agree"]) for r in got.collect()}
    assert g == e
