"""Preference algebra properties (Q9, stable loss, four-row smoke input)."""

import math

import pytest
from pyspark.sql import functions as F

from crowdtrust.functions.columns import sigmoid, softplus
from crowdtrust.operators import preference as pf


def test_projected_loss_vote_swap_identity(spark):
    # Q9: swapping A/B for a 0 vote and using 1 − γ gives the same loss
    lp = spark.createDataFrame([(i, -50.0 - i, -60.0 + 2 * i, -55.0, -58.0 + i) for i in range(4)],
                               "prompt_id bigint, pi_a double, pi_b double, ref_a double, ref_b double")
    trust = spark.createDataFrame([(0, 0.9), (1, 0.1), (2, 0.5), (3, 0.99)], "prompt_id bigint, trust_weight double")
    base = {r["prompt_id"]: r["loss"] for r in pf.projected_loss(trust, lp).collect()}
    swapped = lp.select("prompt_id", F.col("pi_b").alias("pi_a"), F.col("pi_a").alias("pi_b"),
                        F.col("ref_b").alias("ref_a"), F.col("ref_a").alias("ref_b"))
    flipped = trust.select("prompt_id", (1 - F.col("trust_weight")).alias("trust_weight"))
    other = {r["prompt_id"]: r["loss"] for r in pf.projected_loss(flipped, swapped).collect()}
    for p in base:
        assert base[p] == pytest.approx(other[p], abs=1e-12)
    # γ = 0.5 on a zero logit gives log 2
    zero = spark.createDataFrame([(9, -1.0, -1.0, -2.0, -2.0)], lp.schema)
    half = spark.createDataFrame([(9, 0.5)], trust.schema)
    assert pf.projected_loss(half, zero).first()["loss"] == pytest.approx(math.log(2))


def test_stable_functions_at_extremes(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double")
    r = df.select(softplus(F.col("x")).alias("sp"), sigmoid(F.col("x")).alias("sg")).collect()
    assert r[0]["sp"] == pytest.approx(0.0) and r[2]["sp"] == pytest.approx(1000.0)
    assert r[1]["sp"] == pytest.approx(math.log(2))
    assert r[0]["sg"] == pytest.approx(0.0) and r[2]["sg"] == pytest.approx(1.0) and r[1]["sg"] == 0.5


def test_hard_label_loss_orients_by_vote(spark):
    lp = spark.createDataFrame([(0, -10.0, -20.0, -15.0, -15.0)],
                               "prompt_id bigint, pi_a double, pi_b double, ref_a double, ref_b double")
    v = spark.createDataFrame([(0, 1, 1), (0, 2, 0)], "prompt_id bigint, annotator_id bigint, vote int")
    out = {r["annotator_id"]: r["loss"] for r in pf.hard_label_loss(v, lp).collect()}
    z = 0.1 * 10.0
    assert out[1] == pytest.approx(math.log1p(math.exp(-z)))
    assert out[2] == pytest.approx(math.log1p(math.exp(z)))


def test_accuracy_ties_predict_b(spark):
    lp = spark.createDataFrame([(0, -5.0, -5.0, -1.0, -1.0), (1, -4.0, -5.0, -1.0, -1.0)],
                               "prompt_id bigint, pi_a double, pi_b double, ref_a double, ref_b double")
    truth = spark.createDataFrame([(0, 0), (1, 1)], "prompt_id bigint, truth_is_a int")
    assert pf.policy_accuracy(lp, truth).first()["accuracy"] == 1.0
