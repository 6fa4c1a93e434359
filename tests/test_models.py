"""The soft-label preference regression recovers the generating weights
(fractional labels, reference offset, no intercept); T5 round trip."""

import math

import pytest
from pyspark.sql import functions as F

from crowdtrust.operators import models as md


def test_soft_label_glm_recovers_weights(spark, tmp_path):
    w = [0.8, -0.5, 0.3]
    rows = []
    for i in range(400):
        x = [math.sin(i * 0.37), 2 * math.cos(i * 0.91), ((i * 7) % 13) / 6 - 1]  # linearly independent
        off = math.cos(i * 0.11)
        eta = sum(a * b for a, b in zip(w, x)) + off
        rows.append((i, x, off, 1 / (1 + math.exp(-eta))))
    df = spark.createDataFrame(rows, "prompt_id bigint, phi array<double>, off double, gamma double")
    feats = df.select("prompt_id", "phi")
    labels = df.select("prompt_id", "gamma")
    # offset = −β(ref_a − ref_b) with β = 0.1: choose ref_b − ref_a = 10·off
    logps = df.select("prompt_id", F.lit(0.0).alias("ref_a"), (F.col("off") * 10).alias("ref_b"))
    train = md.training_table(feats, logps, labels, "gamma")
    model = md.fit_preference_model(train, reg_param=0.0)
    assert list(model.coefficients) == pytest.approx(w, abs=1e-6)
    # the policy log-ratio reproduces w·x exactly: β(pi_diff − ref_diff) = w·x
    lp = md.policy_logps_from_model(model, train).join(df, "prompt_id").collect()
    for r in lp[:20]:
        wx = sum(a * b for a, b in zip(w, r["phi"]))
        assert 0.1 * (r["pi_diff"] - r["ref_diff"]) == pytest.approx(wx, abs=1e-6)
    path = str(tmp_path / "model")
    md.save_model(model, path)
    scored = {r["prompt_id"]: r["p_a"] for r in md.load_and_score(path, train).collect()}
    assert scored[5] == pytest.approx(rows[5][3], abs=1e-6)


def test_baseline_labels_equal_per_vote_loss(spark):
    # Σ over a prompt's votes of the hard loss = n × soft loss with label = share
    v = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 0), (1, 1, 0)],
                              "prompt_id bigint, annotator_id bigint, vote int")
    share, n = md.baseline_labels(v)
    s = {r["prompt_id"]: r["share"] for r in share.collect()}
    c = {r["prompt_id"]: r["n"] for r in n.collect()}
    assert s == {0: pytest.approx(2 / 3), 1: 0.0} and c == {0: 3, 1: 1}
