"""Selection without a sort, sparse features, wide fits, the saved scoring
pipeline, closed prompts, and mistakes in the input that must not pass."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import SF0001, votes_df
from crowdtrust.operators import models as md
from crowdtrust.operators import prepare as pp
from crowdtrust.operators import robustness as rb
from crowdtrust.operators import text as tx
from crowdtrust.session import scratch_path
from crowdtrust.sources import fixtures as fx
from crowdtrust.streaming import trust as stm


def sorted_sample(df, key, cap, seed=42):
    h = pp.hash32(F.concat(F.lit(f"{seed}|shuffle|"), F.col(key).cast("string")))
    return [r[0] for r in df.withColumn("_h", h).orderBy("_h", key).limit(cap).select(key).collect()]


@pytest.mark.parametrize("cap", [0, 1, 7, 1500, 2999, 3000, 5000])
def test_selection_equals_the_sorted_slice(spark, cap):
    df = spark.range(3000).withColumnRenamed("id", "k").withColumn("payload", F.lit("x"))
    assert [r.k for r in pp.seeded_sample(df, "k", cap).collect()] == sorted_sample(df, "k", cap)


def test_selection_with_a_hot_key(spark):
    """A third of the rows has one key: some of its rows are taken, row by row."""
    df = spark.range(900).select(F.when(F.col("id") < 300, F.lit(5)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    wanted = sorted_sample(df, "k", 10 ** 6)
    at = wanted.index(5)
    for cap in (at, at + 1, at + 100, at + 300, at + 301):
        got = pp.seeded_sample(df, "k", cap)
        assert [r.k for r in got.collect()] == wanted[:cap] and got.select("row").distinct().count() == cap


def test_selection_needs_no_single_task_sort(spark):
    plan = pp.seeded_sample(spark.range(1000).withColumnRenamed("id", "k"), "k", 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan


def prompts_df(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "prompt_id long, text_a string, text_b string")


def random_pairs(n):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Zwölf", "don't", "a-b"]
    text = lambda: " ".join(r.choices(words, k=r.randint(0, 30)))
    return [(text(), text()) for _ in range(n)] + [("", ""), (None, "one two"), ("same same", "same same"), ("only", None)]


@pytest.mark.parametrize("width", [1, 7, 64])
def test_sparse_features_equal_dense_ones(spark, width):
    p = prompts_df(spark, random_pairs(60)).filter("text_a is not null and text_b is not null")
    sparse = tx.sparse_pair_features(p, width)
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    dense = {r.prompt_id: (list(r.phi), r.len_diff) for r in tx.pair_features(p, width).collect()}
    for r in sparse.collect():
        phi = [0.0] * width
        for i, x in zip(r.indices, r["values"], strict=True):
            phi[i] = x
        assert (phi, r.len_diff) == dense[r.prompt_id] and list(r.indices) == sorted(set(r.indices)) and 0.0 not in r["values"]


def test_sparse_features_of_a_very_long_text(spark):
    p = prompts_df(spark, [(" ".join(f"t{i % 9000}" for i in range(60_000)), "t1")])
    r = tx.sparse_pair_features(p, 1 << 18).first()
    assert sum(r["values"]) == 59_999 and r.len_diff == 59_999


def test_token_ids_of_empty_and_null_texts(spark):
    p = prompts_df(spark, [("b a b c", ""), (None, "zz"), ("", None)])
    vocab = spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], "token string, token_id int, count long")
    got = {r.prompt_id: tuple(r)[1:] for r in tx.token_ids(p, vocab, 4, max_len=3).collect()}
    assert got == {0: ([3, 2, 3], [0, 0, 0], 4, 0), 1: ([0, 0, 0], [1, 0, 0], 0, 1), 2: ([0, 0, 0], [0, 0, 0], 0, 0)}
    whole = {r.prompt_id: tuple(r)[1:] for r in tx.token_ids(p, vocab, 4, max_len=None).collect()}
    assert whole[0] == ([3, 2, 3, 1], [], 4, 0)


def soft_rows(spark, n, d, constant=None):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, d)) * (r.random((n, d)) < 0.4)
    w = r.normal(size=d) * 0.5
    off = np.full(n, constant) if constant is not None else r.normal(size=n) * 0.3
    gamma = np.clip(1 / (1 + np.exp(-(x @ w + off))) + r.normal(size=n) * 0.1, 0, 1)
    gamma[:20] = [0.0, 1.0] * 10  # one-sided labels
    weight = r.integers(1, 5, n)
    rows = [(i, [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]], x[i].tolist(), float(off[i]), float(gamma[i]), int(weight[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "prompt_id long, indices array<int>, values array<double>, phi array<double>, off double, gamma double, n long")
    logps = df.select("prompt_id", (-F.col("off") / 0.1).alias("ref_a"), F.lit(0.0).alias("ref_b"))
    labels, weights = df.select("prompt_id", "gamma"), df.select("prompt_id", "n")
    return df, logps, labels, weights


@pytest.mark.parametrize("constant", [None, 0.0, 0.4])
def test_wide_solver_equals_the_glm(spark, constant):
    """64 features, no penalty: both solvers minimise the same loss."""
    df, logps, labels, weights = soft_rows(spark, 1500, 64, constant)
    glm = md.fit_preference_model(md.training_table(df.select("prompt_id", "phi"), logps, labels, "gamma", weights), reg_param=0.0, max_iter=100, tol=1e-12)
    train = md.wide_training_table(df.select("prompt_id", "indices", "values"), 64, logps, labels, "gamma", weights)
    wide = md.fit_wide_preference_model(train, 64, reg_param=0.0, tol=1e-8)
    assert wide.gradient <= 1e-8 and np.abs(wide.weights - glm.coefficients.toArray()).max() < 1e-5
    p = {r.prompt_id: r.p_a for r in wide.probability(train).collect()}
    q = {r.prompt_id: r.prior for r in md.predict_prior(glm, md.training_table(df.select("prompt_id", "phi"), logps, labels, "gamma", weights)).collect()}
    assert max(abs(p[i] - q[i]) for i in p) < 1e-5
    assert md.loss_gradient(train, wide, 0.0).agg(F.max(F.abs("gradient"))).first()[0] < 1e-7


def test_pipeline_scores_raw_pairs_in_another_session(spark):
    from crowdtrust.plans import joint as jt
    data = jt.preference_data(spark, SF0001, num_features=16)
    share, n = md.baseline_labels(data.votes)
    model = md.fit_preference_model(jt.design(data, share, "share", n))
    wanted = {r.prompt_id: r.prior for r in md.predict_prior(model, jt.scoring_table(data)).collect()}
    path = scratch_path(spark, "pipeline_test")
    jt.scoring_pipeline(data, model, 16).write().save(path)
    other = spark.newSession()
    from crowdtrust.operators.scoring import score_pairs
    raw = data.prompts.select("prompt_id", "text_a", "text_b")
    raw.write.parquet(f"{path}-raw")
    got = {r.prompt_id: r.p_a for r in score_pairs(PipelineModel.load(path), other.read.parquet(f"{path}-raw")).collect()}
    assert got == pytest.approx(wanted, abs=1e-9)
    new = prompts_df(spark, [("never seen words", "und auch diese nicht"), ("", "")])
    assert score_pairs(PipelineModel.load(path), new).filter("p_a > 0 and p_a < 1").count() == 2


def test_contradictory_cells_fail(spark):
    m = spark.createDataFrame([("Heatmap", 1, 0.05, 400, 0.2), ("Heatmap", 1, 0.05, 400, 0.2), ("Heatmap", 2, 0.05, 400, 0.1)], "variable_tested string, L int, Adv double, N int, Error double")
    assert [(r.L, r["5%"]) for r in rb.heatmap(m, [0.05]).collect()] == [(2, 0.1), (1, 0.2)]
    bad = m.unionByName(spark.createDataFrame([("Heatmap", 2, 0.05, 400, 0.3)], m.schema))
    with pytest.raises(Exception, match="two errors for L = 2"):
        rb.heatmap(bad, [0.05]).collect()


def test_votes_without_text_fail(spark):
    p = prompts_df(spark, [("a", "b")])
    good, bad = votes_df(spark, [(0, 1, 1)]), votes_df(spark, [(0, 1, 1), (9, 1, 0)])
    assert tx.votes_with_text(good, p).count() == 1 and len(tx.votes_with_text(good, p).collect()) == 1
    with pytest.raises(Exception, match="no text for prompt 9"):
        tx.votes_with_text(bad, p).collect()
    assert [tuple(r) for r in tx.orphan_votes(bad, p).select("prompt_id", "annotator_id").collect()] == [(9, 1)]


def test_closed_prompts_equal_batch_and_are_forgotten(spark):
    """Six files in order of time: every session that is closed comes out once, and the state falls back."""
    ev = fx.read_table(spark, SF0001, "events")
    folder = scratch_path(spark, "closed_events")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    lo, hi = ev.select(F.min(day), F.max(day)).first()
    width = (hi - lo) // 6 + 1
    for k in range(6):  # one file per stretch of time, read oldest first
        ev.filter((day >= lo + k * width) & (day < lo + (k + 1) * width)).coalesce(1).write.parquet(f"{folder}/events_{k}.parquet")
    alpha = spark.range(200).select(F.col("id").alias("annotator_id"), (0.3 + (F.col("id") % 7) / 10.0).alias("alpha"))
    path = scratch_path(spark, "closed_test")
    stream = stm.event_vote_stream(spark, f"{folder}/events_*.parquet", files_per_trigger=1, glob="part-*.parquet")
    q = stm.run_changelog(stm.closed_trust(stream, alpha, "2 hours"), path, output_mode="append")
    got = {(r.prompt_id, r.opened): (r.n_votes, r.trust_weight) for r in spark.read.parquet(path).collect()}
    every = stm.closed_trust(fx.event_votes(ev), alpha, "2 hours")
    end = fx.event_votes(ev).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    wanted = {(r.prompt_id, r.opened): (r.n_votes, r.trust_weight) for r in every.filter(F.col("closed") <= F.lit(end)).collect()}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], abs=1e-12) for k in got)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(states) >= 6 and max(states) < len(wanted) / 2 and states[-1] < len(wanted) / 20
