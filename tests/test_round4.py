"""Sweeps, token ids and wide features that do no work per configuration, row or value over again."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, votes_df
from crowdtrust.operators import em, robustness as rb, text as tx
from crowdtrust.sources import fixtures as fx

CONFIGS = [rb.Config(0, "Heatmap", 1, 0.05, 20), rb.Config(1, "Heatmap", 3, 0.35, 20), rb.Config(2, "Scale", 99, 0.1, 7),
           rb.Config(3, "Scale", 2, 0.55, 400), rb.Config(4, "Scale", 3, 0.0, 1)]


def rows(df, keys, *cols):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in cols) for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


@pytest.mark.parametrize("tol, odd", [(None, False), (1e-3, False), (None, True)])
def test_sweep_fit_equals_em_on_written_votes(spark, tol, odd):
    """The sweep makes perturbed votes in its tasks; all results are those of ``em.fit`` on the written ones."""
    if odd:  # equal rows, nulls, a hot prompt, truth missing or twice
        votes = votes_df(spark, [(p, (3 * p + k) % 11, (p + k) % 2) for p in range(30) for k in range(4)] * 2
                         + [(None, 3, 1), (4, None, 1), (5, 2, None), (6, 1, None)] + [(99, k % 11, int(k % 3 > 0)) for k in range(300)])
        truth = spark.createDataFrame([(a, 0.6 + a / 50) for a in range(9)] + [(2, 0.9), (10, None)], "annotator_id bigint, true_acc double")
    else:
        votes, truth = fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001)
    pv, wt = rb.perturbed_votes(votes, truth, CONFIGS)
    kw = {"max_iter": 6, "tol": tol, "track_frames": True}
    want = em.fit(pv, "onecoin", worker_truth=wt, group_cols=["config_id"], **kw)
    _, got = rb.run_sweep(votes, truth, CONFIGS, **kw)
    assert got.iterations == want.iterations and (tol is None or len(set(got.iterations.values())) > 1)
    same(rows(got.history, ["config_id", "iteration"], "l1_parameter_loss", "max_gamma_shift"),
         rows(want.history, ["config_id", "iteration"], "l1_parameter_loss", "max_gamma_shift"))
    same(rows(got.frames, ["config_id", "iteration", "annotator_id"], "inferred_acc"), rows(want.frames, ["config_id", "iteration", "annotator_id"], "inferred_acc"))
    same(rows(got.params, ["config_id", "annotator_id"], "alpha", "inferred_acc"), rows(want.params, ["config_id", "annotator_id"], "alpha", "inferred_acc"))
    same(rows(got.trust, ["config_id", "prompt_id"], "trust_weight"), rows(want.trust, ["config_id", "prompt_id"], "trust_weight"))
    same(rows(got.state, ["config_id", "annotator_id"], "alpha_cur", "alpha_prev"), rows(want.state, ["config_id", "annotator_id"], "alpha_cur", "alpha_prev"))


def test_sweep_writes_a_row_per_prompt(spark, monkeypatch):
    """No vote is written per configuration, however many configurations there are."""
    def written(*_, **__):
        raise AssertionError("votes written per configuration")
    monkeypatch.setattr(rb, "perturbed_votes", written)
    votes, truth = fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001)
    matrix, res = rb.run_sweep(votes, truth, max_iter=1, tol=None)
    assert matrix.filter("Error is not null").count() == len(rb.sweep_configs())
    packed, _ = rb.prompt_votes(votes, truth, 5)
    assert packed.count() == votes.select("prompt_id").distinct().count()
    assert packed.agg(F.max(F.size("votes"))).first()[0] <= 5


def test_votes_are_ranked_and_counted_once_for_all_iterations(spark, monkeypatch):
    """Matrix and edge cases share the written votes; after the first iteration only γ is added up."""
    from crowdtrust.plans.sweep import run_stress_sweep
    made, counted = [], []
    make, step = rb.prompt_votes, rb.sweep_step
    monkeypatch.setattr(rb, "prompt_votes", lambda *a, **k: made.append(a[2]) or make(*a, **k))
    monkeypatch.setattr(rb, "sweep_step", lambda *a: counted.append(a[5]) or step(*a))
    votes, truth = fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001)
    report = run_stress_sweep(votes, truth, CONFIGS[:2], max_iter=3, tol=None)
    assert made == [max(rb.L_GRID)] and counted == [True, False, False] * 2
    alone, _ = rb.run_sweep(votes, truth, CONFIGS[:2], max_iter=3, tol=None)
    same(rows(report.matrix, ["config_id"], "Error"), rows(alone, ["config_id"], "Error"))


def test_ranks_without_hot_groups_take_one_exchange(spark):
    v = votes_df(spark, [(p, a, (p + a) % 2) for p in range(9) for a in range(5)] + [(3, 1, 0)])
    found = []
    for threshold in (3, 100):  # every group is hot, none is
        df = rb.top_per_group(v, ["prompt_id"], ["annotator_id", "vote"], F.lit(3), threshold, rank_name="r")
        found.append(sorted(map(tuple, df.select("prompt_id", "annotator_id", "vote", "r").collect())))
    assert found[0] == found[1] and len(found[0]) == 27
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_crowds_too_large_to_broadcast_are_fitted_by_em(spark, monkeypatch):
    votes, truth = fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001)
    kw = {"max_iter": 2, "tol": None}
    a = rows(rb.run_sweep(votes, truth, CONFIGS, **kw)[0], ["config_id"], "Error", "iterations")
    monkeypatch.setattr(rb, "BROADCAST_ROW_LIMIT", 100)
    same(a, rows(rb.run_sweep(votes, truth, CONFIGS, **kw)[0], ["config_id"], "Error", "iterations"))


def test_token_counts_are_taken_once_per_pair(spark):
    """K1: above the explode, whose rows are tokens, no text is taken apart."""
    p = spark.createDataFrame([(1, "a b a", "c"), (2, "", None)], "prompt_id bigint, text_a string, text_b string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, token_id int")
    df = tx.token_ids(p, vocab, 4, max_len=3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate explode")]
    assert "regexp_replace" not in above and "text_a" not in above
    got = {r.prompt_id: (r.ids_a, r.ids_b, r.n_tok_a, r.n_tok_b) for r in df.collect()}
    assert got == {1: ([2, 3, 2], [1, 0, 0], 3, 1), 2: ([0, 0, 0], [0, 0, 0], 0, 0)}


def test_wide_values_are_scaled_by_a_length_added_up_once(spark):
    """The length of a row's values is not added up again for every value."""
    from crowdtrust.plans import joint as jt
    p = spark.createDataFrame([(1, "a b a", "c"), (2, "d", "d"), (3, "", "x x")], "prompt_id bigint, text_a string, text_b string")
    labels = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 1.0)], "prompt_id bigint, label double")
    df = jt.wide_design(jt.PreferenceData(p, None, None, None, None, None, 0, None), labels, "label")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    inside = [x for x in plan.split("lambdafunction(")[1:]]
    assert "array_repeat" in plan and not any("/ SQRT" in x[:80] for x in inside)
    got = {r.prompt_id: sorted(r["values"][:-1]) for r in df.collect()}
    six = 6 ** 0.5
    assert got[1] == pytest.approx([-1 / six, 1 / six, 2 / six]) and got[2] == [] and got[3] == pytest.approx([-1.0])


def test_bigrams_take_one_exchange_of_ids(spark):
    """Words are taken apart by one pattern and never exchanged; texts with unknown, equal and no words."""
    p = spark.createDataFrame([(1, "A b, a b!", "b"), (2, "", None), (3, " é-x zz", "b a q r")], "prompt_id bigint, text_a string, text_b string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("é", 4)], "token string, token_id int")
    words = p.select(tx.tokens("text_a"), tx.tokens("text_b"))
    assert "regexp_replace" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in words.collect()] == [(["a", "b", "a", "b"], ["b"]), ([], None), (["é", "x", "zz"], ["b", "a", "q", "r"])]
    big = tx.side_bigrams(p, vocab, 5)
    exchanges = [x for x in big._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "tok#" not in exchanges[0]
    assert sorted(map(tuple, big.collect())) == [(1, "a", 2, 3, 2), (1, "a", 3, 2, 1), (3, "a", 1, 1, 1), (3, "a", 4, 1, 1),
                                                 (3, "b", 1, 1, 1), (3, "b", 2, 1, 1), (3, "b", 3, 2, 1)]
