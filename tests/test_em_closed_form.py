"""Closed forms and properties of the EM engine (SURVEY §5 (2)–(4))."""

import pytest
from pyspark.sql import functions as F

from conftest import votes_df
from crowdtrust.operators import baselines, em


def _trust(res):
    return {r["prompt_id"]: r["trust_weight"] for r in res.trust.collect()}


def _params(res, col="inferred_acc"):
    return {r["annotator_id"]: r[col] for r in res.params.collect()}


def test_l1_fixed_point(spark):
    # Q25: one vote per prompt → γ ∈ {0.6, 0.4}, α = 0.6, shift 0.1 then 0, stop at iteration 2
    v = votes_df(spark, [(0, 0, 1), (1, 0, 0), (2, 1, 1), (3, 1, 0)])
    res = em.fit(v, "onecoin")
    assert res.iterations == {(0,): 2}
    t = _trust(res)
    assert t[0] == pytest.approx(0.6) and t[1] == pytest.approx(0.4)
    assert t[2] == pytest.approx(0.6) and t[3] == pytest.approx(0.4)
    assert all(a == pytest.approx(0.6) for a in _params(res).values())
    h = sorted(res.history.collect(), key=lambda r: r["iteration"])
    assert h[0]["max_gamma_shift"] == pytest.approx(0.1)
    assert h[1]["max_gamma_shift"] == pytest.approx(0.0, abs=1e-12)


def test_unanimous_votes_saturate(spark):
    rows = [(p, a, 1) for p in range(5) for a in range(3)]
    res = em.fit(votes_df(spark, rows), "onecoin", max_iter=20)
    assert all(g > 0.999 for g in _trust(res).values())
    assert all(a == pytest.approx(1 - 1e-4) for a in _params(res).values())


def test_single_annotator(spark):
    rows = [(p, 7, p % 2) for p in range(6)]
    res = em.fit(votes_df(spark, rows), "onecoin", max_iter=5, tol=None)
    t = _trust(res)
    # a lone annotator with α > 0.5 is trusted: γ follows the vote
    assert all((t[p] > 0.5) == (p % 2 == 1) for p in range(6))


def _random_votes(spark, n_prompts=300, n_ann=12):
    rows = []
    for p in range(n_prompts):
        for k in range(3):
            a = (p * 7 + k * 5) % n_ann
            truth = (p * 2654435761 >> 7) % 2
            good = (p * 31 + a * 17) % 10 < (9 if a % 4 else 3)
            rows.append((p, a, truth if good else 1 - truth))
    return votes_df(spark, rows)


def test_label_flip_symmetry_onecoin(spark):
    v = _random_votes(spark)
    a = em.fit(v, "onecoin", max_iter=6, tol=None)
    b = em.fit(v.withColumn("vote", 1 - F.col("vote")), "onecoin", max_iter=6, tol=None)
    ta, tb = _trust(a), _trust(b)
    assert all(ta[p] == pytest.approx(1 - tb[p], abs=1e-9) for p in ta)
    pa, pb = _params(a), _params(b)
    assert all(pa[k] == pytest.approx(pb[k], abs=1e-9) for k in pa)


def test_label_flip_symmetry_twocoin(spark):
    v = _random_votes(spark)
    a = em.fit(v, "twocoin", max_iter=4, tol=None)
    b = em.fit(v.withColumn("vote", 1 - F.col("vote")), "twocoin", max_iter=4, tol=None)
    pa = {r["annotator_id"]: (r["alpha"], r["beta"]) for r in a.params.collect()}
    pb = {r["annotator_id"]: (r["alpha"], r["beta"]) for r in b.params.collect()}
    for k in pa:  # α ↔ β swap
        assert pa[k][0] == pytest.approx(pb[k][1], abs=1e-6)
        assert pa[k][1] == pytest.approx(pb[k][0], abs=1e-6)
    ha = a.history.orderBy("iteration").collect()[-1]["pi1"]
    hb = b.history.orderBy("iteration").collect()[-1]["pi1"]
    assert ha == pytest.approx(1 - hb, abs=1e-9)


def test_duplicates_equal_counts(spark):
    # Duplicate rows and the compacted count give identical fits
    v = _random_votes(spark)
    dup = v.unionByName(v.filter("prompt_id % 3 = 0"))
    comp = dup.groupBy("prompt_id", "annotator_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    a = em.fit(dup, "onecoin", max_iter=5, tol=None)
    b = em.fit(comp, "onecoin", max_iter=5, tol=None, compacted=True)
    ta, tb = _trust(a), _trust(b)
    assert all(ta[p] == pytest.approx(tb[p], abs=1e-12) for p in ta)


def test_partition_and_bucket_invariance(spark):
    v = _random_votes(spark)
    a = em.fit(v.repartition(1), "onecoin", max_iter=5, tol=None, num_buckets=2)
    b = em.fit(v.repartition(7), "onecoin", max_iter=5, tol=None, num_buckets=11)
    ta, tb = _trust(a), _trust(b)
    assert all(ta[p] == pytest.approx(tb[p], abs=1e-12) for p in ta)


def test_hot_prompt_path_equals_cold(spark):
    # a prompt holding a third of all votes goes through the hot (broadcast) path
    v = _random_votes(spark)
    hot = spark.range(0, 500).select(F.lit(10 ** 6).cast("bigint").alias("prompt_id"),
                                     (F.col("id") % 12).alias("annotator_id"),
                                     (F.col("id") % 3 == 0).cast("int").alias("vote"))
    allv = v.unionByName(hot)
    a = em.fit(allv, "onecoin", max_iter=4, tol=None)
    b = em.fit(allv, "onecoin", max_iter=4, tol=None, hot_threshold=100)
    ta, tb = _trust(a), _trust(b)
    assert len(ta) == len(tb)
    assert all(ta[p] == pytest.approx(tb[p], abs=1e-12) for p in ta)


def test_gamma_in_open_unit_interval(spark):
    res = em.fit(_random_votes(spark), "onecoin", max_iter=8, tol=None)
    assert all(0.0 < g < 1.0 for g in _trust(res).values())


def test_textbook_and_legacy_prior_differ(spark):
    v = _random_votes(spark)
    a = em.fit(v, "twocoin", max_iter=3, tol=None, prior_mode="textbook")
    b = em.fit(v, "twocoin", max_iter=3, tol=None, prior_mode="legacy")
    ta, tb = _trust(a), _trust(b)
    assert max(abs(ta[p] - tb[p]) for p in ta) > 1e-4


def test_engine_matches_standalone_steps(spark):
    # one engine iteration == E-step with the init α then M-step
    v = _random_votes(spark)
    res = em.fit(v, "onecoin", max_iter=1, tol=None)
    alpha0 = v.select("annotator_id").distinct().withColumn("alpha", F.lit(0.6))
    g = baselines.onecoin_e_step(v, alpha0)
    a1 = baselines.onecoin_m_step(v, g)
    tg = {r["prompt_id"]: r["trust_weight"] for r in g.collect()}
    assert all(tg[p] == pytest.approx(x, abs=1e-12) for p, x in _trust(res).items())
    ta = {r["annotator_id"]: r["alpha"] for r in a1.collect()}
    assert all(ta[k] == pytest.approx(x, abs=1e-12) for k, x in _params(res).items())


def test_saturated_prior_is_clamped(spark):
    v = votes_df(spark, [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)])
    prior = spark.createDataFrame([(0, 0.0), (1, 1.0)], "prompt_id bigint, prior double")
    res = em.fit(v, "onecoin", max_iter=1, tol=None, prior=prior)
    t = _trust(res)
    assert t[0] is not None and t[1] is not None
    assert t[0] < 1e-3 and t[1] > 1 - 1e-3


def test_batched_groups_equal_separate_fits(spark):
    # One batched fit keyed by config equals independent fits
    v = _random_votes(spark)
    both = v.withColumn("cfg", F.lit(0)).unionByName(
        v.withColumn("vote", 1 - F.col("vote")).withColumn("cfg", F.lit(1)))
    res = em.fit(both, "onecoin", group_cols=["cfg"], max_iter=20)
    single = em.fit(v, "onecoin", max_iter=20)
    t = {r["prompt_id"]: r["trust_weight"] for r in res.trust.filter("cfg = 0").collect()}
    ts = _trust(single)
    assert all(t[p] == pytest.approx(ts[p], abs=1e-12) for p in ts)
    assert res.iterations[(0,)] == single.iterations[(0,)]
