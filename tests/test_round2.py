"""Index helper, E-step edge cases, store life cycle, sweep and vote-loss tests."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, votes_df
from crowdtrust.operators import baselines, em, prepare, robustness as rb
from crowdtrust.operators.votes import VoteStore
from crowdtrust.sources import fixtures as fx
from crowdtrust.sources import io as cio


def test_dense_index_with_payload(spark):
    n = 400_000
    df = spark.range(n).select(F.xxhash64("id").alias("key"), F.md5(F.col("id").cast("string")).alias("payload"))
    out = prepare.dense_index(df, ["key"], "i")
    s = out.agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i"), F.sum((F.md5(F.lit("x")) == "").cast("int"))).first()
    assert tuple(s)[:4] == (n, n, 0, n - 1)
    # in order: no key that is smaller has a larger index
    from pyspark.sql import Window
    assert out.withColumn("b", F.floor(F.col("i") / 1000)).withColumn("p", F.lag("key").over(Window.partitionBy("b").orderBy("i"))).filter("p > key").isEmpty()


def test_trim_keeps_the_right_number(spark):
    prompts = spark.range(30_000).select(F.col("id").alias("prompt_id"), F.repeat(F.lit("text "), 40).alias("text"))
    kept, r, tasks = prepare.regular_graph_trim(prompts, 3, 7)
    assert tasks == (7 * (30_000 * 3 // 7)) // 3 and kept.count() == tasks and kept.agg(F.max("prompt_id")).first()[0] == tasks - 1
    assert kept.columns == prompts.columns


def test_pairs_use_every_labelled_document_once_or_more(spark):
    sf = "/root/testdata/sf0.1"
    p = fx.pairs(spark, sf).select("prompt_id", "chosen_id", "rejected_id").cache()
    n = p.count()
    assert tuple(p.agg(F.count_distinct("prompt_id"), F.min("prompt_id"), F.max("prompt_id")).first()) == (n, 0, n - 1)
    lab = fx.read_table(spark, sf, "labels")
    good, bad = (lab.filter(F.col("quality") == q).join(fx.read_table(spark, sf, "documents"), "doc_id").count() for q in (1, 0))
    assert p.select("chosen_id").distinct().count() == good and p.select("rejected_id").distinct().count() == bad
    assert n < good + bad
    p.unpersist()


def test_e_step_saturated_and_unknown_annotators(spark):
    votes = votes_df(spark, [(1, 1, 1), (1, 2, 0), (2, 1, 1), (3, 3, 0), (4, 9, 1)])
    alpha = spark.createDataFrame([(1, 1.0), (2, 0.6), (3, 0.0)], "annotator_id bigint, alpha double")
    got = {r.prompt_id: r.trust_weight for r in baselines.onecoin_e_step(votes, alpha).collect()}
    odds = (1 - 1e-4) / 1e-4
    assert got[1] == pytest.approx(odds / (odds + 1.5)) and got[2] == pytest.approx(1 - 1e-4)
    assert got[3] == pytest.approx(1 - 1e-4)  # who is never right votes B
    assert got[4] == pytest.approx(0.6)  # not listed: the initial accuracy
    params = spark.createDataFrame([(1, 1.0, 1.0)], "annotator_id bigint, alpha double, beta double")
    two = {r.prompt_id: r.trust_weight for r in baselines.twocoin_e_step(votes, params, 0.5).collect()}
    assert all(0 < g < 1 for g in two.values()) and len(two) == 4


def test_dense_ids_edges(spark):
    one = spark.createDataFrame([(0, 0.9)], "prompt_id bigint, g double")
    assert [tuple(r) for r in cio.dense_ids(one, "prompt_id", {"g": 0.5}).collect()] == [(0, 0.9)]
    assert cio.dense_ids(one.filter("g < 0"), "prompt_id", {"g": 0.5}).collect() == []


def test_fit_with_dense_ids(spark):
    votes = votes_df(spark, [(0, 0, 1), (0, 3, 1), (4, 0, 0), (4, 3, 0)])
    res = em.fit(votes, "onecoin", dense=True)
    assert sorted(r.prompt_id for r in res.trust.collect()) == [0, 1, 2, 3, 4]
    assert {r.prompt_id: r.trust_weight for r in res.trust.collect()}[2] == em.INIT_GAMMA
    assert {r.annotator_id: r.alpha for r in res.params.collect()}[1] == em.ONECOIN_EPS


def _store_files(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    root = root.replace("file:", "")
    return {d for d in os.listdir(f"{root}/crowdtrust") if "ct_votes" in d or "hot_votes" in d} if os.path.isdir(f"{root}/crowdtrust") else set()


def test_a_fit_leaves_no_store(spark):
    files, tables = _store_files(spark), {t.name for t in spark.catalog.listTables()}
    res = em.fit(votes_df(spark, [(1, 1, 1), (1, 2, 0), (2, 1, 1)]), "onecoin")
    assert _store_files(spark) == files and {t.name for t in spark.catalog.listTables()} == tables
    assert res.trust.count() == 2 and res.params.count() == 2
    with VoteStore.build(votes_df(spark, [(1, 1, 1)]).withColumn("g", F.lit(0)), ["g"]) as store:
        assert store.rows().count() == 1 and _store_files(spark) != files
    assert _store_files(spark) == files


def test_votes_do_not_shuffle_in_the_m_step(spark):
    """The votes meet their prompt's posterior inside the bucket; what is
    exchanged is one row per annotator and task."""
    store = em.build_store(fx.votes(spark, SF0001))
    eng = em.EMEngine(store, em.make_model("onecoin"))
    plan = eng.step(eng.initial_state())._jdf.queryExecution().executedPlan().toString()
    store.drop()
    assert plan.count("Exchange hashpartitioning") == 1


def test_equal_votes_are_dealt_row_by_row(spark):
    votes = votes_df(spark, [(1, 5, 1)] * 3000 + [(2, 6, 0)] * 3)
    out = rb.sparsify(votes, 2, hot_threshold=50)
    assert sorted((r.prompt_id, r.annotator_id) for r in out.collect()) == [(1, 5)] * 2 + [(2, 6)] * 2


def test_sweep_loses_votes_to_l_alone(spark):
    votes, truth = fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001)
    configs = [rb.Config(0, "Heatmap", 99, 0.1, 3), rb.Config(1, "Heatmap", 2, 0.1, 400), rb.Config(2, "Scale", 99, 0.0, 7)]
    pv, wt = rb.perturbed_votes(votes, truth, configs)
    n = votes.count()
    per = {r.config_id: r["count"] for r in pv.groupBy("config_id").count().collect()}
    two = votes.groupBy("prompt_id").count().agg(F.sum(F.least("count", F.lit(2)))).first()[0]
    assert per == {0: n, 1: two, 2: n}
    workers = {r.config_id: (r.n, r.hi) for r in pv.groupBy("config_id").agg(F.count_distinct("annotator_id").alias("n"), F.max("annotator_id").alias("hi")).collect()}
    assert workers[0] == (3, 2) and workers[2] == (7, 6) and workers[1][0] > 0.9 * 400 and workers[1][1] < 400
    assert wt.count() == sum(w[0] for w in workers.values()) and wt.filter("true_acc is null").isEmpty()


def test_sweep_converges_and_is_read_back(spark, tmp_path):
    from crowdtrust.plans.sweep import run_stress_sweep
    configs = [rb.Config(0, "Heatmap", 3, 0.05, 20), rb.Config(1, "Heatmap", 1, 0.05, 20), rb.Config(2, "Scale", 3, 0.1, 10)]
    rep = run_stress_sweep(fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001), configs, edge_cases=False, folder=f"file://{tmp_path}")
    rows = {r.config_id: r for r in rep.matrix.collect()}
    assert all(1 < r.iterations <= em.DEFAULT_MAX_ITER for r in rows.values()) and rows[1].iterations == 2  # one vote: the start is the fixed point
    back = {r.config_id: r.Error for r in spark.read.parquet(f"file://{tmp_path}/matrix").collect()}
    assert back == {k: r.Error for k, r in rows.items()}
