"""The vote store's layouts: parameters routed to the votes, groups in
partition folders, values per prompt beside the votes."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from crowdtrust.functions.columns import gamma_bin
from crowdtrust.operators import em, votes as vt
from crowdtrust.sources import fixtures as fx


def random_votes(spark, n_prompts=200, n_ann=25):
    v = spark.range(n_prompts).select(F.col("id").alias("prompt_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    v = v.withColumn("annotator_id", F.pmod(F.xxhash64("prompt_id", "k"), F.lit(n_ann)))
    good = F.pmod(F.xxhash64("prompt_id", "annotator_id"), F.lit(10)) < F.when(F.col("annotator_id") % 4 == 0, 3).otherwise(8)
    return v.select("prompt_id", "annotator_id", F.when(good, F.pmod("prompt_id", F.lit(2))).otherwise(1 - F.pmod("prompt_id", F.lit(2))).cast("int").alias("vote"))


def with_hot(spark, v):
    hot = spark.range(600).select(F.lit(10 ** 6).cast("bigint").alias("prompt_id"), (F.col("id") % 25).alias("annotator_id"), (F.col("id") % 3 == 0).cast("int").alias("vote"))
    return v.unionByName(hot)


def exchanged_columns(df):
    """The columns of every exchange of a plan (not of broadcasts)."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"([A-Za-z_0-9]+)#", m)) for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def table(df, key, *cols):
    return {tuple(r[k] for k in key): tuple(r[c] for c in cols) for r in df.collect()}


def same(a, b, tol=1e-9):
    assert set(a) == set(b)
    assert all(x == pytest.approx(y, abs=tol) for k in a for x, y in zip(a[k], b[k], strict=True))


@pytest.mark.parametrize("model, hot", [("onecoin", 100), ("twocoin", None)])
def test_routed_parameters_equal_broadcast_ones(spark, monkeypatch, model, hot):
    v = with_hot(spark, random_votes(spark))
    prior = spark.range(150).select(F.col("id").alias("prompt_id"), (0.2 + (F.col("id") % 5) / 10).alias("prior"))
    kw = {"max_iter": 3, "tol": None, "num_buckets": 5, "hot_threshold": hot, "prior": prior}
    a = em.fit(v, model, **kw)
    ta, pa, ha = table(a.trust, ["prompt_id"], "trust_weight"), table(a.params, ["annotator_id"], "inferred_acc"), table(a.history, ["iteration"], "max_gamma_shift")
    monkeypatch.setattr(vt, "BROADCAST_ROW_LIMIT", 0)
    b = em.fit(v, model, **kw)
    same(ta, table(b.trust, ["prompt_id"], "trust_weight"))
    same(pa, table(b.params, ["annotator_id"], "inferred_acc"))
    same(ha, table(b.history, ["iteration"], "max_gamma_shift"))


@pytest.mark.parametrize("hot", [None, 100])
def test_no_votes_are_exchanged_in_a_step(spark, monkeypatch, hot):
    """Above the broadcast limit parameters are exchanged, per annotator and route; votes never."""
    monkeypatch.setattr(vt, "BROADCAST_ROW_LIMIT", 0)
    before = spark.conf.get(vt.ALL_KEYS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with em.build_store(with_hot(spark, random_votes(spark)), num_buckets=6, hot_threshold=hot) as store:
            assert store.routes is not None and (store.hot is None) == (hot is None)
            eng = em.EMEngine(store, em.make_model("twocoin"))
            moved = exchanged_columns(eng.step(eng.initial_state()))
            assert moved and not any({"vote", "n"} & cols for cols in moved)
            # each label fills one bucket: the votes of a bucket are one file
            files = store.cold.select(vt.BUCKET, F.col("_metadata.file_name").alias("f")).distinct()
            assert files.groupBy("f").count().agg(F.max("count")).first()[0] == 1
        assert spark.conf.get(vt.ALL_KEYS) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_that_converge_are_pruned(spark):
    """Groups freeze at different iterations; folders without an active group are not read any more, results equal single fits."""
    n_groups = 40
    v = spark.range(n_groups).select(F.col("id").alias("g"), F.explode(F.expr("sequence(0L, 19L)")).alias("prompt_id"))
    v = v.select("g", "prompt_id", F.explode(F.expr("sequence(0L, 6L)")).alias("annotator_id"))
    wrong = F.pmod(F.xxhash64("g", "prompt_id", "annotator_id"), F.lit(20)) < F.col("g") % 4
    v = v.withColumn("vote", F.when(wrong, 1 - F.pmod("prompt_id", F.lit(2))).otherwise(F.pmod("prompt_id", F.lit(2))).cast("int"))
    v = v.filter((F.col("g") >= 12) | (F.col("annotator_id") == F.pmod("prompt_id", F.lit(7))))  # one vote per prompt: the start is the fixed point
    res = em.fit(v, "onecoin", group_cols=["g"], track_frames=True, num_buckets=2)
    done = res.iterations
    assert len(done) == n_groups and len(set(done.values())) > 2
    frames = {r.g: r["count"] for r in res.frames.select("g", "iteration").distinct().groupBy("g").count().collect()}
    assert set(frames.values()) == {max(done.values())}
    trust = {}
    for r in res.trust.collect():
        trust.setdefault(r.g, {})[r.prompt_id] = r.trust_weight
    for g in (3, 15, 39):
        one = em.fit(v.filter(F.col("g") == g).drop("g"), "onecoin")
        assert one.iterations == {(0,): done[g,]}
        own = {r.prompt_id: r.trust_weight for r in one.trust.collect()}
        assert own == pytest.approx(trust[g], abs=1e-9)
    with em.build_store(v, ["g"], num_buckets=2) as store:
        pruned = store.pruned([1, 2])
        plan = pruned.cold.select("vote")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*_part", plan)
        assert 0 < pruned.cold.count() < store.cold.count()


def test_many_groups(spark):
    """10,000 configurations in the same jobs; nothing per group goes by the driver but what the caller asks for."""
    v = spark.range(10_000).select(F.col("id").alias("g"), F.explode(F.expr("sequence(0L, 5L)")).alias("prompt_id"))
    v = v.select("g", "prompt_id", F.explode(F.expr("sequence(0L, 2L)")).alias("annotator_id"))
    v = v.withColumn("vote", (F.pmod(F.xxhash64("g", "prompt_id", "annotator_id"), F.lit(4)) > 0).cast("int"))
    res = em.fit(v, "onecoin", group_cols=["g"], max_iter=3, num_buckets=4)
    h = res.history.groupBy("iteration").count().orderBy("iteration").collect()
    assert [r["count"] for r in h][0] == 10_000 and res.trust.count() == 60_000


def test_objective_and_histogram_ride_on_the_step(spark):
    v = with_hot(spark, random_votes(spark))
    truth = spark.range(180).select(F.col("id").alias("prompt_id"), F.pmod("id", F.lit(2)).cast("int").alias("truth_is_a"))
    wt = spark.range(25).select(F.col("id").alias("annotator_id"), F.lit(0.75).alias("true_acc"))
    for hot in (None, 100):
        res = em.fit(v, "onecoin", max_iter=3, tol=None, truth=truth, worker_truth=wt, histogram_at=[2, 3], bins=4, hot_threshold=hot)
        got = table(res.history, ["iteration"], "label_mse", "worker_mse", "em_loss")
        for it in (1, 2, 3):
            one = em.fit(v, "onecoin", max_iter=it, tol=None)
            lse = one.trust.join(truth, "prompt_id").agg(F.avg(F.pow(F.col("trust_weight") - F.col("truth_is_a"), 2))).first()[0]
            wse = one.params.join(wt, "annotator_id").agg(F.avg(F.pow(F.col("inferred_acc") - F.col("true_acc"), 2))).first()[0]
            assert got[it,] == pytest.approx((lse, wse, lse + wse), abs=1e-12)
            if it > 1:
                bins = {r.bin: r.n_prompts for r in res.gamma_histogram.filter(F.col("iteration") == it).collect()}
                own = {r.b: r["count"] for r in one.trust.groupBy(gamma_bin("trust_weight", 4).alias("b")).count().collect()}
                assert bins == own
        assert {r.iteration for r in res.gamma_histogram.collect()} == {2, 3}


def test_labels_add_no_exchange(spark):
    v, truth = fx.votes(spark, SF0001), fx.truth(spark, SF0001)
    with em.build_store(v) as store:
        plain = em.EMEngine(store, em.make_model("onecoin"))
        state = plain.initial_state()
        labels = store.per_prompt(truth.select("prompt_id", F.col("truth_is_a").cast("double")))
        watched = em.EMEngine(store, em.make_model("onecoin"), truth=labels)
        assert len(exchanged_columns(watched.step(state, 10))) == len(exchanged_columns(plain.step(state))) == 1
