"""EM over packed votes: the results of the row-wise steps, one exchange of votes, no row per vote in an iteration."""

import pytest
from pyspark.sql import functions as F

from conftest import votes_df
from crowdtrust.operators import em
from crowdtrust.operators.votes import VoteStore
from test_layout import exchanged_columns, random_votes, same, table, with_hot


def row_wise(monkeypatch):
    monkeypatch.setattr(VoteStore, "_build_packed", classmethod(lambda *_: None))


def odd_votes(spark):
    """Equal rows, votes, annotators and prompts that are null, an annotator of a null prompt alone, a hot prompt."""
    rows = [(p, (3 * p + k) % 11, (p + k) % 2) for p in range(30) for k in range(4)] * 2
    return votes_df(spark, rows + [(None, 3, 1), (None, 77, 0), (4, None, 1), (41, None, 1), (5, 2, None), (42, 6, None), (6, 1, None)]
                    + [(99, k % 11, int(k % 3 > 0)) for k in range(300)])


@pytest.mark.parametrize("model, mode, hot, prior", [("onecoin", "textbook", None, False), ("onecoin", "textbook", 100, True),
                                                     ("twocoin", "textbook", 100, True), ("twocoin", "legacy", None, True), ("twocoin", "legacy", 100, False)])
def test_packed_fit_equals_the_row_wise_one(spark, monkeypatch, model, mode, hot, prior):
    v = odd_votes(spark)
    p = spark.createDataFrame([(i, None if i % 7 == 0 else (i % 10) / 9) for i in range(25)] + [(99, 0.3)], "prompt_id bigint, prior double") if prior else None
    truth = spark.createDataFrame([(a, 0.6 + a / 50) for a in [*range(11), 2, 2]], "annotator_id bigint, true_acc double")
    kw = {"prior_mode": mode, "max_iter": 4, "tol": None, "hot_threshold": hot, "prior": p, "worker_truth": truth, "track_frames": True}
    measures = ["l1_parameter_loss", "max_gamma_shift"] + (["pi1"] if model == "twocoin" else [])

    def found():
        r = em.fit(v, model, **kw)
        return (table(r.trust, ["prompt_id"], "trust_weight"), table(r.params, ["annotator_id"], "inferred_acc"),
                table(r.history, ["iteration"], *measures), table(r.frames, ["iteration", "annotator_id"], "inferred_acc"))

    packed = found()
    row_wise(monkeypatch)
    for a, b in zip(packed, found(), strict=True):
        same(a, b)


def test_packing_takes_one_exchange(spark, monkeypatch):
    """The votes are compacted and packed where they arrive."""
    plans, write = [], VoteStore._write
    monkeypatch.setattr(VoteStore, "_write", lambda self, df, *a, **k: plans.append(exchanged_columns(df)) or write(self, df, *a, **k))
    em.build_store(random_votes(spark), packed=True).drop()
    assert len(plans) == 1 and len(plans[0]) == 1


def test_votes_are_exchanged_once_and_packed(spark):
    """A row per prompt is all that an iteration reads, a row per annotator all that it exchanges; a prior moves no vote."""
    v = with_hot(spark, random_votes(spark))
    with em.build_store(v, packed=True, num_buckets=6, hot_threshold=100) as store:
        assert store.packed.count() == 200 and store.hot.select("prompt_id").distinct().count() == 1
        want = v.groupBy("prompt_id", "annotator_id", "vote").count()
        assert sorted(map(tuple, store.rows().drop("_grp").collect())) == sorted(map(tuple, want.collect()))
        files = store.packed.select("prompt_id", F.col("_metadata.file_name").alias("f"))
        assert files.select("f").distinct().count() <= 6
    with em.build_store(random_votes(spark), packed=True) as store:
        prior = store.per_prompt(spark.range(200).select(F.col("id").alias("prompt_id"), F.lit(0.4).alias("prior")))
        for p in (None, prior):
            eng = em.EMEngine(store, em.make_model("twocoin"), p)
            moved = exchanged_columns(eng.step(eng.initial_state()))
            assert len(moved) == 1 and not {"votes", "vote", "annotators"} & moved[0]


def test_steps_may_go_on_from_a_state(spark, monkeypatch):
    """Warm steps on one packed store equal one fit; few votes, none at all."""
    v = random_votes(spark)
    with em.build_store(v, packed=True) as store:
        state = None
        for _ in range(3):
            res = em.fit(store, "onecoin", max_iter=1, tol=None, state=state)
            state = res.state
        got = table(res.trust, ["prompt_id"], "trust_weight"), table(res.params, ["annotator_id"], "alpha")
    want = em.fit(v, "onecoin", max_iter=3, tol=None)
    same(got[0], table(want.trust, ["prompt_id"], "trust_weight"))
    same(got[1], table(want.params, ["annotator_id"], "alpha"))
    none = em.fit(votes_df(spark, []), "onecoin", max_iter=2)
    assert none.trust.count() == none.params.count() == 0
