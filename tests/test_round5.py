"""Tables that several runs read are made and dealt once; words, ranks and wide rows are not worked on again."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, votes_df
from crowdtrust.functions.columns import hash32
from crowdtrust.operators import models as md, robustness as rb, text as tx
from crowdtrust.operators.scoring import PairFeatures

CONFIGS = [rb.Config(0, "Heatmap", 1, 0.05, 20), rb.Config(1, "Heatmap", 3, 0.35, 20), rb.Config(2, "Scale", 5, 0.1, 7), rb.Config(3, "Scale", 2, 0.55, 400)]
PAIRS = [(1, "A b, a b!", "b"), (2, "", None), (3, " é-x zz é", "b a q r"), (4, "same zz", "zz same"), (None, "a", "b c")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listed(df):
    return sorted(map(str, df.collect()))


def test_perturbed_votes_are_unpacked_without_another_ranking(spark, monkeypatch):
    """Votes that are ranked and packed give the perturbed votes of any configuration; nulls, equal rows, truth missing or twice."""
    votes = votes_df(spark, [(p, (3 * p + k) % 11, (p + k) % 2) for p in range(30) for k in range(4)] * 2
                     + [(4, None, 1), (5, 2, None), (6, 1, None), (77, 3, None), (78, 8, None)])
    truth = spark.createDataFrame([(a, 0.6 + a / 64) for a in range(9)] + [(2, 0.875), (10, None)], "annotator_id bigint, true_acc double")
    want, want_truth = rb.perturbed_votes(votes, truth, CONFIGS)
    packed = rb.prompt_votes(votes, truth, 5)

    def ranked(*_):
        raise AssertionError("ranked again")
    monkeypatch.setattr(rb, "_ranked_votes", ranked)
    got, got_truth = rb.perturbed_votes(votes, truth, CONFIGS, packed=packed)
    assert got.columns == want.columns and got.dtypes == want.dtypes and listed(got) == listed(want)
    rounded = lambda df: df.select("config_id", "annotator_id", F.round("true_acc", 9))
    assert listed(rounded(got_truth)) == listed(rounded(want_truth))


def test_the_worst_configuration_is_not_ranked_again(spark, monkeypatch):
    from crowdtrust.queries import registry
    made, rank = [], rb._ranked_votes
    monkeypatch.setattr(rb, "_ranked_votes", lambda *a: made.append(a) or rank(*a))
    monkeypatch.setattr(registry, "_SWEEPS", {})
    assert registry.SPARK["r8_majority_vs_em_worst"](spark, SF0001).count() == 1 and len(made) == 1


@pytest.mark.parametrize("width", [5, 1 << 18])
def test_a_word_is_hashed_once(spark, width):
    """K3: buckets are those of ``hash32``, found without a hash per token."""
    p = spark.createDataFrame(PAIRS, "prompt_id bigint, text_a string, text_b string")
    tokens = tx.side_tokens(p.filter("prompt_id is not null"))
    signed = F.sum(F.when(F.col("side") == "a", 1.0).otherwise(-1.0)).alias("v")
    want = {(r.prompt_id, r.b): r.v for r in tokens.groupBy("prompt_id", F.pmod(hash32("token"), F.lit(width)).cast("int").alias("b")).agg(signed).collect() if r.v}
    sparse = tx.sparse_pair_features(p, width)
    assert "md5" not in plan(sparse)
    got = {r.prompt_id: (list(r.indices), list(r["values"]), r.len_diff) for r in sparse.collect()}
    assert {(i, b): v for i, (x, y, _) in got.items() if i is not None for b, v in zip(x, y, strict=True)} == want
    assert got[2] == ([], [], None) and got[4] == ([], [], 0.0) and len(got) == 5 and sum(got[None][1]) == -1.0
    if width < 100:
        dense = tx.row_pair_features(p, width)
        assert "md5" not in plan(dense)
        rows = {r.prompt_id: r.phi for r in dense.collect()}
        assert {(i, b): v for i, x in rows.items() for b, v in enumerate(x) if v} == want and rows[None] == [0.0] * width


def test_blocks_hold_all_rows(monkeypatch):
    """Rows without values, rows longer than a block, and batches without rows."""
    monkeypatch.setattr(md, "BLOCK_VALUES", 4)
    lists = [[3, 1], [], [5], [0, 1, 2, 3, 4, 5, 6], [], [2, 3, 4, 9], [7]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array([[x / 2 for x in r] for r in lists], pa.list_(pa.float64())),
                                        *(pa.array([i + k / 10 for i in range(len(lists))]) for k in range(3))], names=["indices", "values", "offset", "label", "weight"])
    for part, rows in ((batch, lists), (batch.slice(2, 3), lists[2:5]), (batch.slice(0, 0), []), (batch.slice(1, 1), [[]])):
        (out,) = md._blocks([part])
        got = {c: [np.frombuffer(x.as_buffer(), kind) for x in out.column(c)] for c, kind in md._BLOCK.items()}
        assert [n for x in got["size"] for n in x] == [len(r) for r in rows]
        assert [i for x in got["indices"] for i in x] == [i for r in rows for i in r] and [v for x in got["values"] for v in x] == [i / 2 for r in rows for i in r]
        assert [w for x in got["weight"] for w in x] == part.column("weight").to_pylist()
        assert all(x.sum() <= 4 or len(x) == 1 for x in got["size"])


def test_a_gradient_goes_to_the_driver_in_pieces(spark, monkeypatch):
    """A step sends no row per feature, and adds up a gradient per core, not per partition."""
    rows = spark.range(0, 400, 1, 40).select(F.array(F.col("id").cast("int"), F.lit(999)).alias("indices"), F.array(F.lit(1.0), F.lit(0.5)).alias("values"),
                                            F.lit(0.1).alias("offset"), (F.col("id") % 2).cast("double").alias("label"), F.lit(2.0).alias("weight"))
    frame, sent = type(rows), []
    to_arrow = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    monkeypatch.setattr(md, "GRADIENT_PIECE", 300)
    model = md.fit_wide_preference_model(rows, 1000, reg_param=1e-2)
    assert model.gradient <= 1e-6 and len(sent) > model.steps and {t.num_rows for t in sent} == {4}
    w = model.weights
    z = w[:400] + 0.5 * w[999] + 0.1
    error = (1 / (1 + np.exp(-z)) - np.arange(400) % 2) / 400
    assert np.abs(error + 1e-2 * w[:400]).max() < 1e-6 and abs(0.5 * error.sum() + 1e-2 * w[999]) < 1e-6 and not w[400:999].any()


def test_features_are_dealt_once_for_all_runs(spark):
    """The joins of a run exchange labels and weights, and no features; the scoring table is made once."""
    from crowdtrust.plans import joint as jt
    data = jt.preference_data(spark, SF0001, num_features=8)
    share, n = md.baseline_labels(data.votes)
    train = jt.design(data, share, "share", n)
    assert plan(train).count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan(train)
    assert train.count() == data.truth.filter("not is_test").count()
    assert jt.scoring_table(data) is jt.scoring_table(data)
    assert jt.scoring_table(data).count() == data.truth.count()


def test_pipeline_makes_features_once(spark):
    """T5: later stages read written features; texts are not taken apart for each of their passes."""
    p = spark.createDataFrame(PAIRS[:4], "prompt_id bigint, text_a string, text_b string")
    out = PairFeatures(numFeatures=4, lengthUnit=2.0).transform(p)
    assert "MapInArrow" not in plan(out) and out.columns == ["prompt_id", "text_a", "text_b", "features"]
    want = {r.prompt_id: [*r.phi, r.len_diff / 2] for r in tx.row_pair_features(p.filter("text_b is not null"), 4).collect()}
    assert {r.prompt_id: list(r.features) for r in out.filter("prompt_id <> 2").collect()} == want
