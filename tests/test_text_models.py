"""Bigrams, log-probs and pair features that do no work per word, context or feature over again."""

import pytest
from pyspark.sql import functions as F

from crowdtrust.operators import text as tx

PAIRS = [(1, "A b, a b!", "b"), (2, "", None), (3, " é-x zz é", "b a q r"), (4, "q q r q r", "zz a zz")]


def prompts(spark):
    return spark.createDataFrame(PAIRS, "prompt_id bigint, text_a string, text_b string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_meet_nothing_are_dealt_to_all_tasks(spark, monkeypatch):
    """In the joins with a vocabulary or contexts that are shuffled, rows without a key do not go to one task."""
    rows = spark.range(4000).select(F.col("id").alias("prompt_id"), F.lit("a").alias("side"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("prev_id"))
    for key in (tx.spread_key("word", ["prompt_id", "side"]), tx.spread_key("prev_id", ["prompt_id", "side"], number=True)):
        sizes = [r["count"] for r in rows.select(key.alias("k")).repartition(8, "k").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1000
    known = spark.createDataFrame([("x", 5)], "word string, prev_id bigint").withColumn("prompt_id", F.lit(1))
    assert known.select(tx.spread_key("word", ["prompt_id"]), tx.spread_key("prev_id", ["prompt_id"], number=True)).first() == ("x", 5)
    p, vocab = prompts(spark), spark.createDataFrame([("b", 2), ("a", 3), ("q", 4), ("é", 5), ("zz", 6)], "token string, token_id int")
    monkeypatch.setattr(tx, "BROADCAST_ROW_LIMIT", 4)
    big = tx.side_bigrams(p, vocab, 7)
    lp = tx.sequence_logps(big, tx.bigram_model(big, None, 7), 7)
    assert "xxhash64" in plan(big) and "xxhash64" in plan(lp)


@pytest.mark.parametrize("pad", [False, True])
def test_vocabulary_too_large_to_broadcast(spark, monkeypatch, pad):
    """The commonest words come by broadcast: bigrams of these are exchanged as ids alone, once; results are the same."""
    p, vocab = prompts(spark), spark.createDataFrame([("b", 2), ("a", 3), ("q", 4), ("é", 5), ("zz", 6)], "token string, token_id int")
    kw = {"max_len": 4, "include_pad": True} if pad else {}
    want = sorted(map(tuple, tx.side_bigrams(p, vocab, 7, **kw).collect()))
    monkeypatch.setattr(tx, "BROADCAST_ROW_LIMIT", 4)
    big = tx.side_bigrams(p, vocab, 7, **kw)
    assert sorted(map(tuple, big.collect())) == want and any(tx.UNK_ID in r[2:4] for r in want)
    joins = [x for x in plan(big).splitlines() if "Join" in x and "tok#" in x]
    assert sum("BroadcastHashJoin" in x for x in joins) >= 2


def test_contexts_meet_unseen_bigrams_alone(spark, monkeypatch):
    """A bigram that the model has seen is not exchanged by its context; unseen ones and unseen contexts score as they did."""
    rows = [(1, "a", 2, 3, 2), (1, "a", 2, 4, 1), (1, "a", 9, 9, 3), (1, "b", 2, 3, 1), (2, "a", 2, 8, 1), (2, "a", 2, 7, 4)]
    big = spark.createDataFrame(rows, "prompt_id bigint, side string, prev_id int, token_id int, cnt bigint")
    model = spark.createDataFrame([(2, 3, -1.0, -5.0), (2, 4, -2.0, -5.0)], "prev_id int, token_id int, logp double, unseen_logp double")
    unknown = -2.302585092994046
    want = {(1, "a"): -4.0 + 3 * unknown, (1, "b"): -1.0, (2, "a"): -25.0}
    for limit in (100, 0):
        monkeypatch.setattr(tx, "BROADCAST_ROW_LIMIT", limit)
        got = tx.sequence_logps(big, model, 10)
        text = got._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Aggregate [prompt_id") == 2  # added up below the join with the contexts, and above
        assert {(r.prompt_id, r.side): r.logp for r in got.collect()} == pytest.approx(want)
        mean = {(r.prompt_id, r.side): r.logp for r in tx.sequence_logps(big, model, 10, per_tokens=10).collect()}
        assert mean == pytest.approx({(1, "a"): want[1, "a"] / 6 * 10, (1, "b"): -10.0, (2, "a"): -50.0})


def test_logps_are_pivoted_in_one_pass(spark):
    lp = spark.createDataFrame([(1, "a", -1.0), (1, "b", -2.0), (3, "b", -4.0)], "prompt_id bigint, side string, logp double")
    got = tx.logps_table(lp, lp.withColumn("logp", F.col("logp") * 2), prompts(spark))
    assert {tuple(r) for r in got.collect()} == {(1, -1.0, -2.0, -2.0, -4.0), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.0, -4.0, 0.0, -8.0), (4, 0.0, 0.0, 0.0, 0.0)}
    assert plan(got).count("Join") <= 2
    assert {tuple(r) for r in tx.side_logps(lp, prompts(spark), "x", "y").filter("prompt_id < 3").collect()} == {(1, -1.0, -2.0), (2, 0.0, 0.0)}


def test_pair_features_are_counted_in_the_row(spark):
    """K3: no row per token, no exchange, no lookup per feature."""
    f = tx.pair_features(prompts(spark), 16)
    assert "Exchange" not in plan(f) and "Generate" not in plan(f)
    got = {r.prompt_id: (r.len_diff, r.phi) for r in f.collect()}
    wide = {r.prompt_id: r for r in tx.sparse_pair_features(prompts(spark), 16).collect()}
    for p, (diff, phi) in got.items():
        assert diff == wide[p].len_diff and len(phi) == 16
        assert {i: x for i, x in enumerate(phi) if x} == dict(zip(wide[p].indices, wide[p]["values"], strict=True))
    assert [len(r.phi) for r in tx.pair_features(prompts(spark), 0).collect()] == [0] * 4


def test_rows_under_one_id_share_their_features(spark):
    p = spark.createDataFrame([(1, "a b", "c"), (1, "a d", ""), (2, "a", ""), (None, "a", "b")], "prompt_id bigint, text_a string, text_b string")
    rows = {(r.prompt_id, r.len_diff): r.phi for r in tx.row_pair_features(p, 8).collect()}
    got = {(r.prompt_id, r.len_diff): r.phi for r in tx.pair_features(p, 8).collect()}
    both = [x + y for x, y in zip(rows[1, 1.0], rows[1, 2.0], strict=True)]
    assert got == {(1, 1.0): both, (1, 2.0): both, (2, 1.0): rows[2, 1.0], (None, 0.0): [0.0] * 8}
