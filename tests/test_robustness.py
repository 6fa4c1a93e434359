"""Robustness operators: salted top-k equals the direct ranking, roles and
perturbations keep whole tables, balanced assignment is balanced."""

from pyspark.sql import functions as F

from conftest import SF0001
from crowdtrust.operators import robustness as rb
from crowdtrust.sources import fixtures as fx


def test_sparsify_salted_hot_groups_equal_direct(spark):
    v = fx.votes(spark, SF0001)
    hot = spark.range(0, 3000).select(F.lit(99999999).cast("bigint").alias("prompt_id"),
                                      (F.col("id") % 10).alias("annotator_id"),
                                      (F.col("id") % 2).cast("int").alias("vote"))
    allv = v.unionByName(hot)
    direct = rb.sparsify(allv, 2).collect()
    salted = rb.sparsify(allv, 2, hot_threshold=50).collect()  # the hot prompt is split into 61 salts
    key = lambda r: (r["prompt_id"], r["annotator_id"], r["vote"])
    assert sorted(map(key, direct)) == sorted(map(key, salted))
    per = {}
    for r in salted:
        per[r["prompt_id"]] = per.get(r["prompt_id"], 0) + 1
    assert max(per.values()) == 2 and per[99999999] == 2


def test_corrupt_keeps_every_vote_and_rewrites_truth(spark):
    v = fx.votes(spark, SF0001)
    cv, wt = rb.corrupt(v, fx.worker_truth(spark, SF0001), 0.2)
    assert cv.count() == v.count()
    roles = wt.join(fx.worker_truth(spark, SF0001).withColumnRenamed("true_acc", "t0"), "annotator_id")
    flipped = roles.filter(F.abs(F.col("true_acc") - (1 - F.col("t0"))) < 1e-12).count()
    assert flipped >= 2  # floor(10 · 0.2) adversaries


def test_balanced_assignment(spark):
    a = rb.balanced_assignment(fx.truth(spark, SF0001), 3, 100)
    rep = rb.assignment_report(a).first()
    assert rep["n_edges"] == 3 * fx.truth(spark, SF0001).count()
    assert rep["max_tasks"] - rep["min_tasks"] <= 1 and rep["n_workers"] == 100
