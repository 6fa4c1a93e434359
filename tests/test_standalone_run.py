"""IO7/IO8: the standalone EM run writes history, parameters, trust and
per-iteration frames that read back whole."""

from pyspark.sql import functions as F

from conftest import SF0001
from crowdtrust.plans.standalone import run_standalone_em
from crowdtrust.session import scratch_path
from crowdtrust.sources import fixtures as fx


def test_standalone_run_writes_outputs(spark):
    out = scratch_path(spark, "standalone_test")
    res = run_standalone_em(fx.votes(spark, SF0001), fx.worker_truth(spark, SF0001), out_dir=out,
                            max_iter=4, tol=None, track_frames=True, run_id="t")
    hist = spark.read.parquet(f"{out}/em_history").orderBy("iteration").collect()
    assert [r["iteration"] for r in hist] == [1, 2, 3, 4]
    assert spark.read.parquet(f"{out}/trust_weights").count() == 1473
    params = spark.read.parquet(f"{out}/inferred_params")
    assert params.count() == 10 and params.filter(F.col("inferred_acc").isNull()).count() == 0
    frames = spark.read.parquet(f"{out}/tracking")
    assert frames.groupBy("run_id", "iteration").count().count() == 4
    last = {r["annotator_id"]: r["inferred_acc"] for r in frames.filter("iteration = 4").collect()}
    assert last == {r["annotator_id"]: r["inferred_acc"] for r in res.params.collect()}
