"""Standalone EM run: read votes, fit to convergence, write
history, parameters, trust weights and per-iteration frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtrust.operators import em
from crowdtrust.operators.baselines import majority_vote
from crowdtrust.operators.prepare import hard_label
from crowdtrust.sources import fixtures as fx
from crowdtrust.sources.io import append_frames, write_table


def run_standalone_em(votes: DataFrame, worker_truth: DataFrame | None = None, out_dir: str | None = None,
                      model: str = "onecoin", max_iter: int = em.DEFAULT_MAX_ITER,
                      tol: float | None = em.DEFAULT_TOL, track_frames: bool = False,
                      prior_mode: str = "textbook", run_id: str = "standalone") -> em.EMResult:
    res = em.fit(votes, model, prior_mode=prior_mode, max_iter=max_iter, tol=tol,
                 worker_truth=worker_truth, track_frames=track_frames)
    if out_dir:
        write_table(res.history, f"{out_dir}/em_history")
        write_table(res.params, f"{out_dir}/inferred_params")
        write_table(res.trust, f"{out_dir}/trust_weights")
        if res.frames is not None:
            append_frames(res.frames, f"{out_dir}/tracking", run_id)
    return res


def trust_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: converged one-coin trust per prompt with its hard label, the
    majority-vote label and the number of votes."""
    votes = fx.votes(spark, sf_dir)
    res = em.fit(votes, "onecoin", worker_truth=fx.worker_truth(spark, sf_dir))
    maj = majority_vote(votes).select("prompt_id", "n_votes", F.col("label").alias("majority_label"))
    return (res.trust.join(maj, "prompt_id")
            .select("prompt_id", "trust_weight", hard_label("trust_weight").alias("hard_label"),
                    "majority_label", "n_votes"))
