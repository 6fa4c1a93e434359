"""Headline benchmark: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is forced with a ``noop`` write (full execution, no collect).
The EM fits are timed whole (store build + all iterations) and also
reported per iteration.  Memoised helpers of the check-query registry are
not used, so every query pays for its own work.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from crowdtrust.operators import baselines, em, metrics, preference as pf, text as tx  # noqa: E402
from crowdtrust.operators.votes import vote_profile  # noqa: E402
from crowdtrust.operators.prepare import orient_pairs  # noqa: E402
from crowdtrust.plans.sweep import run_stress_sweep  # noqa: E402
from crowdtrust.session import build_session, scratch_path  # noqa: E402
from crowdtrust.sources import fixtures as fx  # noqa: E402
from crowdtrust.streaming.trust import event_vote_stream, run_changelog, stream_trust  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="crowdtrust-bench")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    votes = fx.votes(spark, sf_dir)
    wt = fx.worker_truth(spark, sf_dir)
    truth = fx.truth(spark, sf_dir)

    timed("a10_vote_profile", lambda: force(vote_profile(votes)))
    timed("e10_majority_accuracy", lambda: force(metrics.label_accuracy(
        baselines.majority_vote(votes).select("prompt_id", F.col("label").cast("double").alias("trust_weight")),
        truth)))

    store = timed("p8_vote_store_build", lambda: em.build_store(votes))

    def onecoin():
        res = em.fit(store, "onecoin", worker_truth=wt)
        force(metrics.label_accuracy(res.trust, truth))
        return res
    res1 = timed("e3_onecoin_fit_converged", onecoin)
    it1 = max(res1.iterations.values())
    extra["onecoin_iterations"] = it1
    extra["sec_per_onecoin_iteration"] = round(times["e3_onecoin_fit_converged"] / it1, 3)

    def twocoin():
        res = em.fit(store, "twocoin", max_iter=15, tol=None, worker_truth=wt)
        force(res.trust)
        return res
    timed("e6_twocoin_fit_15", twocoin)
    extra["sec_per_twocoin_iteration"] = round(times["e6_twocoin_fit_15"] / 15, 3)

    lp = fx.logps(spark, sf_dir)

    def preference():
        force(pf.projected_loss_mean(res1.trust, lp, votes))
        force(pf.hard_label_loss(votes, lp))
        force(pf.policy_accuracy(lp, truth).crossJoin(pf.reward_accuracy(lp, truth)))
    timed("d4_d5_d9_preference_scoring", preference)

    def text_logps():
        prompts = orient_pairs(fx.pairs(spark, sf_dir)).checkpoint(eager=True)
        voc = tx.build_vocab(fx.read_table(spark, sf_dir, "documents"), ["text"], None).checkpoint(eager=True)
        size = voc.count() + tx.FIRST_WORD_ID
        trust = em.fit(fx.pair_votes(prompts), "onecoin").trust
        big = tx.side_bigrams(prompts, voc, size).checkpoint(eager=True)
        pol = tx.sequence_logps(big, tx.bigram_model(big, trust, size), size)
        ref = tx.sequence_logps(big, tx.bigram_model(big, None, size), size)
        force(tx.logps_table(pol, ref, prompts))
    timed("d1_t2_text_bigram_logps", text_logps)

    def stream():
        path = scratch_path(spark, "bench_x1")
        alpha = res1.params.select("annotator_id", "alpha")
        run_changelog(stream_trust(event_vote_stream(spark, sf_dir, glob="events.parquet"), alpha), path)
    timed("x1_stream_trust", stream)
    extra["x1_events_per_sec"] = round(fx.read_table(spark, sf_dir, "events").count() / times["x1_stream_trust"])

    if os.environ.get("BENCH_SWEEP", "1") == "1":
        def sweep():
            rep = run_stress_sweep(votes, wt, edge_cases=False)
            force(rep.heatmap)
            force(rep.error_vs_n)
        timed("r4_stress_sweep_29_configs", sweep)

    store.drop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
