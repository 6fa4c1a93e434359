"""Preference-model runs.

Every run fits the same soft-label preference regression (T1) on the same
prompts and differs only in its label column:

* ``oracle``    – truth (one oracle vote per prompt, P5),
* ``baseline``  – hard crowd votes: the per-vote loss summed over a prompt
  equals n × the soft loss with label = share of A votes (weight n),
* ``static_em`` – γ of a converged EM fit, weight n (Q9),
* ``joint``     – each epoch: prior ← current model (D3), one warm EM step
  with α carried over (E8), refit on the new γ (T4).

Inputs are the oriented pairs (B2), their crowd votes (B3), hashed pair
features (K3) and the reference model's sequence log-probs as the offset
(D1 with the unweighted bigram model).  A fixed hash split keeps 20 % of
the prompts as the test set.  Metrics per run and epoch are one small
aggregate each (D11) and are written as ``<run>_metrics.csv`` (IO11).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtrust.functions.columns import softplus, unit_hash
from crowdtrust.operators import em
from crowdtrust.operators import models as md
from crowdtrust.operators import scoring as sc
from crowdtrust.operators import text as tx
from crowdtrust.operators.preference import DEFAULT_BETA, golden_accuracy
from crowdtrust.operators.prepare import orient_pairs
from crowdtrust.session import written
from crowdtrust.sources import fixtures as fx
from crowdtrust.sources.io import append_frames, write_table

TEST_SHARE = 0.2       # fixed split of the prompts held out for accuracy
NUM_FEATURES = 256     # hashed pair features (K3)
PER_TOKENS = 10        # log-probs are means over whole texts, times so many tokens: with β = 0.1 the offset is the difference per token
LENGTH_UNIT = 100.0    # the length difference is counted in hundreds of tokens
TRACKED = (0, 15, 29)  # annotators whose accuracy is listed per epoch


@dataclass
class PreferenceData:
    prompts: DataFrame   # (prompt_id, text_a, text_b, truth_is_a, ...)
    votes: DataFrame     # (prompt_id, annotator_id, vote) on train prompts
    truth: DataFrame     # (prompt_id, truth_is_a, is_test)
    features: DataFrame  # (prompt_id, phi, len_diff)
    ref: DataFrame       # (prompt_id, ref_a, ref_b)
    vocab: DataFrame     # (token, token_id) of the reference model
    vocab_size: int
    ref_model: DataFrame  # bigram log-probs of the reference model
    made: dict = field(default_factory=dict)  # tables that several runs read, written when the first does


def split_flag(seed: int = 42) -> F.Column:
    return unit_hash(F.concat_ws("|", F.lit(str(seed)), F.lit("split"), F.col("prompt_id").cast("string"))) \
        < F.lit(TEST_SHARE)


def preference_data(spark: SparkSession, sf_dir: str, num_features: int = NUM_FEATURES,
                    max_len: int | None = None) -> PreferenceData:
    """Whole texts and the whole vocabulary; ``max_len`` scores token ids cut
    and padded to that length instead, padding included (K1, Q14).  With
    ``num_features=0`` the length difference is the only feature."""
    prompts = written(orient_pairs(fx.pairs(spark, sf_dir)), "prompts")
    truth = prompts.select("prompt_id", "truth_is_a", split_flag().alias("is_test")).checkpoint(eager=True)
    votes = fx.pair_votes(truth.filter(~F.col("is_test"))).checkpoint(eager=True)  # from the narrow table, not from the texts
    vocab = tx.build_vocab(fx.read_table(spark, sf_dir, "documents"), ["text"], None)
    size = vocab.count() + tx.FIRST_WORD_ID
    big = written(tx.side_bigrams(prompts, vocab, size, max_len=max_len, include_pad=max_len is not None), "bigrams")
    ref_model = tx.bigram_model(big, None, size)
    ref_lp = tx.sequence_logps(big, ref_model, size, per_tokens=None if max_len else PER_TOKENS)
    ref = written(tx.side_logps(ref_lp, truth, "ref_a", "ref_b"), "ref_logps", ["prompt_id"])
    feats = tx.pair_features(prompts, num_features)
    # dealt by prompt once: of the joins of all runs, none exchanges a feature
    feats = written(feats.withColumn("len_diff", F.col("len_diff") / F.lit(LENGTH_UNIT)), "features", ["prompt_id"])
    return PreferenceData(prompts, votes, truth, feats, ref, vocab, size, ref_model)


def design(data: PreferenceData, labels: DataFrame, label_col: str, weight: DataFrame | None) -> DataFrame:
    """Training table for the train prompts that carry a label."""
    return md.training_table(data.features, data.ref, labels, label_col, weight)


def scoring_table(data: PreferenceData) -> DataFrame:
    """All prompts with features and offset (label unused, 0.5), written once."""
    if "scoring" not in data.made:
        lab = data.truth.select("prompt_id", F.lit(0.5).alias("label"))
        data.made["scoring"] = written(md.training_table(data.features, data.ref, lab, "label"), "scoring")
    return data.made["scoring"]


WIDE_FEATURES = 1 << 18  # hashed pair features of the wide fit


def wide_design(data: PreferenceData, labels: DataFrame, label_col: str, weight: DataFrame | None = None,
                num_features: int = WIDE_FEATURES) -> DataFrame:
    """Training table of the wide fit: sparse features of the whole
    vocabulary, each prompt's term differences scaled to length 1 (thousands
    of raw counts beside each other would leave the solver crawling)."""
    if num_features not in data.made:
        data.made[num_features] = written(tx.sparse_pair_features(data.prompts, num_features), "sparse_features", ["prompt_id"])
    feats = data.made[num_features].withColumn("len_diff", F.col("len_diff") / F.lit(LENGTH_UNIT))
    size = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))
    # as an array: named inside a lambda, the length would be added up again for every value
    feats = feats.withColumn("values", F.zip_with("values", F.array_repeat(size, F.size("values")), lambda x, s: x / s))
    return md.wide_training_table(feats, num_features, data.ref, labels, label_col, weight)


def scoring_pipeline(data: PreferenceData, model, num_features: int):
    """T5: all that turns raw pairs into the model's probability, as one saveable pipeline."""
    return sc.scoring_pipeline(sc.PairFeatures(numFeatures=num_features, lengthUnit=LENGTH_UNIT),
                               sc.ReferenceOffset(data.vocab, data.ref_model, data.vocab_size, PER_TOKENS), model)


def run_metrics(run: str, epoch: int, model, train: DataFrame, data: PreferenceData,
                beta: float = DEFAULT_BETA) -> DataFrame:
    """(run, epoch, train_loss, test_accuracy, test_reward_accuracy,
    reward_margin) in one job.

    train_loss = weighted mean soft loss on the train rows; test_accuracy =
    policy accuracy π_A > π_B (tie → B) on the held-out prompts (Q8, as the
    code does); test_reward_accuracy = r_A > r_B (D10, as the write-up says);
    reward_margin = mean β·z on the train rows."""
    lp = md.policy_logps_from_model(model, scoring_table(data), beta).checkpoint(eager=True)  # four numbers a prompt, read twice
    bz = F.col("beta_z")
    tr = lp.join(train.select("prompt_id", "label", "weight"), "prompt_id")
    loss = F.col("label") * softplus(-bz) + (1.0 - F.col("label")) * softplus(bz)
    a = tr.agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("train_loss"),
               F.avg(bz).alias("reward_margin"))
    te = lp.join(data.truth.filter("is_test"), "prompt_id")
    b = te.agg(F.avg(((F.col("pi_diff") > 0).cast("int") == F.col("truth_is_a")).cast("double"))
               .alias("test_accuracy"),
               F.avg(((bz > 0).cast("int") == F.col("truth_is_a")).cast("double")).alias("test_reward_accuracy"))
    return (a.crossJoin(b)  # two single-row aggregates
            .select(F.lit(run).alias("run"), F.lit(epoch).alias("epoch"), "train_loss", "test_accuracy",
                    "test_reward_accuracy", "reward_margin"))


@dataclass
class RunResult:
    metrics: DataFrame     # (run, epoch, train_loss, test_accuracy, reward_margin)
    models: dict           # run -> fitted GLM model
    trust: DataFrame       # γ of the static EM fit
    joint_trust: DataFrame | None
    joint_params: DataFrame | None
    frames: DataFrame | None = None   # (run, epoch, annotator_id, inferred_acc) of a joint run
    tracked: DataFrame | None = None  # (epoch, annotator_id, alpha) of the tracked annotators


def static_runs(data: PreferenceData, em_iter: int = em.DEFAULT_MAX_ITER, em_tol: float | None = em.DEFAULT_TOL,
                **fit) -> RunResult:
    """Oracle, baseline and static-EM fits (one epoch each: the GLM is full batch)."""
    share, n = md.baseline_labels(data.votes)
    res = em.fit(data.votes, "onecoin", max_iter=em_iter, tol=em_tol)
    trust = res.trust.checkpoint(eager=True)
    runs = {
        "oracle": design(data, data.truth.filter(~F.col("is_test")), "truth_is_a", None),
        "baseline": design(data, share, "share", n),
        "static_em": design(data, trust, "trust_weight", n),
    }
    models, rows = {}, []
    for name, train in runs.items():
        train = written(train, "train")
        models[name] = md.fit_preference_model(train, **fit)
        rows.append(run_metrics(name, 1, models[name], train, data))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return RunResult(out.checkpoint(eager=True), models, trust, None, None)


def joint_run(data: PreferenceData, epochs: int = 3, beta: float = DEFAULT_BETA, folder: str | None = None,
              tracked: tuple = TRACKED, **fit) -> RunResult:
    """T4: prior ← model; one warm E+M step (E8); refit on γ; per epoch the
    metrics, the golden accuracy of the prior (0.5 before the first model) on
    the train prompts, the accuracies of the tracked annotators and a frame of
    all of them.

    With ``folder`` the metrics are appended epoch by epoch (IO11), the frames
    by run and epoch (IO8), and γ and α at the end (IO7)."""
    spark = data.prompts.sparkSession
    _, n = md.baseline_labels(data.votes)
    score = scoring_table(data)
    train_truth = data.truth.filter(~F.col("is_test"))
    state, model = None, None
    rows, frames = [], []
    with em.build_store(data.votes, packed=True) as store:
        for epoch in range(1, epochs + 1):
            if model is None:
                prior = None
                golden = train_truth.agg(F.avg((F.lit(0) == F.col("truth_is_a")).cast("double")).alias("prior_accuracy"))
            else:
                prior = md.predict_prior(model, score).select("prompt_id", "prior").checkpoint(eager=True)
                golden = golden_accuracy(prior, train_truth).select(F.col("accuracy").alias("prior_accuracy"))
            res = em.fit(store, "onecoin", max_iter=1, tol=None, prior=prior, state=state)
            state = res.state
            gamma = res.trust.checkpoint(eager=True)
            train = written(design(data, gamma, "trust_weight", n), "train")
            model = md.fit_preference_model(train, **fit)
            m = run_metrics("joint", epoch, model, train, data, beta).crossJoin(golden)  # single-row aggregates
            rows.append(m.checkpoint(eager=True))
            frames.append(res.params.select(F.lit("joint").alias("run"), F.lit(epoch).alias("epoch"), "annotator_id",
                                            "inferred_acc").checkpoint(eager=True))
            if folder:
                write_table(rows[-1].drop("run"), f"{folder}/joint_metrics.csv", fmt="csv", mode="append")
                append_frames(frames[-1].withColumnRenamed("epoch", "iteration").drop("run"), f"{folder}/frames", "joint")
        params = res.params.checkpoint(eager=True)
    out, fr = rows[0], frames[0]
    for r, f in zip(rows[1:], frames[1:]):
        out, fr = out.unionByName(r), fr.unionByName(f)
    if folder:
        write_table(gamma, f"{folder}/joint_trust")
        write_table(params, f"{folder}/joint_params")
        gamma, params = spark.read.parquet(f"{folder}/joint_trust"), spark.read.parquet(f"{folder}/joint_params")
    track = fr.filter(F.col("annotator_id").isin(*tracked)).select("epoch", "annotator_id", F.col("inferred_acc").alias("alpha"))
    return RunResult(out, {"joint": model}, gamma, gamma, params, fr, track)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """IO11: one ``<run>_metrics.csv`` folder per run (header, all fields quoted); a row per epoch."""
    runs = [r["run"] for r in metrics.select("run").distinct().collect()]  # a handful of run names
    for run in runs:
        write_table(metrics.filter(F.col("run") == run).drop("run").coalesce(1), f"{folder}/{run}_metrics.csv",
                    fmt="csv")
