"""Registered check queries: a Spark callable and, where SQL can express it,
the equivalent DuckDB SQL over the pre-registered testdata views.

Doubles are rounded to 6 dp on both sides so the order-insensitive value
hash is stable under different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtrust.operators import baselines, em, metrics
from crowdtrust.operators.prepare import hard_label
from crowdtrust.operators.scoring import score_pairs
from crowdtrust.operators.votes import compact_votes, vote_profile, votes_per_task_histogram
from crowdtrust.queries import sql_fixtures as S
from crowdtrust.sources import fixtures as fx
from crowdtrust.session import written
from crowdtrust.sources.io import dense_ids

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

K = 5  # unrolled EM iterations of the oracle queries


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c) -> "F.Column":
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_FITS: dict = {}


def fitted(spark: SparkSession, sf: str, model: str = "onecoin", k: int = K, prior_mode: str = "textbook",
           with_prior: bool = False) -> em.EMResult:
    """EM fit with exactly ``k`` iterations, memoised per session and input."""
    key = (id(spark), sf, model, k, prior_mode, with_prior)
    if key not in _FITS:
        prior = model_prior(spark, sf) if with_prior else None
        _FITS[key] = em.fit(fx.votes(spark, sf), model, prior_mode=prior_mode, max_iter=k, tol=None,
                            prior=prior, worker_truth=fx.worker_truth(spark, sf))
    return _FITS[key]


def model_prior(spark: SparkSession, sf: str, beta: float = 0.1) -> DataFrame:
    from crowdtrust.operators import preference as pf
    lp = fx.logps(spark, sf)
    return pf.model_prior(lp, beta).select("prompt_id", F.col("prior"))


# ------------------------------------------------------------------ fixtures / votes
@register("b1_votes", S.with_(S.VOTES) + "SELECT prompt_id, annotator_id, vote FROM votes")
def q_votes(spark, sf):
    return fx.votes(spark, sf)


@register("b1_worker_truth", S.with_(S.WORKER_TRUTH) + "SELECT annotator_id, true_acc FROM worker_truth")
def q_worker_truth(spark, sf):
    return fx.worker_truth(spark, sf)


@register("b1_truth", S.with_(S.TRUTH) + "SELECT prompt_id, truth_is_a FROM truth")
def q_truth(spark, sf):
    return fx.truth(spark, sf)


@register("p8_vote_compaction", S.with_(S.VOTES, S.COMPACT) + "SELECT prompt_id, annotator_id, vote, n FROM v")
def q_compaction(spark, sf):
    return compact_votes(fx.votes(spark, sf))


@register("a10_vote_profile", S.with_(S.VOTES) + """
SELECT a.n_votes, a.sum_vote, b.n_prompts, b.min_votes_per_prompt, b.max_votes_per_prompt,
       c.n_annotators, c.min_tasks_per_annotator, c.max_tasks_per_annotator, d.repeated_pairs
FROM (SELECT count(*)::BIGINT AS n_votes, sum(vote)::BIGINT AS sum_vote FROM votes) a,
     (SELECT count(*)::BIGINT AS n_prompts, min(l)::BIGINT AS min_votes_per_prompt, max(l)::BIGINT AS max_votes_per_prompt
        FROM (SELECT prompt_id, count(*) AS l FROM votes GROUP BY prompt_id)) b,
     (SELECT count(*)::BIGINT AS n_annotators, min(r)::BIGINT AS min_tasks_per_annotator,
             max(r)::BIGINT AS max_tasks_per_annotator
        FROM (SELECT annotator_id, count(*) AS r FROM votes GROUP BY annotator_id)) c,
     (SELECT sum(c - 1)::BIGINT AS repeated_pairs
        FROM (SELECT prompt_id, annotator_id, count(*) AS c FROM votes GROUP BY ALL)) d""")
def q_profile(spark, sf):
    return vote_profile(fx.votes(spark, sf))


@register("a10_votes_per_task", S.with_(S.VOTES) + """
SELECT votes_per_prompt, count(*)::BIGINT AS n_prompts
FROM (SELECT prompt_id, count(*)::BIGINT AS votes_per_prompt FROM votes GROUP BY prompt_id)
GROUP BY votes_per_prompt""")
def q_votes_per_task(spark, sf):
    return votes_per_task_histogram(fx.votes(spark, sf))


# ------------------------------------------------------------------ E-step with saturated and unknown annotators
@register("e1_estep_saturated_unknown", S.with_(S.VOTES, S.COMPACT) + f"""
, al AS (SELECT annotator_id, {S.clip("CASE annotator_id % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0.8e0 ELSE 0.6e0 END", "1e-4", "1 - 1e-4")} AS alpha
         FROM (SELECT DISTINCT annotator_id FROM v)),
  s AS (SELECT prompt_id, sum(n * CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa,
               sum(n * CASE WHEN vote = 1 THEN ln(1 - alpha) ELSE ln(alpha) END) AS sb FROM v JOIN al USING (annotator_id) GROUP BY prompt_id)
SELECT prompt_id, round({S.posterior("ln(0.5e0) + sa", "ln(0.5e0) + sb")}, 6) AS trust_weight FROM s""")
def q_estep_edges(spark, sf):
    """E1 alone: accuracies of exactly 1 and 0, and every fourth annotator missing from the table."""
    m = F.pmod(F.col("annotator_id"), F.lit(4))
    alpha = fx.votes(spark, sf).select("annotator_id").distinct().filter(m < 3).select(
        "annotator_id", F.when(m == 0, 1.0).when(m == 1, 0.0).otherwise(0.8).alias("alpha"))
    return baselines.onecoin_e_step(fx.votes(spark, sf), alpha).select("prompt_id", r6("trust_weight").alias("trust_weight"))


@register("e2_standalone_m_step", S.with_(S.VOTES, S.COMPACT) + f"""
, s AS (SELECT prompt_id, sum(n * CASE WHEN vote = 1 THEN ln(0.7e0) ELSE ln(0.3e0) END) AS sa,
               sum(n * CASE WHEN vote = 1 THEN ln(0.3e0) ELSE ln(0.7e0) END) AS sb FROM v GROUP BY prompt_id),
  g AS (SELECT prompt_id, {S.posterior('ln(0.5e0) + sa', 'ln(0.5e0) + sb')} AS g FROM s)
SELECT annotator_id, round({S.clip('sum(n * CASE WHEN vote = 1 THEN g ELSE 1 - g END) / greatest(sum(n)::DOUBLE, 1e0)', '1e-4', '1 - 1e-4')}, 6) AS alpha
FROM v JOIN g USING (prompt_id) GROUP BY annotator_id""")
def q_standalone_m(spark, sf):
    """E2 alone: accuracies from the posteriors under one accuracy for all."""
    v = compact_votes(fx.votes(spark, sf))
    alpha = v.select("annotator_id").distinct().withColumn("alpha", F.lit(0.7))
    out = baselines.onecoin_m_step(v, baselines.onecoin_e_step(v, alpha))
    return out.select("annotator_id", r6("alpha").alias("alpha"))


@register("e4_e5_standalone_steps", S.with_(S.VOTES, S.COMPACT) + f"""
, s AS (SELECT prompt_id, sum(n * CASE WHEN vote = 1 THEN ln(0.8e0) ELSE ln(0.2e0) END) AS sa,
               sum(n * CASE WHEN vote = 1 THEN ln(0.35e0) ELSE ln(0.65e0) END) AS sb FROM v GROUP BY prompt_id),
  g AS (SELECT prompt_id, {S.posterior('ln(0.4e0) + sa', 'ln(0.6e0) + sb')} AS g FROM s)
SELECT annotator_id,
  round({S.clip('sum(CASE WHEN vote = 1 THEN n * g ELSE 0e0 END) / (sum(n * g) + 1e-6)', '1e-6', '1 - 1e-6')}, 6) AS alpha,
  round({S.clip('sum(CASE WHEN vote = 0 THEN n * (1 - g) ELSE 0e0 END) / (sum(n * (1 - g)) + 1e-6)', '1e-6', '1 - 1e-6')}, 6) AS beta,
  round((SELECT avg(g) FROM g), 6) AS pi1
FROM v JOIN g USING (prompt_id) GROUP BY annotator_id""")
def q_standalone_twocoin(spark, sf):
    """E4 and E5 alone: one two-coin E-step and M-step from given parameters."""
    v = compact_votes(fx.votes(spark, sf))
    params = v.select("annotator_id").distinct().select("annotator_id", F.lit(0.8).alias("alpha"), F.lit(0.65).alias("beta"))
    new, pi1 = baselines.twocoin_m_step(v, baselines.twocoin_e_step(v, params, 0.4))
    return new.crossJoin(pi1).select("annotator_id", *[r6(c).alias(c) for c in ("alpha", "beta", "pi1")])  # pi1 is one row


# ------------------------------------------------------------------ majority vote
_MAJ = """maj AS (
  SELECT prompt_id, count(*)::BIGINT AS n_votes, sum(vote)::BIGINT AS votes_a FROM votes GROUP BY prompt_id
)"""


@register("e10_majority_vote", S.with_(S.VOTES, _MAJ) + """
SELECT prompt_id, n_votes, round(votes_a / n_votes, 6) AS vote_share,
       (votes_a / n_votes > 0.5)::INT AS label, (votes_a * 2 = n_votes)::INT AS is_tie FROM maj""")
def q_majority(spark, sf):
    m = baselines.majority_vote(fx.votes(spark, sf))
    return m.select("prompt_id", "n_votes", r6("vote_share").alias("vote_share"), "label", "is_tie")


@register("m3_majority_accuracy", S.with_(S.VOTES, S.TRUTH, _MAJ) + """
SELECT round(avg(((votes_a / n_votes > 0.5)::INT = truth_is_a)::INT), 6) AS accuracy,
       count(*)::BIGINT AS n_prompts, sum((votes_a * 2 = n_votes)::INT)::BIGINT AS n_ties
FROM maj JOIN truth USING (prompt_id)""")
def q_majority_acc(spark, sf):
    m = baselines.majority_vote(fx.votes(spark, sf))
    j = m.join(fx.truth(spark, sf), "prompt_id")
    return j.agg(r6(F.avg((F.col("label") == F.col("truth_is_a")).cast("double"))).alias("accuracy"),
                 F.count(F.lit(1)).cast("bigint").alias("n_prompts"),
                 F.sum("is_tie").cast("bigint").alias("n_ties"))


# ------------------------------------------------------------------ one-coin EM (K unrolled)
_OC = S.with_(S.VOTES, S.COMPACT, S.WORKER_TRUTH, S.TRUTH, *S.onecoin_ctes(K))


@register("e1_onecoin_trust_k5", _OC + f"SELECT prompt_id, round(g, 6) AS trust_weight, (round(g, 6) > 0.5)::INT AS hard_label FROM g{K}")
def q_oc_trust(spark, sf):
    t = fitted(spark, sf).trust
    return t.select("prompt_id", r6("trust_weight").alias("trust_weight"), hard_label(r6("trust_weight")).alias("hard_label"))


@register("e2_onecoin_alpha_k5", _OC + f"SELECT annotator_id, round(alpha, 6) AS alpha FROM a{K}")
def q_oc_alpha(spark, sf):
    return fitted(spark, sf).params.select("annotator_id", r6("alpha").alias("alpha"))


@register("m5_onecoin_history_k5", _OC + S.onecoin_history(K))
def q_oc_history(spark, sf):
    h = fitted(spark, sf).history
    return h.select("iteration", r6("l1_parameter_loss").alias("l1_parameter_loss"),
                    r6("max_gamma_shift").alias("max_gamma_shift"))


@register("m5_onecoin_history_deltas_k5", _OC + f"""SELECT iteration, round(l1_parameter_loss, 6) AS l1_parameter_loss,
  round(l1_parameter_loss - lag(l1_parameter_loss) OVER (ORDER BY iteration), 6) AS l1_delta FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS iteration, (SELECT avg(abs(true_acc - alpha)) FROM worker_truth JOIN a{i} USING (annotator_id)) AS l1_parameter_loss"
    for i in range(1, K + 1)) + ")")
def q_oc_deltas(spark, sf):
    h = metrics.history_with_deltas(fitted(spark, sf).history)
    return h.select("iteration", r6("l1_parameter_loss").alias("l1_parameter_loss"), r6("l1_delta").alias("l1_delta"))


def em_loss_history_sql(k: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS iteration, round(l, 6) AS label_mse, round(w, 6) AS worker_mse, round(l + w, 6) AS em_loss FROM
  (SELECT (SELECT avg((g - truth_is_a) ** 2) FROM g{i} JOIN truth USING (prompt_id)) AS l,
          (SELECT avg((true_acc - alpha) ** 2) FROM a{i} JOIN worker_truth USING (annotator_id)) AS w)""" for i in range(1, k + 1))


_WATCHED: dict = {}


def watched(spark, sf):
    """A fit that also follows 𝓛_EM and the γ histogram of some iterations."""
    key = (id(spark), sf)
    if key not in _WATCHED:
        _WATCHED[key] = em.fit(fx.votes(spark, sf), "onecoin", max_iter=K, tol=None, worker_truth=fx.worker_truth(spark, sf),
                               truth=fx.truth(spark, sf), histogram_at=HISTOGRAM_AT)
    return _WATCHED[key]


HISTOGRAM_AT = (1, 2, K)  # iterations of the γ histogram


@register("m5_em_loss_history_k5", _OC + em_loss_history_sql(K))
def q_em_loss_history(spark, sf):
    """M5: the two parts of 𝓛_EM and their sum in every iteration."""
    return watched(spark, sf).history.select("iteration", *[r6(c).alias(c) for c in ("label_mse", "worker_mse", "em_loss")])


@register("m9_gamma_histogram_iterations", _OC + " UNION ALL ".join(
    f"SELECT {i} AS iteration, least(floor(round(g, 9) * 10), 9)::INT AS bin, count(*)::BIGINT AS n_prompts FROM g{i} GROUP BY ALL" for i in HISTOGRAM_AT))
def q_hist_iterations(spark, sf):
    """M9: γ in ten bins at chosen iterations."""
    return watched(spark, sf).gamma_histogram.select("iteration", "bin", "n_prompts")


@register("m1_onecoin_summary_k5", _OC + f"""
SELECT (SELECT round(avg(((g > 0.5)::INT = truth_is_a)::INT), 6) FROM g{K} JOIN truth USING (prompt_id)) AS accuracy,
       (SELECT round(avg(abs(true_acc - alpha)), 6) FROM a{K} JOIN worker_truth USING (annotator_id)) AS l1_parameter_loss""")
def q_oc_summary(spark, sf):
    f = fitted(spark, sf)
    acc = metrics.label_accuracy(f.trust, fx.truth(spark, sf)).select(r6("accuracy").alias("accuracy"))
    l1 = metrics.l1_parameter_loss(f.params, fx.worker_truth(spark, sf)).select(
        r6("l1_parameter_loss").alias("l1_parameter_loss"))
    return acc.withColumn("_k", F.lit(0)).join(l1.withColumn("_k", F.lit(0)), "_k").drop("_k")


@register("io13_dense_trust_k5", _OC + f"""
SELECT s.prompt_id, round(coalesce(g, 0.5e0), 6) AS trust_weight
FROM range(0, (SELECT max(prompt_id) + 1 FROM v)) s(prompt_id) LEFT JOIN g{K} USING (prompt_id)""")
def q_dense_trust(spark, sf):
    t = dense_ids(fitted(spark, sf).trust, "prompt_id", {"trust_weight": em.INIT_GAMMA})
    return t.select(F.col("prompt_id").cast("bigint"), r6("trust_weight").alias("trust_weight"))


@register("io13_dense_alpha_k5", _OC + f"""
SELECT s.annotator_id, round(coalesce(alpha, 1e-4), 6) AS alpha
FROM range(0, (SELECT max(annotator_id) + 1 FROM v)) s(annotator_id) LEFT JOIN a{K} USING (annotator_id)""")
def q_dense_alpha(spark, sf):
    p = fitted(spark, sf).params.select("annotator_id", "alpha")
    p = dense_ids(p, "annotator_id", {"alpha": em.ONECOIN_EPS})
    return p.select(F.col("annotator_id").cast("bigint"), r6("alpha").alias("alpha"))


@register("m8_worker_bands_k5", _OC + f"""
SELECT worker_type, count(*)::BIGINT AS n_annotators, round(avg(alpha), 6) AS mean_acc,
       round(stddev_samp(alpha), 6) AS std_acc, round(avg(true_acc), 6) AS mean_true_acc
FROM (SELECT alpha, true_acc,
             CASE WHEN true_acc >= 0.90 AND true_acc <= 1.00 THEN 'expert'
                  WHEN true_acc >= 0.65 AND true_acc <= 0.85 THEN 'average'
                  WHEN true_acc >= 0.45 AND true_acc <= 0.55 THEN 'spammer'
                  WHEN true_acc >= 0.00 AND true_acc <= 0.20 THEN 'adversary' ELSE 'other' END AS worker_type
      FROM a{K} JOIN worker_truth USING (annotator_id))
GROUP BY worker_type""")
def q_bands(spark, sf):
    b = metrics.worker_bands(fitted(spark, sf).params, fx.worker_truth(spark, sf))
    return b.select("worker_type", "n_annotators", r6("mean_acc").alias("mean_acc"), r6("std_acc").alias("std_acc"),
                    r6("mean_true_acc").alias("mean_true_acc"))


@register("m9_gamma_histogram_k5", _OC + f"""
SELECT least(floor(round(g, 9) * 10), 9)::INT AS bin, count(*)::BIGINT AS n_prompts FROM g{K} GROUP BY ALL""")
def q_hist(spark, sf):
    return metrics.gamma_histogram(fitted(spark, sf).trust, 10)


@register("m7_tracked_workers_k5", _OC + f"""
SELECT annotator_id, round(alpha, 6) AS alpha FROM a{K} WHERE annotator_id IN (0, 15, 48)""")
def q_tracked(spark, sf):
    p = fitted(spark, sf).params
    m = metrics.tracked_workers(p, [0, 15, 48], "alpha")  # fixed values: the tracked ids
    return m.select(F.explode("worker_acc").alias("annotator_id", "alpha")).select(
        "annotator_id", r6("alpha").alias("alpha"))


# ------------------------------------------------------------------ two-coin EM
def _tc(legacy: bool) -> str:
    return S.with_(S.VOTES, S.COMPACT, S.WORKER_TRUTH, S.TRUTH, *S.twocoin_ctes(K, legacy))


@register("e4_twocoin_trust_k5", _tc(False) + f"SELECT prompt_id, round(g, 6) AS trust_weight FROM g{K}")
def q_tc_trust(spark, sf):
    return fitted(spark, sf, "twocoin").trust.select("prompt_id", r6("trust_weight").alias("trust_weight"))


@register("e4_twocoin_legacy_trust_k5", _tc(True) + f"SELECT prompt_id, round(g, 6) AS trust_weight FROM g{K}")
def q_tc_legacy_trust(spark, sf):
    f = fitted(spark, sf, "twocoin", prior_mode="legacy")
    return f.trust.select("prompt_id", r6("trust_weight").alias("trust_weight"))


@register("e5_twocoin_params_k5", _tc(False) + f"""
SELECT annotator_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round((alpha + beta) / 2, 6) AS inferred_acc
FROM a{K}""")
def q_tc_params(spark, sf):
    p = fitted(spark, sf, "twocoin").params
    return p.select("annotator_id", r6("alpha").alias("alpha"), r6("beta").alias("beta"),
                    r6("inferred_acc").alias("inferred_acc"))


@register("m2_twocoin_summary_k5", _tc(False) + f"""
SELECT (SELECT round(avg(((g > 0.5)::INT = truth_is_a)::INT), 6) FROM g{K} JOIN truth USING (prompt_id)) AS accuracy,
       (SELECT round(avg(abs((alpha + beta) / 2 - true_acc)), 6) FROM a{K} JOIN worker_truth USING (annotator_id)) AS mae,
       (SELECT round(pi1, 6) FROM p{K}) AS pi1""")
def q_tc_summary(spark, sf):
    f = fitted(spark, sf, "twocoin")
    acc = metrics.label_accuracy(f.trust, fx.truth(spark, sf)).select(r6("accuracy").alias("accuracy"))
    mae = metrics.l1_parameter_loss(f.params, fx.worker_truth(spark, sf)).select(r6("l1_parameter_loss").alias("mae"))
    pi1 = f.history.filter(F.col("iteration") == K).select(r6("pi1").alias("pi1"))
    out = acc.withColumn("_k", F.lit(0)).join(mae.withColumn("_k", F.lit(0)), "_k")
    return out.join(pi1.withColumn("_k", F.lit(0)), "_k").drop("_k")


@register("m4_em_objective_k5", _tc(False) + f"""
SELECT round(label_mse, 6) AS label_mse, round(worker_mse, 6) AS worker_mse, round(label_mse + worker_mse, 6) AS em_loss
FROM (SELECT (SELECT avg((g - truth_is_a) * (g - truth_is_a)) FROM g{K} JOIN truth USING (prompt_id)) AS label_mse,
             (SELECT avg(((alpha + beta) / 2 - true_acc) * ((alpha + beta) / 2 - true_acc))
                FROM a{K} JOIN worker_truth USING (annotator_id)) AS worker_mse)""")
def q_objective(spark, sf):
    f = fitted(spark, sf, "twocoin")
    o = metrics.em_objective(f.trust, fx.truth(spark, sf), f.params, fx.worker_truth(spark, sf))
    return o.select(r6("label_mse").alias("label_mse"), r6("worker_mse").alias("worker_mse"),
                    r6("em_loss").alias("em_loss"))


# ------------------------------------------------------------------ known-worker vote, injected prior
@register("e11_known_worker_vote", S.with_(S.VOTES, S.COMPACT, S.WORKER_TRUTH) + f"""
, kw AS (SELECT annotator_id, {S.clip('true_acc', '1e-4', '1 - 1e-4')} AS alpha FROM worker_truth),
s AS (SELECT prompt_id, sum(n * CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa,
             sum(n * CASE WHEN vote = 1 THEN ln(1 - alpha) ELSE ln(alpha) END) AS sb
      FROM v JOIN kw USING (annotator_id) GROUP BY prompt_id)
SELECT prompt_id, round({S.posterior('ln(0.5e0) + sa', 'ln(0.5e0) + sb')}, 6) AS trust_weight,
       (round({S.posterior('ln(0.5e0) + sa', 'ln(0.5e0) + sb')}, 6) > 0.5)::INT AS label FROM s""")
def q_known_worker(spark, sf):
    k = baselines.known_worker_vote(fx.votes(spark, sf), fx.worker_truth(spark, sf))
    return k.select("prompt_id", r6("trust_weight").alias("trust_weight"),
                    hard_label(r6("trust_weight")).alias("label"))


_PRIOR = f"""pr AS MATERIALIZED (
  SELECT prompt_id, 1 / (1 + exp(-0.1e0 * ((pi_a - pi_b) - (ref_a - ref_b)))) AS prior FROM logps
)"""


@register("e7_prior_injection_k3", S.with_(S.VOTES, S.COMPACT, S.LOGPS, _PRIOR, *S.onecoin_ctes(3, prior_cte="pr"))
          + "SELECT prompt_id, round(g, 6) AS trust_weight FROM g3")
def q_prior_injection(spark, sf):
    f = fitted(spark, sf, k=3, with_prior=True)
    return f.trust.select("prompt_id", r6("trust_weight").alias("trust_weight"))


# ------------------------------------------------------------------ preference algebra
from crowdtrust.operators import preference as pf  # noqa: E402
from crowdtrust.operators import prepare as pp  # noqa: E402


@register("d2_preference_logit", S.with_(S.LOGPS) + f"SELECT prompt_id, round({S.LOGIT}, 6) AS logit FROM logps")
def q_logit(spark, sf):
    lp = fx.logps(spark, sf)
    return lp.select("prompt_id", r6(pf.preference_logit()).alias("logit"))


@register("d3_model_prior", S.with_(S.LOGPS) + f"SELECT prompt_id, round(1 / (1 + exp(-0.1e0 * {S.LOGIT})), 6) AS prior FROM logps")
def q_prior(spark, sf):
    return pf.model_prior(fx.logps(spark, sf)).select("prompt_id", r6("prior").alias("prior"))


_WL = """wl AS (SELECT vt.prompt_id, vt.annotator_id, vt.vote,
         CASE WHEN vote = 1 THEN (pi_a - pi_b) - (ref_a - ref_b) ELSE (pi_b - pi_a) - (ref_b - ref_a) END AS zw
  FROM votes vt JOIN logps USING (prompt_id))"""


@register("d4_hard_label_loss", S.with_(S.VOTES, S.LOGPS, _WL) + f"""
SELECT round(avg({S.softplus('-0.1e0 * zw')}), 6) AS mean_loss, count(*)::BIGINT AS n_votes FROM wl""")
def q_hard_loss(spark, sf):
    l = pf.hard_label_loss(fx.votes(spark, sf), fx.logps(spark, sf))
    return l.agg(r6(F.avg("loss")).alias("mean_loss"), F.count(F.lit(1)).cast("bigint").alias("n_votes"))


@register("d5_projected_loss_k5", _OC.rstrip() + ",\n" + S.LOGPS + f"""
, pl AS (SELECT prompt_id, g * {S.softplus(f'-0.1e0 * {S.LOGIT}')} + (1 - g) * {S.softplus(f'0.1e0 * {S.LOGIT}')} AS loss
         FROM g{K} JOIN logps USING (prompt_id)),
  nv AS (SELECT prompt_id, count(*) AS n FROM votes GROUP BY prompt_id)
SELECT round(sum(n * loss) / sum(n), 6) AS projected_loss, sum(n)::BIGINT AS n_votes FROM pl JOIN nv USING (prompt_id)""")
def q_proj_loss(spark, sf):
    f = fitted(spark, sf)
    out = pf.projected_loss_mean(f.trust, fx.logps(spark, sf), fx.votes(spark, sf))
    return out.select(r6("projected_loss").alias("projected_loss"), "n_votes")


@register("d5_projected_loss_per_prompt_k5", _OC.rstrip() + ",\n" + S.LOGPS + f"""
SELECT prompt_id, round(g * {S.softplus(f'-0.1e0 * {S.LOGIT}')} + (1 - g) * {S.softplus(f'0.1e0 * {S.LOGIT}')}, 6) AS loss
FROM g{K} JOIN logps USING (prompt_id)""")
def q_proj_loss_pp(spark, sf):
    pl = pf.projected_loss(fitted(spark, sf).trust, fx.logps(spark, sf))
    return pl.select("prompt_id", r6("loss").alias("loss"))


@register("d6_oracle_loss", S.with_(S.TRUTH, S.LOGPS) + f"""
SELECT round(avg({S.softplus('-0.1e0 * CASE WHEN truth_is_a = 1 THEN (pi_a - pi_b) - (ref_a - ref_b) ELSE (pi_b - pi_a) - (ref_b - ref_a) END')}), 6) AS mean_loss,
       count(*)::BIGINT AS n_prompts
FROM truth JOIN logps USING (prompt_id)""")
def q_oracle_loss(spark, sf):
    l = pf.oracle_loss(fx.truth(spark, sf), fx.logps(spark, sf))
    return l.agg(r6(F.avg("loss")).alias("mean_loss"), F.count(F.lit(1)).cast("bigint").alias("n_prompts"))


@register("d7_reward_margin", S.with_(S.LOGPS) + f"SELECT round(avg(0.1e0 * {S.LOGIT}), 6) AS reward_margin FROM logps")
def q_margin(spark, sf):
    return pf.reward_margin(fx.logps(spark, sf)).select(r6("reward_margin").alias("reward_margin"))


@register("d8_golden_accuracy", S.with_(S.TRUTH, S.LOGPS) + f"""
SELECT round(avg(((1 / (1 + exp(-0.1e0 * {S.LOGIT})) > 0.5)::INT = truth_is_a)::INT), 6) AS accuracy
FROM logps JOIN truth USING (prompt_id)""")
def q_golden(spark, sf):
    pr = pf.model_prior(fx.logps(spark, sf))
    return pf.golden_accuracy(pr, fx.truth(spark, sf)).select(r6("accuracy").alias("accuracy"))


@register("d9_policy_accuracy", S.with_(S.TRUTH, S.LOGPS) + """
SELECT round(avg(((pi_a > pi_b)::INT = truth_is_a)::INT), 6) AS accuracy FROM logps JOIN truth USING (prompt_id)""")
def q_policy_acc(spark, sf):
    return pf.policy_accuracy(fx.logps(spark, sf), fx.truth(spark, sf)).select(r6("accuracy").alias("accuracy"))


@register("d10_reward_accuracy", S.with_(S.TRUTH, S.LOGPS) + f"""
SELECT round(avg((({S.LOGIT} > 0)::INT = truth_is_a)::INT), 6) AS accuracy FROM logps JOIN truth USING (prompt_id)""")
def q_reward_acc(spark, sf):
    return pf.reward_accuracy(fx.logps(spark, sf), fx.truth(spark, sf)).select(r6("accuracy").alias("accuracy"))


# ------------------------------------------------------------------ pairs, orientation, preparation
def _prompts(spark, sf):
    return pp.orient_pairs(fx.pairs(spark, sf))


@register("b2_pairs", S.with_(S.PAIRS) + """
SELECT prompt_id, chosen_id, rejected_id, lang, length(chosen)::BIGINT AS chosen_chars,
       length(rejected)::BIGINT AS rejected_chars FROM pairs""")
def q_pairs(spark, sf):
    p = fx.pairs(spark, sf)
    return p.select("prompt_id", "chosen_id", "rejected_id", "lang",
                    F.length("chosen").cast("bigint").alias("chosen_chars"),
                    F.length("rejected").cast("bigint").alias("rejected_chars"))


@register("p1_orientation", S.with_(S.PAIRS) + """
SELECT prompt_id, truth_is_a, length(text_a)::BIGINT AS a_chars, md5(text_b) AS b_md5 FROM prompts""")
def q_orient(spark, sf):
    p = _prompts(spark, sf)
    return p.select("prompt_id", "truth_is_a", F.length("text_a").cast("bigint").alias("a_chars"),
                    F.md5("text_b").alias("b_md5"))


@register("b3_pair_votes", S.with_(S.PAIRS, S.PAIR_VOTES) + "SELECT prompt_id, annotator_id, vote FROM pv")
def q_pair_votes(spark, sf):
    return fx.pair_votes(_prompts(spark, sf))


@register("p5_oracle_votes", S.with_(S.PAIRS) + """
SELECT prompt_id, 999::BIGINT AS annotator_id, truth_is_a AS vote FROM prompts""")
def q_oracle_votes(spark, sf):
    return pp.oracle_votes(_prompts(spark, sf))


@register("p2_seeded_sample_cap", S.with_(S.TRUTH) + f"""
SELECT prompt_id FROM truth ORDER BY {S.h("'42|shuffle|' || prompt_id::VARCHAR")}, prompt_id LIMIT 1000""")
def q_seeded(spark, sf):
    return pp.seeded_sample(fx.truth(spark, sf), "prompt_id", 1000).select("prompt_id")


@register("p2_seeded_half", S.with_(S.TRUTH) + f"""
SELECT prompt_id FROM truth ORDER BY {S.h("'7|shuffle|' || prompt_id::VARCHAR")}, prompt_id LIMIT (SELECT count(*) // 2 FROM truth)""")
def q_seeded_half(spark, sf):
    """P2 with a cap that grows with the table: half of it."""
    truth = fx.truth(spark, sf)
    return pp.seeded_sample(truth, "prompt_id", truth.count() // 2, seed=7).select("prompt_id")


@register("p3_dense_prompt_ids", """
SELECT o_orderkey::BIGINT AS o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS prompt_id
FROM orders""")
def q_dense_ids(spark, sf):
    o = fx.read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint"), "o_orderdate")
    return pp.sequential_prompt_ids(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "prompt_id")


@register("p3_dense_ids_with_payload", """
SELECT *, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS prompt_id FROM (
  SELECT o_orderkey::BIGINT AS o_orderkey, o_orderdate, o_orderpriority FROM orders)""")
def q_dense_ids_payload(spark, sf):
    o = fx.read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint"), "o_orderdate", "o_orderpriority")
    return pp.sequential_prompt_ids(o, ["o_orderdate", "o_orderkey"])


@register("p4_trim_with_text", S.with_(S.PAIRS) + """
SELECT prompt_id, length(text_a)::BIGINT AS a_chars FROM prompts
WHERE prompt_id < (7 * (((SELECT count(*) FROM prompts) * 3) // 7)) // 3""")
def q_trim_text(spark, sf):
    kept, _, _ = pp.regular_graph_trim(_prompts(spark, sf), 3, 7)
    return kept.select("prompt_id", F.length("text_a").cast("bigint").alias("a_chars"))


@register("p4_regular_graph_trim", S.with_(S.TRUTH) + """
SELECT prompt_id FROM (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i FROM truth)
WHERE i < (7 * (((SELECT count(*) FROM truth) * 3) // 7)) // 3""")
def q_trim(spark, sf):
    kept, _, _ = pp.regular_graph_trim(fx.truth(spark, sf), 3, 7)
    return kept.select("prompt_id")


@register("p6_annotator_accuracy", S.with_(S.VOTES, S.TRUTH) + """
SELECT annotator_id, count(*)::BIGINT AS n_votes, round(avg((vote = truth_is_a)::INT), 6) AS accuracy
FROM votes JOIN truth USING (prompt_id) GROUP BY annotator_id""")
def q_ann_acc(spark, sf):
    c = pp.vote_correctness(pp.validate_votes(fx.votes(spark, sf)), fx.truth(spark, sf))
    return c.groupBy("annotator_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_votes"),
                                         r6(F.avg("correct")).alias("accuracy"))


@register("p7_winner_loser", S.with_(S.VOTES, S.LOGPS, _WL) + """
SELECT prompt_id, count(*)::BIGINT AS n_votes, round(sum(zw), 6) AS sum_winner_logit FROM wl GROUP BY prompt_id""")
def q_winner_loser(spark, sf):
    j = pp.winner_loser(fx.votes(spark, sf).join(fx.logps(spark, sf), "prompt_id"))
    zw = pf.preference_logit("pi_w", "pi_l", "ref_w", "ref_l")
    return j.groupBy("prompt_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_votes"),
                                      r6(F.sum(zw)).alias("sum_winner_logit"))


@register("j1_votes_with_text", S.with_(S.PAIRS, S.PAIR_VOTES) + """
SELECT pv.prompt_id, pv.annotator_id, pv.vote, length(text_a)::BIGINT AS a_chars, length(text_b)::BIGINT AS b_chars
FROM pv JOIN prompts USING (prompt_id)""")
def q_votes_text(spark, sf):
    pr = _prompts(spark, sf)
    from crowdtrust.operators.text import votes_with_text
    j = votes_with_text(fx.pair_votes(pr), pr)
    return j.select("prompt_id", "annotator_id", "vote", F.length("text_a").cast("bigint").alias("a_chars"),
                    F.length("text_b").cast("bigint").alias("b_chars"))


@register("j1_orphan_votes", S.with_(S.VOTES, S.PAIRS) + """
SELECT prompt_id, annotator_id, vote FROM votes ANTI JOIN prompts USING (prompt_id)""")
def q_orphan_votes(spark, sf):
    """The votes on orders whose number no text pair has."""
    from crowdtrust.operators.text import orphan_votes
    return orphan_votes(fx.votes(spark, sf), _prompts(spark, sf)).select("prompt_id", "annotator_id", "vote")


# ------------------------------------------------------------------ text
from crowdtrust.operators import text as tx  # noqa: E402
from crowdtrust.plans import joint as jt  # noqa: E402
from crowdtrust.session import scratch_path  # noqa: E402
from crowdtrust.sources import io as cio  # noqa: E402

VOCAB = 1000


def _vocab(spark, sf):
    return tx.build_vocab(fx.read_table(spark, sf, "documents"), ["text"], VOCAB)


@register("k2_vocab", S.with_(S.vocab_cte(VOCAB)) + "SELECT token, token_id, count FROM vocab")
def q_vocab(spark, sf):
    return _vocab(spark, sf)


@register("k1_token_ids_pad128", S.with_(S.PAIRS, S.vocab_cte(VOCAB), S.SIDE_TOKENS) + """
, arr AS (SELECT prompt_id, side, list_resize(list(token_id ORDER BY pos), 128, 0) AS ids
          FROM sid WHERE pos < 128 GROUP BY prompt_id, side),
  ntok AS (SELECT prompt_id, side, count(*)::INT AS n FROM stok GROUP BY prompt_id, side)
SELECT p.prompt_id,
       array_to_string(coalesce(a.ids, list_resize([]::INT[], 128, 0)), ' ') AS ids_a,
       array_to_string(coalesce(b.ids, list_resize([]::INT[], 128, 0)), ' ') AS ids_b,
       coalesce(na.n, 0) AS n_tok_a, coalesce(nb.n, 0) AS n_tok_b
FROM prompts p
LEFT JOIN arr a ON a.prompt_id = p.prompt_id AND a.side = 'a'
LEFT JOIN arr b ON b.prompt_id = p.prompt_id AND b.side = 'b'
LEFT JOIN ntok na ON na.prompt_id = p.prompt_id AND na.side = 'a'
LEFT JOIN ntok nb ON nb.prompt_id = p.prompt_id AND nb.side = 'b'""")
def q_token_ids(spark, sf):
    t = tx.token_ids(_prompts(spark, sf), _vocab(spark, sf), VOCAB, 128)
    return t.select("prompt_id", F.array_join("ids_a", " ").alias("ids_a"), F.array_join("ids_b", " ").alias("ids_b"),
                    "n_tok_a", "n_tok_b")


@register("io5_token_tables", S.with_(S.PAIRS, S.PAIR_VOTES, S.vocab_cte(VOCAB), S.SIDE_TOKENS) + f"""
, arr AS (SELECT prompt_id, side, sum(token_id)::BIGINT AS ids FROM sid WHERE pos < 128 GROUP BY prompt_id, side),
  tok AS (SELECT p.prompt_id, truth_is_a, coalesce(a.ids, 0) AS sum_a, coalesce(b.ids, 0) AS sum_b,
                 ({S.h("'42|split|' || p.prompt_id::VARCHAR")} / 4294967296e0 < 0.2e0) AS is_test
          FROM prompts p LEFT JOIN arr a ON a.prompt_id = p.prompt_id AND a.side = 'a' LEFT JOIN arr b ON b.prompt_id = p.prompt_id AND b.side = 'b')
SELECT 'noisy' AS split, prompt_id, annotator_id, vote AS label, sum_a, sum_b FROM pv JOIN tok USING (prompt_id) WHERE NOT is_test
UNION ALL SELECT 'oracle', prompt_id, 999, truth_is_a, sum_a, sum_b FROM tok WHERE NOT is_test
UNION ALL SELECT 'test', prompt_id, 999, truth_is_a, sum_a, sum_b FROM tok WHERE is_test""")
def q_token_tables(spark, sf):
    """IO5: the token tables of noisy votes, oracle votes and the test split, written and read back."""
    prompts = _prompts(spark, sf).withColumn("is_test", jt.split_flag()).checkpoint(eager=True)
    ids = tx.token_ids(prompts, _vocab(spark, sf), VOCAB, 128).select("prompt_id", "ids_a", "ids_b").checkpoint(eager=True)
    train, test = prompts.filter("not is_test"), prompts.filter("is_test")
    folder = scratch_path(spark, "token_tables")
    for name, votes in (("noisy", fx.pair_votes(train)), ("oracle", pp.oracle_votes(train)), ("test", pp.oracle_votes(test))):
        cio.write_table(votes.join(ids, "prompt_id"), f"{folder}/split={name}")
    back = spark.read.parquet(folder)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select("split", "prompt_id", "annotator_id", F.col("vote").alias("label"), total("ids_a").alias("sum_a"), total("ids_b").alias("sum_b"))


@register("io1_pairs_first_200", S.with_(S.PAIRS) + """
SELECT md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, count(*)::BIGINT AS n FROM (
  SELECT chosen, rejected FROM pairs ORDER BY chosen, rejected LIMIT 200) GROUP BY ALL""")
def q_pairs_io(spark, sf):
    """IO1: pairs written as JSON lines and read back, the first 200 in text order."""
    path = scratch_path(spark, "pairs_json")
    cio.write_table(fx.pairs(spark, sf).select("chosen", "rejected"), path, fmt="json")
    p = cio.read_pairs(spark, path, fmt="json", first=200)
    return p.groupBy(F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5")).agg(F.count("*").cast("bigint").alias("n"))


@register("k1_token_counts_whole", S.with_(S.PAIRS, S.vocab_cte(VOCAB), S.SIDE_TOKENS) + """
SELECT prompt_id, side, count(*)::BIGINT AS n_tokens, sum(token_id)::BIGINT AS id_sum,
       sum((token_id = 1)::INT)::BIGINT AS n_unk
FROM sid GROUP BY prompt_id, side""")
def q_token_counts(spark, sf):
    st = tx._vocab_join(tx.side_tokens(_prompts(spark, sf)), _vocab(spark, sf), VOCAB)
    return st.groupBy("prompt_id", "side").agg(F.count(F.lit(1)).cast("bigint").alias("n_tokens"),
                                               F.sum("token_id").cast("bigint").alias("id_sum"),
                                               F.sum((F.col("token_id") == tx.UNK_ID).cast("int")).cast("bigint")
                                               .alias("n_unk"))


_PAIR_EM = ["pvc AS (SELECT prompt_id, annotator_id, vote, count(*)::BIGINT AS n FROM pv GROUP BY ALL)"] + \
    S.onecoin_ctes(K, votes_cte="pvc")

_BIGRAM_MODEL = f"""
, wb AS (SELECT prev_id, token_id, sum(cnt * CASE WHEN side = 'a' THEN g ELSE 1 - g END) AS c
         FROM big JOIN g{K} USING (prompt_id) GROUP BY prev_id, token_id),
  wctx AS (SELECT prev_id, sum(c) AS c_prev FROM wb GROUP BY prev_id),
  pol AS (SELECT prev_id, token_id, ln((c + 1) / (c_prev + {S.VOCAB_SIZE})) AS logp, ln(1 / (c_prev + {S.VOCAB_SIZE})) AS unseen
          FROM wb JOIN wctx USING (prev_id)),
  rb AS (SELECT prev_id, token_id, sum(cnt)::DOUBLE AS c FROM big GROUP BY prev_id, token_id),
  rctx AS (SELECT prev_id, sum(c) AS c_prev FROM rb GROUP BY prev_id),
  ref AS (SELECT prev_id, token_id, ln((c + 1) / (c_prev + {S.VOCAB_SIZE})) AS logp, ln(1 / (c_prev + {S.VOCAB_SIZE})) AS unseen
          FROM rb JOIN rctx USING (prev_id))"""


@register("t2_weighted_bigram_model", S.with_(S.PAIRS, S.PAIR_VOTES, *_PAIR_EM, S.vocab_cte(None), S.SIDE_TOKENS)
          + _BIGRAM_MODEL + "\nSELECT prev_id, token_id, round(logp, 6) AS logp FROM pol")
def q_bigram(spark, sf):
    m = _text_models(spark, sf)
    return m["pol"].select("prev_id", "token_id", r6("logp").alias("logp"))


_TEXT: dict = {}


def _text_models(spark, sf):
    key = (id(spark), sf)
    if key not in _TEXT:
        pr = _prompts(spark, sf)
        vocab = tx.build_vocab(fx.read_table(spark, sf, "documents"), ["text"], None)  # the whole vocabulary
        size = vocab.count() + tx.FIRST_WORD_ID
        trust = em.fit(fx.pair_votes(pr), "onecoin", max_iter=K, tol=None).trust.checkpoint(eager=True)
        big = written(tx.side_bigrams(pr, vocab, size), "bigrams")
        pol = tx.bigram_model(big, trust, size)
        ref = tx.bigram_model(big, None, size)
        _TEXT[key] = {"prompts": pr, "big": big, "pol": pol, "ref": ref, "trust": trust, "size": size}
    return _TEXT[key]


@register("d1_sequence_logps", S.with_(S.PAIRS, S.PAIR_VOTES, *_PAIR_EM, S.vocab_cte(None), S.SIDE_TOKENS)
          + _BIGRAM_MODEL + f"""
, ctxp AS (SELECT DISTINCT prev_id, unseen FROM pol), ctxr AS (SELECT DISTINCT prev_id, unseen FROM ref),
  sp AS (SELECT b.prompt_id, b.side, sum(b.cnt * coalesce(p.logp, c.unseen, -ln({S.VOCAB_SIZE}))) AS lp
         FROM big b LEFT JOIN pol p USING (prev_id, token_id) LEFT JOIN ctxp c USING (prev_id) GROUP BY ALL),
  sr AS (SELECT b.prompt_id, b.side, sum(b.cnt * coalesce(p.logp, c.unseen, -ln({S.VOCAB_SIZE}))) AS lp
         FROM big b LEFT JOIN ref p USING (prev_id, token_id) LEFT JOIN ctxr c USING (prev_id) GROUP BY ALL)
SELECT pr.prompt_id,
       round(coalesce((SELECT lp FROM sp WHERE sp.prompt_id = pr.prompt_id AND side = 'a'), 0), 6) AS pi_a,
       round(coalesce((SELECT lp FROM sp WHERE sp.prompt_id = pr.prompt_id AND side = 'b'), 0), 6) AS pi_b,
       round(coalesce((SELECT lp FROM sr WHERE sr.prompt_id = pr.prompt_id AND side = 'a'), 0), 6) AS ref_a,
       round(coalesce((SELECT lp FROM sr WHERE sr.prompt_id = pr.prompt_id AND side = 'b'), 0), 6) AS ref_b
FROM prompts pr""")
def q_seq_logps(spark, sf):
    m = _text_models(spark, sf)
    pol = tx.sequence_logps(m["big"], m["pol"], m["size"])
    ref = tx.sequence_logps(m["big"], m["ref"], m["size"])
    t = tx.logps_table(pol, ref, m["prompts"])
    return t.select("prompt_id", *[r6(c).alias(c) for c in ("pi_a", "pi_b", "ref_a", "ref_b")])


@register("k3_pair_features", S.with_(S.PAIRS) + f"""
, tk AS (SELECT prompt_id, 1e0 AS s, unnest({S.tokens_sql('text_a')}) AS token FROM prompts
         UNION ALL SELECT prompt_id, -1e0 AS s, unnest({S.tokens_sql('text_b')}) AS token FROM prompts),
  bk AS (SELECT prompt_id, {S.h('token')} % 64 AS bucket, sum(s) AS v FROM tk GROUP BY ALL),
  l1 AS (SELECT prompt_id, sum(abs(v)) AS l1_phi FROM bk GROUP BY prompt_id)
SELECT p.prompt_id, (len({S.tokens_sql('p.text_a')}) - len({S.tokens_sql('p.text_b')}))::DOUBLE AS len_diff,
       round(coalesce(l1.l1_phi, 0e0), 6) AS l1_phi
FROM prompts p LEFT JOIN l1 USING (prompt_id)""")
def q_pair_features(spark, sf):
    f = tx.pair_features(_prompts(spark, sf), 64)
    l1 = F.aggregate("phi", F.lit(0.0), lambda a, x: a + F.abs(x))
    return f.select("prompt_id", "len_diff", F.round(l1, 6).alias("l1_phi"))


WIDE = jt.WIDE_FEATURES
_WIDE_BUCKETS = f"""tk AS (SELECT prompt_id, 1e0 AS s, unnest({S.tokens_sql('text_a')}) AS token FROM prompts
         UNION ALL SELECT prompt_id, -1e0 AS s, unnest({S.tokens_sql('text_b')}) AS token FROM prompts),
  bk AS (SELECT * FROM (SELECT prompt_id, {S.h('token')} % {WIDE} AS bucket, sum(s) AS v FROM tk GROUP BY ALL) WHERE v <> 0)"""


@register("k3_sparse_pair_features", S.with_(S.PAIRS, _WIDE_BUCKETS) + f"""
SELECT p.prompt_id, (len({S.tokens_sql('p.text_a')}) - len({S.tokens_sql('p.text_b')}))::DOUBLE AS len_diff,
       count(bucket)::INT AS n_buckets, coalesce(sum(bucket), 0)::BIGINT AS sum_buckets, coalesce(sum(abs(v)), 0e0) AS l1_phi,
       coalesce(sum(bucket * v), 0e0) AS dot
FROM prompts p LEFT JOIN bk USING (prompt_id) GROUP BY ALL""")
def q_sparse_features(spark, sf):
    f = tx.sparse_pair_features(_prompts(spark, sf), WIDE)
    total = lambda c, start, f: F.aggregate(c, start, f)
    return f.select("prompt_id", "len_diff", F.size("indices").alias("n_buckets"),
                    total(F.col("indices"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_buckets"),
                    total(F.col("values"), F.lit(0.0), lambda a, x: a + F.abs(x)).alias("l1_phi"),
                    total(F.zip_with("indices", "values", lambda i, x: i * x), F.lit(0.0), lambda a, x: a + x).alias("dot"))


# ------------------------------------------------------------------ robustness
from crowdtrust.operators import robustness as rb  # noqa: E402
from crowdtrust.plans.sweep import run_stress_sweep  # noqa: E402


@register("r1_sparsify_l2", S.with_(S.VOTES) + f"""
SELECT prompt_id, annotator_id, vote FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {S.VOTE_ORDER}, annotator_id, vote) AS r FROM votes)
WHERE r <= 2""")
def q_sparsify(spark, sf):
    return rb.sparsify(fx.votes(spark, sf), 2).select("prompt_id", "annotator_id", "vote")


@register("r3_restrict_crowd_n50", S.with_(S.VOTES, S.RANKS) + """
SELECT prompt_id, annotator_id, vote FROM votes JOIN ranks USING (annotator_id) WHERE crowd_rank < 50""")
def q_restrict(spark, sf):
    return rb.restrict_crowd(fx.votes(spark, sf), 50).select("prompt_id", "annotator_id", "vote")


@register("r2_corrupt_adv15", S.with_(S.VOTES, S.RANKS, S.WORKER_TRUTH) + f"""
, rl AS (SELECT annotator_id, {S.role_sql('crowd_rank', 'n_total::DOUBLE', '0.15e0')} AS role FROM ranks)
SELECT prompt_id, annotator_id,
       (CASE WHEN role = 'adversary' THEN 1 - vote WHEN role = 'spammer' THEN {S.COIN} ELSE vote END)::INT AS vote
FROM votes JOIN rl USING (annotator_id)""")
def q_corrupt(spark, sf):
    v, _ = rb.corrupt(fx.votes(spark, sf), None, 0.15)
    return v


@register("r2_corrupt_truth_adv15", S.with_(S.VOTES, S.RANKS, S.WORKER_TRUTH) + f"""
, rl AS (SELECT annotator_id, {S.role_sql('crowd_rank', 'n_total::DOUBLE', '0.15e0')} AS role FROM ranks)
SELECT annotator_id, round(CASE WHEN role = 'adversary' THEN 1 - true_acc WHEN role = 'spammer' THEN 0.5e0
                          ELSE true_acc END, 6) AS true_acc
FROM worker_truth JOIN rl USING (annotator_id)""")
def q_corrupt_truth(spark, sf):
    _, wt = rb.corrupt(fx.votes(spark, sf), fx.worker_truth(spark, sf), 0.15)
    return wt.select("annotator_id", r6("true_acc").alias("true_acc"))


@register("r9_balanced_assignment", S.with_(S.TRUTH) + f"""
, st AS (SELECT prompt_id, slot, {S.h("concat_ws('|', '42|assign', prompt_id::VARCHAR, slot::VARCHAR)")} AS hh
         FROM truth, range(0, 3) s(slot)),
  a AS (SELECT prompt_id, slot, ((row_number() OVER (ORDER BY hh, prompt_id, slot) - 1) % 100)::BIGINT AS annotator_id
        FROM st)
SELECT prompt_id, slot, annotator_id,
       (row_number() OVER (PARTITION BY prompt_id, annotator_id ORDER BY slot) > 1)::INT AS collision FROM a""")
def q_assignment(spark, sf):
    a = rb.balanced_assignment(fx.truth(spark, sf), 3, 100)
    return a.select("prompt_id", "slot", F.col("annotator_id").cast("bigint"), "collision")


@register("r9_assignment_report", S.with_(S.TRUTH) + f"""
, st AS (SELECT prompt_id, slot, {S.h("concat_ws('|', '42|assign', prompt_id::VARCHAR, slot::VARCHAR)")} AS hh
         FROM truth, range(0, 3) s(slot)),
  a AS (SELECT prompt_id, slot, ((row_number() OVER (ORDER BY hh, prompt_id, slot) - 1) % 100) AS annotator_id FROM st),
  c AS (SELECT *, (row_number() OVER (PARTITION BY prompt_id, annotator_id ORDER BY slot) > 1)::INT AS collision FROM a)
SELECT (SELECT min(r) FROM (SELECT count(*) AS r FROM c GROUP BY annotator_id))::BIGINT AS min_tasks,
       (SELECT max(r) FROM (SELECT count(*) AS r FROM c GROUP BY annotator_id))::BIGINT AS max_tasks,
       (SELECT count(DISTINCT annotator_id) FROM c)::BIGINT AS n_workers,
       (SELECT sum(collision) FROM c)::BIGINT AS collisions, (SELECT count(*) FROM c)::BIGINT AS n_edges""")
def q_assignment_report(spark, sf):
    return rb.assignment_report(rb.balanced_assignment(fx.truth(spark, sf), 3, 100))


_SWEEPS: dict = {}


def _sweep(spark, sf):
    """The whole sweep with K iterations per configuration (the oracle unrolls
    them; convergence is the tests' matter)."""
    key = (id(spark), sf)
    if key not in _SWEEPS:
        _SWEEPS[key] = run_stress_sweep(fx.votes(spark, sf), fx.worker_truth(spark, sf), max_iter=K, tol=None)
    return _SWEEPS[key]


_SWEEP_SQL = S.with_(S.VOTES, S.RANKS, S.WORKER_TRUTH, S.TRUTH, S.RANKED_VOTES, *S.sweep_ctes("m", S.config_rows(rb.sweep_configs()), K))


def _points_sql(any_adv: bool) -> str:
    bad = f"Error > {rb.ERROR_THRESHOLD}e0"
    bad_l = f"{bad} AND N = {rb.BASE_N}" + ("" if any_adv else f" AND Adv = {rb.BASE_ADV}e0")
    return f"""SELECT coalesce(max(L) FILTER ({bad_l}), {rb.L_GRID[0]})::INT AS "edge_L",
       coalesce(min(Adv) FILTER ({bad} AND L = {rb.BASE_L} AND N = {rb.BASE_N}), {rb.ADV_GRID[-1]}e0)::DOUBLE AS "edge_Adv",
       coalesce(min(N) FILTER ({bad} AND variable_tested = 'Scale'), {rb.N_GRID[0]})::INT AS "edge_N" FROM mm"""


@register("r4_sweep_matrix", _SWEEP_SQL + 'SELECT variable_tested, L AS "L", Adv AS "Adv", N AS "N", round(Error, 6) AS "Error" FROM mm')
def q_sweep_matrix(spark, sf):
    m = _sweep(spark, sf).matrix
    return m.select("variable_tested", "L", "Adv", "N", r6("Error").alias("Error"))


@register("r5_failure_points", _SWEEP_SQL + _points_sql(False))
def q_failure(spark, sf):
    return rb.failure_points(_sweep(spark, sf).matrix)


@register("r5_failure_points_any_adv", _SWEEP_SQL + _points_sql(True))
def q_failure_any(spark, sf):
    return rb.failure_points(_sweep(spark, sf).matrix, any_adv=True)


@register("r6_heatmap", _SWEEP_SQL + "SELECT L AS \"L\", " + ", ".join(
    f'round(max(Error) FILTER (Adv = {a}e0), 6) AS "{round(a * 100)}%"' for a in rb.ADV_GRID)
    + " FROM mm WHERE variable_tested = 'Heatmap' GROUP BY L ORDER BY L DESC")
def q_heatmap(spark, sf):
    h = _sweep(spark, sf).heatmap
    return h.select("L", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in h.columns[1:]])


@register("r7_error_vs_n", _SWEEP_SQL + f"""SELECT N AS "N", round(Error, 6) AS "Error", (Error > {rb.ERROR_THRESHOLD}e0)::INT AS failed
FROM mm WHERE variable_tested = 'Scale' ORDER BY N""")
def q_error_n(spark, sf):
    return _sweep(spark, sf).error_vs_n.select("N", r6("Error").alias("Error"), "failed")


_GL, _GA, _GN = rb.GOLDEN
_EDGE_CONFIGS = f"""SELECT 0 AS config_id, 'a' AS variable_tested, "edge_L" AS L, {rb.BASE_ADV}e0 AS Adv, {rb.BASE_N} AS N FROM points
  UNION ALL SELECT 1, 'b', {rb.BASE_L}, "edge_Adv", {rb.BASE_N} FROM points
  UNION ALL SELECT 2, 'c', {rb.BASE_L}, {rb.BASE_ADV}e0, "edge_N" FROM points
  UNION ALL SELECT 3, 'd', {_GL}, {_GA}e0, {_GN}"""
_EDGE_SQL = ",\n".join([_SWEEP_SQL.rstrip(), f"points AS MATERIALIZED ({_points_sql(False)})", *S.sweep_ctes("e", _EDGE_CONFIGS, K)])


@register("r10_edge_case_frames", _EDGE_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT config_id, {i}::INT AS iteration, annotator_id, round(alpha, 6) AS inferred_acc FROM ea{i}" for i in range(1, K + 1)))
def q_edge_frames(spark, sf):
    fr = _sweep(spark, sf).edge_frames
    return fr.select("config_id", F.col("iteration").cast("int"), "annotator_id", r6("inferred_acc").alias("inferred_acc"))


_WORST_SQL = ",\n".join([_SWEEP_SQL.rstrip(), f"""worst AS (
  SELECT config_id FROM mm WHERE variable_tested = 'Heatmap' AND L >= 3 ORDER BY round(Error, 6) DESC, config_id LIMIT 1),
maj AS (SELECT prompt_id, (avg(vote) > 0.5)::INT AS label FROM mw JOIN worst USING (config_id) GROUP BY prompt_id),
acc AS (SELECT (SELECT avg((label = truth_is_a)::INT) FROM maj JOIN truth USING (prompt_id)) AS ma,
               (SELECT avg(((round(g, 6) > 0.5)::INT = truth_is_a)::INT) FROM mg{K} JOIN worst USING (config_id) JOIN truth USING (prompt_id)) AS ea)"""])


@register("r8_majority_vs_em_worst", _WORST_SQL + "\nSELECT round(ma, 6) AS majority_accuracy, round(ea, 6) AS em_accuracy, round(ea - ma, 6) AS lift FROM acc")
def q_worst(spark, sf):
    """Majority vote vs EM on the configuration with the largest error among
    those with three or more votes per prompt (with one, EM is majority vote)."""
    sweep = _sweep(spark, sf)
    worst = rb.worst_config(sweep.matrix)
    pv, _ = rb.perturbed_votes(fx.votes(spark, sf), fx.worker_truth(spark, sf), [worst], packed=sweep.packed)
    pv = pv.drop("config_id")
    res = em.fit(pv, "onecoin", max_iter=K, tol=None)
    out = rb.majority_vs_em(pv, res.trust, fx.truth(spark, sf))
    return out.select(*[r6(c).alias(c) for c in ("majority_accuracy", "em_accuracy", "lift")])


# ------------------------------------------------------------------ model runs (T1, T3–T5, D11, IO8–IO11, M6, M10, M11)
from crowdtrust.operators import models as md  # noqa: E402

_RUNS: dict = {}
EPOCHS = 3
#: The models with one feature (the length difference) and no penalty, and K EM iterations: SQL can follow them.
_EXACT = {"reg_param": 0.0, "max_iter": 60, "tol": 1e-13}


def _runs(spark, sf, one_feature=False):
    key = (id(spark), sf, one_feature)
    if key not in _RUNS:
        data = jt.preference_data(spark, sf, num_features=0 if one_feature else jt.NUM_FEATURES)
        folder = scratch_path(spark, "run_metrics")
        if one_feature:
            static = jt.static_runs(data, em_iter=K, em_tol=None, **_EXACT)
            joint = jt.joint_run(data, epochs=EPOCHS, folder=folder, **_EXACT)
        else:
            static, joint = jt.static_runs(data), jt.joint_run(data, epochs=EPOCHS, folder=folder)
        jt.write_metrics(static.metrics, folder)
        _RUNS[key] = {"data": data, "static": static, "joint": joint, "folder": folder}
    return _RUNS[key]


def _metric_cols(df):
    return df.select("run", F.col("epoch").cast("int"), r6("train_loss").alias("train_loss"),
                     r6("test_accuracy").alias("test_accuracy"),
                     r6("test_reward_accuracy").alias("test_reward_accuracy"))


_ONE = S.with_(*S.one_feature_ctes(K, EPOCHS))


@register("t1_soft_label_fit")
def q_soft_fit(spark, sf):
    """The static-EM soft-label model's P(A preferred) for every prompt."""
    r = _runs(spark, sf)
    pred = md.predict_prior(r["static"].models["static_em"], jt.scoring_table(r["data"]))
    return pred.select("prompt_id", r6("prior").alias("p_a"))


@register("t1_one_feature_fit", _ONE + "SELECT prompt_id, round(1 / (1 + exp(-(w * x + o))), 6) AS p_a FROM f, tw")
def q_soft_fit_one(spark, sf):
    r = _runs(spark, sf, True)
    pred = md.predict_prior(r["static"].models["static_em"], jt.scoring_table(r["data"]))
    return pred.select("prompt_id", r6("prior").alias("p_a"))


_WIDE_FITS: dict = {}
WIDE_REG = 1e-2  # penalty of the wide fit, which has more features than prompts


def _wide_fit(spark, sf):
    """The static-EM fit on 2^18 hashed features: (data, training table, model)."""
    key = (id(spark), sf)
    if key not in _WIDE_FITS:
        r = _runs(spark, sf, True)
        data = r["data"]
        train = jt.wide_design(data, r["static"].trust, "trust_weight", md.baseline_labels(data.votes)[1])
        train = written(train, "wide_train")
        _WIDE_FITS[key] = (data, train, md.fit_wide_preference_model(train, WIDE + 1, reg_param=WIDE_REG))
    return _WIDE_FITS[key]


@register("t1_wide_fit")
def q_wide_fit(spark, sf):
    """T1 on 2^18 features: P(A preferred) for every prompt, unseen ones included."""
    data, _, model = _wide_fit(spark, sf)
    every = jt.wide_design(data, data.truth.select("prompt_id", F.lit(0.5).alias("label")), "label")
    return model.probability(every).select("prompt_id", F.round("p_a", 4).alias("p_a"))


@register("t1_wide_fit_is_minimum", _ONE + f""", {_WIDE_BUCKETS}
SELECT (SELECT count(*) FROM f WHERE NOT is_test)::BIGINT AS n_prompts,
       (SELECT count(DISTINCT bucket) FROM bk JOIN f USING (prompt_id) WHERE NOT is_test)::BIGINT AS n_features, 1 AS is_minimum""")
def q_wide_minimum(spark, sf):
    """At the wide fit's coefficients no feature's gradient is over 1e-5."""
    data, train, model = _wide_fit(spark, sf)
    g = md.loss_gradient(train, model, WIDE_REG)
    found = g.agg(F.count(F.when(F.col("index") < WIDE, 1)).alias("n_features"), (F.max(F.abs("gradient")) < 1e-5).cast("int").alias("is_minimum"))
    return train.agg(F.count(F.lit(1)).alias("n_prompts")).crossJoin(found)  # single-row aggregates


@register("t3_run_metrics")
def q_run_metrics(spark, sf):
    return _metric_cols(_runs(spark, sf)["static"].metrics)


@register("t3_one_feature_metrics", _ONE + """SELECT run, epoch, round(train_loss, 6) AS train_loss, round(test_accuracy, 6) AS test_accuracy,
  round(test_reward_accuracy, 6) AS test_reward_accuracy FROM runs WHERE run <> 'joint'""")
def q_run_metrics_one(spark, sf):
    return _metric_cols(_runs(spark, sf, True)["static"].metrics)


def _joint_cols(m):
    return m.select(F.col("epoch").cast("int"), *[r6(c).alias(c) for c in (
        "train_loss", "test_accuracy", "test_reward_accuracy", "reward_margin", "prior_accuracy")])


@register("t4_joint_history")
def q_joint(spark, sf):
    return _joint_cols(_runs(spark, sf)["joint"].metrics)


_GOLDEN_SQL = " UNION ALL ".join(
    [f"SELECT 1 AS epoch, (SELECT avg((truth_is_a = 0)::INT) FROM f WHERE NOT is_test) AS prior_accuracy"]
    + [f"SELECT {e}, (SELECT avg(((prior > 0.5)::INT = truth_is_a)::INT) FROM jp{e} JOIN f USING (prompt_id) WHERE NOT is_test)" for e in range(2, EPOCHS + 1)])


@register("t4_one_feature_joint", _ONE + f"""SELECT epoch, round(train_loss, 6) AS train_loss, round(test_accuracy, 6) AS test_accuracy,
  round(test_reward_accuracy, 6) AS test_reward_accuracy, round(reward_margin, 6) AS reward_margin, round(prior_accuracy, 6) AS prior_accuracy
FROM runs JOIN ({_GOLDEN_SQL}) USING (epoch) WHERE run = 'joint'""")
def q_joint_one(spark, sf):
    return _joint_cols(_runs(spark, sf, True)["joint"].metrics)


@register("t4_one_feature_frames", _ONE + " UNION ALL ".join(
    f"SELECT {e} AS epoch, annotator_id, round(alpha, 6) AS inferred_acc, (annotator_id IN {jt.TRACKED})::INT AS tracked FROM ja{e}"
    for e in range(1, EPOCHS + 1)))
def q_joint_frames(spark, sf):
    """T4: the frames of every epoch as read back from their table (IO8), the tracked annotators marked."""
    r = _runs(spark, sf, True)
    fr = spark.read.parquet(f"{r['folder']}/frames").filter("run_id = 'joint'")
    tracked = r["joint"].tracked.select("epoch", "annotator_id", F.lit(1).alias("t"))
    return (fr.select(F.col("iteration").cast("int").alias("epoch"), "annotator_id", "inferred_acc").join(tracked, ["epoch", "annotator_id"], "left")
            .select("epoch", "annotator_id", r6("inferred_acc").alias("inferred_acc"), F.coalesce("t", F.lit(0)).alias("tracked")))


def _inference(spark, sf, one_feature):
    r = _runs(spark, sf, one_feature)
    path = scratch_path(spark, "joint_model")
    md.save_model(r["joint"].models["joint"], path)
    test = jt.scoring_table(r["data"]).join(r["data"].truth.filter("is_test").select("prompt_id"), "prompt_id")
    out = md.load_and_score(path, test)
    return out.select("prompt_id", r6("p_a").alias("p_a"), (F.round("p_a", 6) > 0.5).cast("int").alias("prefers_a"))


@register("t5_batch_inference")
def q_inference(spark, sf):
    return _inference(spark, sf, False)


@register("t5_one_feature_inference", _ONE + f"""SELECT prompt_id, p_a, (p_a > 0.5)::INT AS prefers_a
FROM (SELECT prompt_id, round(1 / (1 + exp(-(w * x + o))), 6) AS p_a FROM f, j{EPOCHS}w WHERE is_test)""")
def q_inference_one(spark, sf):
    return _inference(spark, sf, True)


def _pipeline_scores(spark, sf, one_feature):
    r = _runs(spark, sf, one_feature)
    path = scratch_path(spark, "scoring_pipeline")
    jt.scoring_pipeline(r["data"], r["joint"].models["joint"], 0 if one_feature else jt.NUM_FEATURES).write().overwrite().save(path)
    raw = r["data"].prompts.join(r["data"].truth.filter("is_test").select("prompt_id"), "prompt_id", "left_semi").select("prompt_id", "text_a", "text_b")
    out = score_pairs(PipelineModel.load(path), raw)
    return out.select("prompt_id", r6("p_a").alias("p_a"), (F.round("p_a", 6) > 0.5).cast("int").alias("prefers_a"))


@register("t5_pipeline_raw_pairs")
def q_pipeline_scores(spark, sf):
    """T5: the saved pipeline scores the held-out pairs from their raw texts."""
    return _pipeline_scores(spark, sf, False)


@register("t5_one_feature_pipeline_raw_pairs", SQL["t5_one_feature_inference"])
def q_pipeline_scores_one(spark, sf):
    return _pipeline_scores(spark, sf, True)


def _comparison(spark, sf, one_feature):
    """IO11 written files → IO10 glob scan → M10 comparison with the oracle gap."""
    r = _runs(spark, sf, one_feature)
    scanned = cio.scan_metric_files(spark, f"{r['folder']}/*_metrics.csv")
    cmp = metrics.run_comparison(scanned)
    return cmp.select("run", "label", "epoch", r6("train_loss").alias("train_loss"),
                      r6("test_accuracy").alias("test_accuracy"), r6("oracle_gap").alias("oracle_gap"))


@register("m10_run_comparison")
def q_run_comparison(spark, sf):
    return _comparison(spark, sf, False)


@register("m10_one_feature_comparison", _ONE + """SELECT run, CASE run WHEN 'oracle' THEN 'Oracle' WHEN 'baseline' THEN 'Baseline'
    WHEN 'static_em' THEN 'Static EM' ELSE 'Joint EM' END AS label, m.epoch, round(train_loss, 6) AS train_loss,
  round(test_accuracy, 6) AS test_accuracy, round(oacc - test_accuracy, 6) AS oracle_gap
FROM runs m LEFT JOIN (SELECT epoch, test_accuracy AS oacc FROM runs WHERE run = 'oracle') o USING (epoch)""")
def q_run_comparison_one(spark, sf):
    return _comparison(spark, sf, True)


def _phases(spark, sf, one_feature):
    """One (phase, metric, value) row per reported number: the crowd, EM
    alone, the stress test's worst errors (along L at the lowest adversary
    share, along the share at the base L, along N, and over all), the worst
    configuration with and without EM, and the preference models."""
    r = _runs(spark, sf, one_feature)
    truth, votes = fx.truth(spark, sf), fx.votes(spark, sf)
    maj = baselines.majority_vote(votes).select("prompt_id", F.col("label").cast("double").alias("trust_weight"))
    f, m = fitted(spark, sf), _sweep(spark, sf).matrix
    worst = q_worst(spark, sf)
    heat = F.col("variable_tested") == "Heatmap"
    row = lambda df, phase, metric, col: df.select(F.lit(phase).alias("phase"), F.lit(metric).alias("metric"), F.col(col).alias("value"))
    rows = [
        row(metrics.label_accuracy(maj, truth), "1 crowd", "majority_accuracy", "accuracy"),
        row(metrics.label_accuracy(f.trust, truth), "2 em", "em_accuracy", "accuracy"),
        row(metrics.em_objective(f.trust, truth, f.params, fx.worker_truth(spark, sf)), "2 em", "em_loss", "em_loss"),
        *[row(m.filter(which).agg(F.max("Error").alias("e")), "3 stress", name, "e") for name, which in (
            ("worst_L_error", heat & (F.col("Adv") == rb.ADV_GRID[0])), ("worst_adversary_error", heat & (F.col("L") == rb.BASE_L)),
            ("worst_N_error", ~heat), ("worst_error", F.lit(True)))],
        row(worst, "4 robustness", "without_em_accuracy", "majority_accuracy"), row(worst, "4 robustness", "with_em_accuracy", "em_accuracy"),
        r["static"].metrics.unionByName(r["joint"].metrics.drop("prior_accuracy")).select(
            F.lit("5 models").alias("phase"), F.concat(F.col("run"), F.lit("_e"), F.col("epoch").cast("string"), F.lit("_test_accuracy")).alias("metric"),
            F.col("test_accuracy").alias("value"))]
    return metrics.phase_summary(rows).select("phase", "metric", r6("value").alias("value"))


@register("m11_phase_summary")
def q_phase_summary(spark, sf):
    return _phases(spark, sf, False)


_M11 = ",\n".join([_WORST_SQL, *S.one_feature_ctes(K, EPOCHS), S.COMPACT, *S.onecoin_ctes(K)])


@register("m11_one_feature_phase_summary", _M11 + f"""
SELECT phase, metric, round(value, 6) AS value FROM (
  SELECT '1 crowd' AS phase, 'majority_accuracy' AS metric, (SELECT avg((label = truth_is_a)::INT) FROM
    (SELECT prompt_id, (avg(vote) > 0.5)::INT AS label FROM votes GROUP BY prompt_id) JOIN truth USING (prompt_id)) AS value
  UNION ALL SELECT '2 em', 'em_accuracy', (SELECT avg(((g > 0.5)::INT = truth_is_a)::INT) FROM g{K} JOIN truth USING (prompt_id))
  UNION ALL SELECT '2 em', 'em_loss', (SELECT avg((g - truth_is_a) * (g - truth_is_a)) FROM g{K} JOIN truth USING (prompt_id))
    + (SELECT avg((alpha - true_acc) * (alpha - true_acc)) FROM a{K} JOIN worker_truth USING (annotator_id))
  UNION ALL SELECT '3 stress', 'worst_L_error', max(Error) FROM mm WHERE variable_tested = 'Heatmap' AND Adv = {rb.ADV_GRID[0]}e0
  UNION ALL SELECT '3 stress', 'worst_adversary_error', max(Error) FROM mm WHERE variable_tested = 'Heatmap' AND L = {rb.BASE_L}
  UNION ALL SELECT '3 stress', 'worst_N_error', max(Error) FROM mm WHERE variable_tested = 'Scale'
  UNION ALL SELECT '3 stress', 'worst_error', max(Error) FROM mm
  UNION ALL SELECT '4 robustness', 'without_em_accuracy', ma FROM acc
  UNION ALL SELECT '4 robustness', 'with_em_accuracy', ea FROM acc
  UNION ALL SELECT '5 models', run || '_e' || epoch || '_test_accuracy', test_accuracy FROM runs)""")
def q_phase_summary_one(spark, sf):
    return _phases(spark, sf, True)


@register("m6_scatter_frames_k5", _OC + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INT AS frame, annotator_id, round(alpha, 6) AS inferred_acc, true_acc FROM a{i} "
    f"JOIN worker_truth USING (annotator_id)" for i in range(1, K + 1)) + ")")
def q_scatter(spark, sf):
    """IO8 one CSV folder per iteration → IO9 natural-order scan → J8/M6 join by id."""
    res = em.fit(fx.votes(spark, sf), "onecoin", max_iter=K, tol=None, track_frames=True)
    folder = scratch_path(spark, "frames")
    fr = res.frames.checkpoint(eager=True)
    for i in range(1, K + 1):  # K small per-iteration tables, written as the reference's frame files
        cio.write_table(fr.filter(F.col("iteration") == i).drop("iteration").coalesce(1),
                        f"{folder}/frame_{i}.csv", fmt="csv")
    scanned = cio.scan_frames_natural(spark, folder, "frame_*.csv")
    sc = metrics.scatter_frames(scanned, fx.worker_truth(spark, sf))
    return sc.select(F.col("frame").cast("int"), "annotator_id", r6("inferred_acc").alias("inferred_acc"),
                     F.col("true_acc").cast("double"))


@register("io9_mixed_headers", _OC + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INT AS frame, annotator_id, round(alpha, 6) AS inferred_acc FROM a{i}" for i in range(1, K + 1)) + ")")
def q_mixed_frames(spark, sf):
    """IO9: frames whose headers differ in order and number of columns."""
    res = em.fit(fx.votes(spark, sf), "onecoin", max_iter=K, tol=None, track_frames=True)
    folder = scratch_path(spark, "mixed_frames")
    fr = res.frames.checkpoint(eager=True)
    headers = (["annotator_id", "inferred_acc"], ["inferred_acc", "annotator_id"], ["iteration", "inferred_acc", "annotator_id"])
    for i in range(1, K + 1):
        one = fr.filter(F.col("iteration") == i).select(*headers[i % 3])
        one.write.option("header", True).option("quoteAll", i % 2 == 0).csv(f"{folder}/frame_{i}.csv")
    return cio.scan_frames_natural(spark, folder, "frame_*.csv").select("frame", "annotator_id", r6("inferred_acc").alias("inferred_acc"))


_HISTORY_SQL = "h AS (" + S.onecoin_history(K) + ")"


@register("io10_mixed_headers", _OC + "SELECT * FROM (WITH " + _HISTORY_SQL + """
SELECT 'forward' AS run, iteration AS epoch, l1_parameter_loss AS train_loss, max_gamma_shift AS test_accuracy FROM h
UNION ALL SELECT 'reversed', iteration, l1_parameter_loss, max_gamma_shift FROM h
UNION ALL SELECT 'partial', iteration, l1_parameter_loss, NULL FROM h)""")
def q_mixed_metrics(spark, sf):
    """IO10: metric files with other column orders, one without accuracy, and
    one without epoch, which is left out (and read first)."""
    h = fitted(spark, sf).history.select(F.col("iteration").alias("epoch"), r6("l1_parameter_loss").alias("train_loss"),
                                         r6("max_gamma_shift").alias("test_accuracy")).checkpoint(eager=True)
    folder = scratch_path(spark, "mixed_metrics")
    files = {"forward": ["epoch", "train_loss", "test_accuracy"], "reversed": ["test_accuracy", "train_loss", "epoch"],
             "partial": ["train_loss", "epoch"], "a_without": ["train_loss", "test_accuracy"]}
    for run, cols in files.items():
        h.select(*cols, *([F.lit("x, y").alias("note")] if run == "reversed" else [])).coalesce(1).write.option("header", True).csv(f"{folder}/{run}_metrics.csv")
    return cio.scan_metric_files(spark, f"{folder}/*_metrics.csv")


@register("io8_partitioned_frames_k5", _OC + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'standalone' AS run_id, {i}::INT AS iteration, annotator_id, round(alpha, 6) AS inferred_acc FROM a{i}"
    for i in range(1, K + 1)) + ")")
def q_partitioned_frames(spark, sf):
    """IO8: frames appended to one table partitioned by (run_id, iteration), read back."""
    res = em.fit(fx.votes(spark, sf), "onecoin", max_iter=K, tol=None, track_frames=True)
    folder = scratch_path(spark, "tracking")
    cio.append_frames(res.frames, folder, "standalone")
    back = spark.read.parquet(folder)
    return back.select("run_id", F.col("iteration").cast("int"), "annotator_id",
                       r6("inferred_acc").alias("inferred_acc"))


# ------------------------------------------------------------------ streaming
from crowdtrust.streaming import trust as stm  # noqa: E402

EV_K = 5  # batch EM iterations that freeze the annotator accuracies of the stream

_EV_VOTES = """ev AS (SELECT event_id, ts, (event_id % 500)::BIGINT AS prompt_id, user_id::BIGINT AS annotator_id,
                      (value > 20)::INT AS vote FROM events),
evc AS (SELECT prompt_id, annotator_id, vote, count(*)::BIGINT AS n FROM ev GROUP BY ALL)"""
_EV_OC = S.with_(_EV_VOTES, *S.onecoin_ctes(EV_K + 1, votes_cte="evc"))


def _event_alpha(spark, sf):
    v = fx.event_votes(fx.read_table(spark, sf, "events")).select("prompt_id", "annotator_id", "vote")
    return em.fit(v, "onecoin", max_iter=EV_K, tol=None).params.select("annotator_id", "alpha").checkpoint(eager=True)


def _stream_trust(spark, sf):
    path = scratch_path(spark, "x1_trust")
    stream = stm.event_vote_stream(spark, sf, glob="events.parquet")
    stm.run_changelog(stm.stream_trust(stream, _event_alpha(spark, sf)), path)
    return stm.latest_rows(spark, path, ["prompt_id"])


@register("x1_stream_trust", _EV_OC + f"""
SELECT prompt_id, (SELECT count(*) FROM ev WHERE ev.prompt_id = g.prompt_id)::BIGINT AS n_votes,
       round(g, 6) AS trust_weight FROM g{EV_K + 1} g""")
def q_stream_trust(spark, sf):
    """Streaming E-step with frozen α equals the next batch E-step."""
    return _stream_trust(spark, sf).select("prompt_id", "n_votes", r6("trust_weight").alias("trust_weight"))


IDLE = "6 hours"  # a prompt without votes for so long is closed


@register("x1_closed_prompts", _EV_OC + f"""
, ordered AS (SELECT *, lag(ts) OVER (PARTITION BY prompt_id ORDER BY ts) AS before FROM ev),
  numbered AS (SELECT *, sum((before IS NULL OR ts > before + INTERVAL '{IDLE}')::INT) OVER (PARTITION BY prompt_id ORDER BY ts) AS session FROM ordered),
  sums AS (SELECT prompt_id, min(ts) AS opened, max(ts) + INTERVAL '{IDLE}' AS closed, count(*)::BIGINT AS n_votes,
                  sum(CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa, sum(CASE WHEN vote = 1 THEN ln(1 - alpha) ELSE ln(alpha) END) AS sb
           FROM numbered JOIN a{EV_K} USING (annotator_id) GROUP BY prompt_id, session)
SELECT prompt_id, epoch_us(opened)::BIGINT AS opened, n_votes, round({S.posterior("ln(0.5e0) + sa", "ln(0.5e0) + sb")}, 6) AS trust_weight
FROM sums WHERE closed <= (SELECT max(ts) FROM ev)""")
def q_closed_prompts(spark, sf):
    """X1 with bounded state: prompts that had no vote for six hours, emitted
    once each time they were closed."""
    path = scratch_path(spark, "x1_closed")
    stream = stm.event_vote_stream(spark, sf, glob="events.parquet")
    stm.run_changelog(stm.closed_trust(stream, _event_alpha(spark, sf), IDLE), path, output_mode="append")
    return spark.read.parquet(path).select("prompt_id", F.unix_micros("opened").alias("opened"), "n_votes", r6("trust_weight").alias("trust_weight"))


@register("x2_windowed_agreement", _EV_OC + f"""
, lab AS (SELECT prompt_id, (round(g, 6) > 0.5)::INT AS label FROM g{EV_K + 1})
SELECT annotator_id, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*)::BIGINT AS n_votes,
       sum((vote = label)::INT)::BIGINT AS n_agree, round(avg((vote = label)::INT), 6) AS agreement
FROM ev JOIN lab USING (prompt_id) GROUP BY ALL""")
def q_windowed_agreement(spark, sf):
    """Daily agreement of each annotator with the stream's trusted label."""
    labels = stm.trusted_labels(_stream_trust(spark, sf)).checkpoint(eager=True)
    path = scratch_path(spark, "x2_agreement")
    stream = stm.event_vote_stream(spark, sf, glob="events.parquet")
    stm.run_changelog(stm.windowed_agreement(stream, labels), path)
    out = stm.latest_rows(spark, path, ["annotator_id", "window_start"])
    return out.select("annotator_id", F.unix_timestamp("window_start").cast("bigint").alias("window_start"),
                      "n_votes", "n_agree", r6("agreement").alias("agreement"))


@register("x2_files_in_any_order", S.with_(_EV_VOTES) + """
SELECT annotator_id, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*)::BIGINT AS n_votes,
       sum((vote = prompt_id % 2)::INT)::BIGINT AS n_agree FROM ev GROUP BY ALL""")
def q_windowed_any_order(spark, sf):
    """X2 over four files, the newest first, a micro-batch each, with half of the events delivered twice."""
    folder = scratch_path(spark, "x2_events")
    ev = fx.read_table(spark, sf, "events").withColumn("q", F.expr("date_diff(date'2024-02-01', cast(ts as date)) div 8"))
    for q in range(5):
        ev.filter(F.least("q", F.lit(4)) == q).drop("q").write.parquet(f"{folder}/events_{q}.parquet")
    ev.filter("event_id % 2 = 0").drop("q").write.parquet(f"{folder}/events_again.parquet")
    labels = spark.range(500).select(F.col("id").alias("prompt_id"), (F.col("id") % 2).cast("int").alias("label"))
    path = scratch_path(spark, "x2_any_order")
    stream = stm.event_vote_stream(spark, f"{folder}/events_*.parquet", files_per_trigger=1, glob="part-*.parquet")
    stm.run_changelog(stm.windowed_agreement(stream, labels), path)
    out = stm.latest_rows(spark, path, ["annotator_id", "window_start"])
    return out.select("annotator_id", F.unix_timestamp("window_start").cast("bigint").alias("window_start"), "n_votes", "n_agree")


# ------------------------------------------------------------------ CSV round trips (IO2–IO4, IO6)
@register("io6_io3_prompts_csv_roundtrip", S.with_(S.PAIRS) + """
SELECT prompt_id, truth_is_a, length(text_a)::BIGINT AS a_chars, md5(text_a) AS a_md5, md5(text_b) AS b_md5
FROM prompts""")
def q_prompts_csv(spark, sf):
    """Prompts written as quoted CSV (IO6) and read back as multiLine CSV (IO3)."""
    path = scratch_path(spark, "prompts_csv")
    cio.write_table(_prompts(spark, sf).select("prompt_id", "text_a", "text_b", "truth_is_a"), path, fmt="csv")
    p = cio.read_prompts_csv(spark, path)
    return p.select("prompt_id", "truth_is_a", F.length("text_a").cast("bigint").alias("a_chars"),
                    F.md5("text_a").alias("a_md5"), F.md5("text_b").alias("b_md5"))


@register("io2_votes_csv_roundtrip", S.with_(S.VOTES) + "SELECT prompt_id, annotator_id, vote FROM votes")
def q_votes_csv(spark, sf):
    """Votes written as CSV (IO6) and read back with a fixed schema (IO2)."""
    path = scratch_path(spark, "votes_csv")
    cio.write_table(fx.votes(spark, sf), path, fmt="csv")
    return cio.read_votes(spark, path)


@register("io4_worker_truth_fallback", S.with_(S.WORKER_TRUTH) + "SELECT annotator_id, true_acc FROM worker_truth")
def q_worker_truth_fallback(spark, sf):
    """Worker truth written under the first-generation column name
    ``true_accuracy``; the reader skips a missing first path and renames (IO4)."""
    folder = scratch_path(spark, "true_params")
    cio.write_table(fx.worker_truth(spark, sf).withColumnRenamed("true_acc", "true_accuracy"),
                    f"{folder}/legacy/true_params.csv", fmt="csv")
    return cio.read_worker_truth(spark, [f"{folder}/current/03_true_params.csv", f"{folder}/legacy/true_params.csv"])
