"""Preference scoring on log-prob tables.

Input is any table ``(prompt_id, pi_a, pi_b, ref_a, ref_b)`` of sequence
log-probs under the policy and the frozen reference model.  Everything is
column arithmetic plus averages: narrow, codegen'd, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtrust.functions.columns import sigmoid, softplus
from crowdtrust.operators.prepare import winner_loser

DEFAULT_BETA = 0.1  # fixed value: DPO temperature of the reference


def preference_logit(pi_a="pi_a", pi_b="pi_b", ref_a="ref_a", ref_b="ref_b") -> Column:
    """(π_A − π_B) − (ref_A − ref_B)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(pi_a) - c(pi_b)) - (c(ref_a) - c(ref_b))


def model_prior(logps: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """D3: P(A preferred) = σ(β·logit), once per prompt."""
    return logps.select("prompt_id", sigmoid(F.lit(beta) * preference_logit()).alias("prior"))


def hard_label_loss(votes: DataFrame, logps: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Per vote, −log σ(β·z_w) after orienting winner/loser by the vote."""
    j = winner_loser(votes.join(logps, "prompt_id"))
    z = preference_logit("pi_w", "pi_l", "ref_w", "ref_l")
    return j.select(*[c for c in votes.columns], softplus(-F.lit(beta) * z).alias("loss"))


def projected_loss(trust: DataFrame, logps: DataFrame, beta: float = DEFAULT_BETA,
                   trust_col: str = "trust_weight") -> DataFrame:
    """Per prompt, γ·L_A + (1−γ)·L_B with L_A = −log σ(βz), L_B = −log σ(−βz)."""
    j = trust.select("prompt_id", F.col(trust_col).alias("_g")).join(logps, "prompt_id")
    bz = F.lit(beta) * preference_logit()
    loss = F.col("_g") * softplus(-bz) + (1.0 - F.col("_g")) * softplus(bz)
    return j.select("prompt_id", F.col("_g").alias(trust_col), loss.alias("loss"))


def projected_loss_mean(trust: DataFrame, logps: DataFrame, votes: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """D5 as the reference's training objective: the vote does not change the
    per-prompt loss (swapping A/B and using 1−γ cancel out), it only weights
    each prompt by its number of votes."""
    n = votes.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"))
    pl = projected_loss(trust, logps, beta).join(n, "prompt_id")
    return pl.agg((F.sum(F.col("_n") * F.col("loss")) / F.sum("_n")).alias("projected_loss"),
                  F.sum("_n").cast("bigint").alias("n_votes"))


def oracle_loss(truth: DataFrame, logps: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Hard-label loss with vote = truth (one oracle vote per prompt)."""
    from crowdtrust.operators.prepare import oracle_votes
    return hard_label_loss(oracle_votes(truth), logps, beta)


def reward_margin(logps: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Mean implicit reward margin β·z."""
    return logps.agg(F.avg(F.lit(beta) * preference_logit()).alias("reward_margin"))


def golden_accuracy(prior: DataFrame, truth: DataFrame, col: str = "prior") -> DataFrame:
    """Mean of (prior > 0.5) == truth."""
    j = prior.join(truth, "prompt_id")
    return j.agg(F.avg(((F.col(col) > 0.5).cast("int") == F.col("truth_is_a")).cast("double")).alias("accuracy"))


def policy_accuracy(logps: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean of (π_A > π_B) == truth (tie → B), as the reference evaluates."""
    j = logps.join(truth, "prompt_id")
    return j.agg(F.avg(((F.col("pi_a") > F.col("pi_b")).cast("int") == F.col("truth_is_a")).cast("double"))
                 .alias("accuracy"))


def reward_accuracy(logps: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean of (r_A > r_B) == truth, i.e. sign of the preference logit."""
    j = logps.join(truth, "prompt_id")
    return j.agg(F.avg(((preference_logit() > 0).cast("int") == F.col("truth_is_a")).cast("double"))
                 .alias("accuracy"))
