"""Robustness analysis.

The reference re-simulates a crowd for every grid point and fits EM on each
one after the other.  Here a *real* vote table is perturbed
deterministically – fewer votes per prompt (R1), a share of corrupted
annotators (R2), another crowd size over which the same votes are spread – for
every configuration at once: a vote is replicated for the configurations (a
small, fixed list) that take it, and one batched EM fit keyed by
``config_id`` (E12) scores all of them in the same jobs.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtrust.functions.columns import hash32, unit_hash
from crowdtrust.operators import em
from crowdtrust.operators.baselines import majority_vote
from crowdtrust.operators.prepare import dense_index, hard_label
from crowdtrust.operators.votes import BROADCAST_ROW_LIMIT, MIN_HOT_THRESHOLD
from crowdtrust.session import scratch_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not have the package on their path

# Fixed values of the reference sweep.
BASE_N, BASE_L, BASE_ADV = 400, 3, 0.10
ERROR_THRESHOLD = 0.15
L_GRID = (1, 2, 3, 5)
ADV_GRID = (0.05, 0.15, 0.25, 0.35, 0.45, 0.55)
N_GRID = (50, 100, 200, 400, 800)
CORRUPT_SHARE = 0.40          # spammers = max(0, 0.40 - adversaries)
GOLDEN = (5, 0.05, 200)       # (L, adv, N) of the golden-standard frame set


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vote_order(seed: int = 42) -> Column:
    """Deterministic random order of votes inside a prompt."""
    return hash32(F.concat_ws("|", F.lit(f"{seed}|sparse"), F.col("prompt_id").cast("string"),
                              F.col("annotator_id").cast("string"), F.col("vote").cast("string")))


def top_per_group(df: DataFrame, keys: list[str], order: list, limit_col: Column,
                  hot_threshold: int = MIN_HOT_THRESHOLD, rank_name: str | None = None) -> DataFrame:
    """Rows ranked ``<= limit_col`` inside each ``keys`` group (``rank_name``
    keeps the rank, from 1).

    Hot groups are first dealt, row by row, to ``ceil(count / threshold)``
    salted sub-groups: each sub-group keeps its own top rows, then only those
    candidates are ranked per group.  No group – however large – is sorted
    inside one task.  The threshold grows with the input, so that at most four
    times as many groups are hot as there are shuffle partitions: a bounded
    table, which is broadcast.  Where no group is hot, rows are ranked at once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    total, largest = counts.agg(F.coalesce(F.sum("_cnt"), F.lit(0)), F.coalesce(F.max("_cnt"), F.lit(0))).first()
    threshold = max(hot_threshold, total // (4 * parts))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    if largest <= threshold:
        out = df.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= limit_col)
        return (out.withColumn(rank_name, F.col("_r")) if rank_name else out).drop("_r")
    hot = counts.filter(F.col("_cnt") > threshold).select(
        *keys, F.ceil(F.col("_cnt") / F.lit(threshold)).cast("int").alias("_s"))
    x = df.join(F.broadcast(hot), keys, "left")
    # by row, not by value: equal rows go to different sub-groups, too
    salt = F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_s")))
    x = x.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cand = x.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= limit_col)
    # candidates per group are at most limit * salts rows
    out = cand.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= limit_col)
    if rank_name:
        out = out.withColumn(rank_name, F.col("_r"))
    return out.drop("_s", "_salt", "_r1", "_r")


def sparsify(votes: DataFrame, max_votes: int | Column, seed: int = 42, group_cols=(),
             hot_threshold: int = MIN_HOT_THRESHOLD) -> DataFrame:
    """Keep at most L votes per prompt, chosen by a seeded hash order."""
    lim = F.lit(max_votes) if isinstance(max_votes, int) else max_votes
    v = votes.withColumn("_h", vote_order(seed))
    out = top_per_group(v, list(group_cols) + ["prompt_id"], ["_h", "annotator_id", "vote"], lim, hot_threshold)
    return out.drop("_h")


def annotator_ranks(votes: DataFrame, seed: int = 42) -> DataFrame:
    """(annotator_id, crowd_rank): a seeded random order of the annotators,
    0-based and dense (distributed index, no global window)."""
    ann = votes.select("annotator_id").distinct().withColumn(
        "_h", hash32(F.concat(F.lit(f"{seed}|crowd|"), F.col("annotator_id").cast("string"))))
    return dense_index(ann, ["_h", "annotator_id"], "crowd_rank").drop("_h")


def role(rank: Column, crowd: Column, adv: Column, spam: Column | None = None) -> Column:
    """R2 roles inside a crowd of size ``crowd``: the first floor(crowd·adv)
    ranks are adversaries, the next floor(crowd·spam) spammers."""
    spam = F.greatest(F.lit(0.0), F.lit(CORRUPT_SHARE) - adv) if spam is None else spam
    n_adv = F.floor(crowd * adv)
    n_spam = F.floor(crowd * spam)
    return (F.when(rank < n_adv, F.lit("adversary"))
            .when(rank < n_adv + n_spam, F.lit("spammer"))
            .otherwise(F.lit("honest")))


def spam_coin(seed: int = 42) -> Column:
    return (unit_hash(F.concat_ws("|", F.lit(f"{seed}|coin"), F.col("prompt_id").cast("string"),
                                  F.col("annotator_id").cast("string"))) < 0.5).cast("int")


def corrupt_vote(role_col: Column, seed: int = 42) -> Column:
    """Adversaries flip their vote; spammers answer with a hash coin."""
    return (F.when(role_col == "adversary", 1 - F.col("vote"))
            .when(role_col == "spammer", spam_coin(seed))
            .otherwise(F.col("vote"))).cast("int")


def corrupt_truth(role_col: Column, acc: Column | None = None) -> Column:
    """Worker truth after R2: flip → 1 − acc, coin → 0.5."""
    acc = F.col("true_acc") if acc is None else acc
    return (F.when(role_col == "adversary", 1.0 - acc)
            .when(role_col == "spammer", F.lit(0.5))
            .otherwise(acc))


def _ranks_joinable(ranks: DataFrame) -> DataFrame:
    return F.broadcast(ranks) if ranks.count() <= BROADCAST_ROW_LIMIT else ranks


def restrict_crowd(votes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Only the votes of the first ``n`` annotators of the seeded order
    (a semi-join against at most ``n`` ids, broadcast when n is small)."""
    keep = annotator_ranks(votes, seed).filter(F.col("crowd_rank") < n).select("annotator_id")
    keep = F.broadcast(keep) if n <= BROADCAST_ROW_LIMIT else keep
    return votes.join(keep, "annotator_id", "left_semi")


def corrupt(votes: DataFrame, worker_truth: DataFrame | None, adv: float, spam: float | None = None,
            seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """R2 on one vote table: (perturbed votes, rewritten worker truth)."""
    ranks = annotator_ranks(votes, seed)
    n = ranks.count()
    sp = None if spam is None else F.lit(spam)
    ranks = ranks.withColumn("role", role(F.col("crowd_rank"), F.lit(float(n)), F.lit(adv), sp))
    rj = _ranks_joinable(ranks.select("annotator_id", "role"))
    v = votes.join(rj, "annotator_id").withColumn("vote", corrupt_vote(F.col("role"))).drop("role")
    wt = None
    if worker_truth is not None:
        wt = worker_truth.join(rj, "annotator_id").withColumn("true_acc", corrupt_truth(F.col("role"))).drop("role")
    return v.select("prompt_id", "annotator_id", "vote"), wt


# ------------------------------------------------------------------ sweep
@dataclass(frozen=True)
class Config:
    config_id: int
    variable_tested: str
    L: int
    Adv: float
    N: int


def sweep_configs(l_grid=L_GRID, adv_grid=ADV_GRID, n_grid=N_GRID, base_n=BASE_N, base_l=BASE_L,
                  base_adv=BASE_ADV) -> list[Config]:
    """R4 grid: every (L, adv) at the base crowd, then every N at base L/adv."""
    out, i = [], 0
    for l in l_grid:
        for a in adv_grid:
            out.append(Config(i, "Heatmap", l, a, base_n))
            i += 1
    for n in n_grid:
        out.append(Config(i, "Scale", base_l, base_adv, n))
        i += 1
    return out


def config_table(spark, configs: list[Config]) -> DataFrame:
    return spark.createDataFrame([(c.config_id, c.variable_tested, c.L, float(c.Adv), c.N) for c in configs],
                                 "config_id int, variable_tested string, L int, Adv double, N int")


def crowd_worker(rank: Column, n_total: int, crowd: Column) -> Column:
    """The worker of a crowd of size ``crowd`` (0-based) that casts a vote of
    the annotator with this rank among ``n_total``: rank modulo crowd.  For a
    crowd larger than the annotators, each annotator's prompts are dealt to
    several workers, so that there are as many as the configuration says."""
    shares = F.ceil(crowd / F.lit(float(n_total)))
    share = F.pmod(hash32(F.concat(F.lit("crowd share|"), F.col("prompt_id").cast("string"))), shares)
    return F.pmod(rank + F.lit(n_total) * share, crowd).cast("bigint")


def _ranked_votes(votes: DataFrame, worker_truth: DataFrame, most: int, seed: int, hot_threshold: int) -> tuple[DataFrame, int]:
    """(the ``most`` first votes of each prompt with ``_rank``, ``crowd_rank``
    and ``_acc`` of their annotator, the number of annotators).  A vote without
    an annotator has its rank, but no ``crowd_rank``."""
    ranks = annotator_ranks(votes, seed).checkpoint(eager=True)  # one row per annotator
    truth = worker_truth.select("annotator_id", F.col("true_acc").cast("double").alias("_acc"))
    ranked = top_per_group(votes.select("prompt_id", "annotator_id", "vote").withColumn("_h", vote_order(seed)), ["prompt_id"],
                           ["_h", "annotator_id", "vote"], F.lit(most), hot_threshold, rank_name="_rank").drop("_h")
    return ranked.join(_ranks_joinable(ranks.join(truth, "annotator_id", "left")), "annotator_id", "left"), ranks.count()


def perturbed_votes(votes: DataFrame, worker_truth: DataFrame, configs: list[Config], seed: int = 42,
                    hot_threshold: int = MIN_HOT_THRESHOLD, packed: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """All configurations in one written table: (config_id, prompt_id,
    annotator_id, vote), and (config_id, annotator_id, true_acc) with the true
    accuracy of each worker's votes.

    No vote is lost but to L: all votes are spread over the N workers of a
    configuration (:func:`crowd_worker`).  Votes are ranked inside their
    prompt once, by an order that no configuration changes, and those beyond
    the largest L go first; a vote is then replicated for the configurations
    that take its rank, and for no other.  ``packed``: :func:`prompt_votes` of
    at least the largest L, where they are there already: no vote is ranked or
    hashed again.  These have no votes on prompts without an id."""
    spark = votes.sparkSession
    if packed is not None:
        return _written_votes(_unpacked(*packed, configs))
    ranked, n_total = _ranked_votes(votes, worker_truth, max(c.L for c in configs), seed, hot_threshold)
    # the configuration list is fixed and small
    cfg = F.array(*[F.struct(F.lit(c.config_id).alias("config_id"), F.lit(c.L).alias("L"), F.lit(float(c.Adv)).alias("Adv"),
                             F.lit(c.N).alias("N")) for c in configs])
    v = ranked.filter("crowd_rank is not null").withColumn("c", F.explode(F.filter(cfg, lambda c: c["L"] >= F.col("_rank"))))
    v = v.withColumn("worker", crowd_worker(F.col("crowd_rank"), n_total, F.col("c.N")))
    v = v.withColumn("role", role(F.col("worker"), F.col("c.N").cast("double"), F.col("c.Adv")))
    v = v.select(F.col("c.config_id").alias("config_id"), "prompt_id", F.col("worker").alias("annotator_id"),
                 corrupt_vote(F.col("role"), seed).alias("vote"),
                 corrupt_truth(F.col("role"), F.col("_acc")).alias("true_acc"))
    return _written_votes(v)


def _written_votes(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = written(v, "perturbed_votes")
    wt = v.groupBy("config_id", "annotator_id").agg(F.avg("true_acc").alias("true_acc"))
    return v.select("config_id", "prompt_id", "annotator_id", "vote"), wt


RANK_BIT = 48  # of a vote's number: from here on up its rank
NOBODY = (1 << RANK_BIT) - 1  # the bits below, where a vote has no annotator


def prompt_votes(votes: DataFrame, worker_truth: DataFrame, most: int, seed: int = 42,
                 hot_threshold: int = MIN_HOT_THRESHOLD) -> tuple[DataFrame, int]:
    """A written row per prompt: (prompt_id, share, votes, acc), and the number
    of annotators.  ``votes`` are the ``most`` first votes of the prompt by
    rank, each a number with all that a configuration needs to perturb it: 8
    times the annotator's place in the crowd, and a bit each for whether the
    vote as it is (4), the flipped vote (2) and the spammer's coin (1) say A
    (``NOBODY`` without an annotator), and above them the rank, which comes
    again where the annotator has several true accuracies.  ``acc`` are these;
    ``share`` deals the prompt in crowds larger than the annotators."""
    ranked, n_total = _ranked_votes(votes, worker_truth, most, seed, hot_threshold)
    says_a = lambda c, bit: F.when(F.coalesce(c == 1, F.lit(False)), bit).otherwise(0)
    bits = says_a(F.col("vote"), 4) + says_a(1 - F.col("vote"), 2) + says_a(spam_coin(seed), 1)
    vote = F.shiftleft(F.col("_rank").cast("bigint"), RANK_BIT) + F.coalesce(F.col("crowd_rank").cast("bigint") * 8 + bits, F.lit(NOBODY))
    one = F.struct(vote.alias("vote"), F.col("_acc").alias("acc"))
    # a prompt without an id has no worker in any configuration
    packed = ranked.filter("prompt_id is not null").groupBy("prompt_id").agg(F.array_sort(F.collect_list(one)).alias("v"))
    packed = packed.select(F.col("prompt_id").cast("bigint").alias("prompt_id"),
                           hash32(F.concat(F.lit("crowd share|"), F.col("prompt_id").cast("string"))).alias("share"),
                           F.col("v.vote").alias("votes"), F.col("v.acc").alias("acc"))
    path = scratch_path(votes.sparkSession, "prompt_votes")
    packed.write.parquet(path)
    return votes.sparkSession.read.schema(packed.schema).parquet(path), n_total


def _places(batch, configs: list[Config], n_total: int):
    """A batch of :func:`prompt_votes` by place, not by prompt: (order of the
    prompts, those with most votes first; per crowd size and L the cells of the
    first, second, ... votes; the accuracies beside them, where they were read).
    A vote's cell is 8 x its worker and its bits, 8 x the crowd if it is not taken;
    place i holds the first so many prompts of that order as have i + 1 votes."""
    import numpy as np

    column = batch.column("votes")
    start = column.offsets.to_numpy() - column.offsets[0].as_py()
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    start, size, share = start[:-1][order], size[order], batch.column("share").to_numpy()[order]
    value = column.flatten().to_numpy()
    known = batch.column("acc").flatten().to_numpy(zero_copy_only=False) if "acc" in batch.schema.names else None  # NaN where there is none
    shares = {c.N: share % int(np.ceil(c.N / n_total)) * n_total for c in configs}
    every, ranks, acc = {n: [] for n in shares}, [], []
    for i in range(int(size.max(initial=0))):
        at = start[:np.searchsorted(-size, -i)] + i
        vote = value[at] & NOBODY
        ranks.append(value[at] >> RANK_BIT)
        crowd, bits, none = vote >> 3, vote & 7, vote == NOBODY
        for n in shares:
            every[n].append(np.where(none, 8 * n, ((crowd + shares[n][:len(at)]) % n) * 8 + bits))
        if known is not None:
            acc.append(known[at])
    once = all((r == i).all() for i, r in enumerate(ranks, 1))  # then the first L places are those with rank L at most
    return order, {(c.N, c.L): every[c.N][:c.L] if once else [np.where(r <= c.L, x, 8 * c.N) for r, x in zip(ranks, every[c.N], strict=True)]
                   for c in configs}, acc


def _roles(c: Config):
    """(flips, guesses) of each worker of a configuration."""
    import numpy as np

    worker = np.arange(c.N)
    adv, spam = np.floor(c.N * c.Adv), np.floor(c.N * max(0.0, CORRUPT_SHARE - c.Adv))
    flips = worker < adv
    return flips, ~flips & (worker < adv + spam)


def _signs(c: Config):
    """(worker, bits): 1 where the configuration makes such a vote one for A, else -1."""
    import numpy as np

    flips, guesses = _roles(c)
    bit = np.where(flips, 2, np.where(guesses, 1, 4))
    return np.where(np.arange(8) & bit[:, None], 1.0, -1.0)


def _unpacked(prompts: DataFrame, n_total: int, configs: list[Config]) -> DataFrame:
    """(config_id, prompt_id, annotator_id, vote, true_acc) of :func:`prompt_votes`, a row per configuration and vote that it takes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        roles = {c: _roles(c) for c in configs}
        says_a = {c: (_signs(c) > 0).ravel() for c in configs}
        # a vote that is null is neither as it is nor flipped one for A; the coin has a side
        null = {c: (~roles[c][1][:, None] & (np.arange(8) & 6 == 0)).ravel() for c in configs}
        for batch in batches:
            order, cells, acc = _places(batch, configs, n_total)
            ids = batch.column("prompt_id").take(pa.array(order))
            for c in configs:
                flips, guesses = roles[c]
                for x, known in zip(cells[c.N, c.L], acc):  # the first L places, where the others are not asked for
                    at = np.flatnonzero(x < 8 * c.N)
                    cell, worker = x[at], x[at] >> 3
                    truth = np.where(flips[worker], 1.0 - known[at], np.where(guesses[worker], 0.5, known[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c.config_id, dtype=np.int32)), ids.take(pa.array(at)), pa.array(worker),
                                                      pa.array(says_a[c][cell].astype(np.int32), mask=null[c][cell]), pa.array(truth, mask=np.isnan(truth))],
                                                     names=["config_id", "prompt_id", "annotator_id", "vote", "true_acc"])

    rows = prompts.select("prompt_id", "share", "votes", "acc")
    return rows.mapInArrow(run, "config_id int, prompt_id long, annotator_id long, vote int, true_acc double")


def _evidence(c: Config, log_odds):
    """What a vote in each cell adds to the log odds of A; the cell without a worker adds nothing."""
    import numpy as np

    return np.append((_signs(c) * log_odds[:, None]).ravel(), 0.0)


def _posterior(cells, rows: int, evidence):
    """P(A) per prompt of a batch, in its order by places."""
    import numpy as np

    z = np.zeros(rows)
    for x in cells:
        z[:len(x)] -= evidence[x]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1.0
    return np.divide(1.0, z, out=z)


def _cell_sums(cells, n: int, weights=None):
    """Weights of the votes (of each place) added up per (worker, bits)."""
    import numpy as np

    total = np.zeros(8 * n + 1)
    if cells:
        got = np.bincount(np.concatenate(cells), weights=None if weights is None else np.concatenate(weights))
        total[:len(got)] = got
    return total[:-1].reshape(n, 8)


def _log_odds(alpha):
    import numpy as np

    return np.log(alpha) - np.log(1.0 - alpha)


_SUMS = "config_id int, annotator_id long, signed double, minus double, tot double, acc double, n_acc double, shift double"


def sweep_step(prompts: DataFrame, n_total: int, configs: list[Config], cur: dict, prev: dict, count: bool) -> DataFrame:
    """One E and M step of the one-coin model for all ``configs`` in one pass
    over :func:`prompt_votes`: the perturbed votes are made in the task and
    never written.  ``cur``, ``prev``: accuracy of every worker by config_id
    (none in ``prev``: γ was 0.5).  A row per configuration and worker, each task's
    sums added up by Spark: γ of the votes for A less γ of those for B, max |Δγ|;
    with ``count`` also what no iteration changes: votes for B, all votes, true accuracies.

    All configurations of a crowd size share the votes' cells; what differs is
    the evidence of a cell, looked up in a table of 8 numbers a worker."""
    start = em.INIT_GAMMA
    shared = prompts.sparkSession.sparkContext.broadcast({c.config_id: (_log_odds(cur[c.config_id]), _log_odds(prev[c.config_id]) if c.config_id in prev else None)
                                                          for c in configs})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = {c: [None if x is None else _evidence(c, x) for x in shared.value[c.config_id]] for c in configs}
        signed, shift = {c: np.zeros((c.N, 8)) for c in configs}, dict.fromkeys(configs, 0.0)
        counted = {(c.N, c.L): np.zeros((3, c.N, 8)) for c in configs} if count else {}
        for batch in batches:
            order, cells, acc = _places(batch, configs, n_total)
            for n, l in counted:
                own = cells[n, l]
                truth = acc[:len(own)]
                known = [~np.isnan(x) for x in truth]
                for i, w in enumerate((None, [np.where(k, x, 0.0) for k, x in zip(known, truth, strict=True)], known)):
                    counted[n, l][i] += _cell_sums(own, n, w)
            for c in configs:
                own = cells[c.N, c.L]
                now, before = table[c]
                g = _posterior(own, len(order), now)
                signed[c] += _cell_sums(own, c.N, [g[:len(x)] for x in own])
                g -= start if before is None else _posterior(own, len(order), before)
                shift[c] = max(shift[c], float(np.abs(g, out=g).max(initial=0.0)))
        for c in configs:
            sign = _signs(c)
            sums = [(signed[c] * sign).sum(1)]
            if count:
                n, known, n_known = counted[c.N, c.L]
                flips, guesses = _roles(c)
                known, n_known = known.sum(1), n_known.sum(1)
                # a spammer's accuracy is known, whoever it is
                sums += [(n * (sign < 0)).sum(1), n.sum(1), np.where(flips, n_known - known, np.where(guesses, 0.5 * n.sum(1), known)),
                         np.where(guesses, n.sum(1), n_known)]
                at = np.flatnonzero(sums[2])
            else:
                sums += [np.zeros(c.N)] * 4
                at = np.flatnonzero(signed[c].any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c.config_id, dtype=np.int32)), pa.array(at), *[pa.array(y[at]) for y in sums],
                                              pa.array(np.full(len(at), shift[c]))], names=[c.split()[0] for c in _SUMS.split(", ")])

    rows = prompts.select("share", "votes", *(["acc"] if count else []))
    return rows.mapInArrow(run, _SUMS).groupBy("config_id", "annotator_id").agg(
        *[F.sum(c).alias(c) for c in ("signed", "minus", "tot", "acc", "n_acc")], F.max("shift").alias("shift"))


def sweep_trust(prompts: DataFrame, n_total: int, configs: list[Config], alpha: dict) -> DataFrame:
    """(config_id, prompt_id, trust_weight) under the accuracies ``alpha``."""
    shared = prompts.sparkSession.sparkContext.broadcast({i: _log_odds(a) for i, a in alpha.items()})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            order, cells, _ = _places(batch, configs, n_total)
            for c in configs:
                own = cells[c.N, c.L]
                has = np.zeros(len(order), dtype=bool)
                for x in own:
                    has[:len(x)] |= x < 8 * c.N
                g = _posterior(own, len(order), _evidence(c, shared.value[c.config_id]))[has]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c.config_id, dtype=np.int32)), batch.column("prompt_id").take(pa.array(order[has])),
                                                  pa.array(g)], names=["config_id", "prompt_id", "trust_weight"])

    return prompts.select("prompt_id", "share", "votes").mapInArrow(run, "config_id int, prompt_id long, trust_weight double")


def fit_sweep(votes: DataFrame, worker_truth: DataFrame, configs: list[Config], max_iter: int = em.DEFAULT_MAX_ITER,
              tol: float | None = em.DEFAULT_TOL, seed: int = 42, track_frames: bool = False,
              hot_threshold: int = MIN_HOT_THRESHOLD, packed: tuple[DataFrame, int] | None = None) -> em.EMResult:
    """:func:`em.fit` (one-coin) of all configurations without writing a vote
    per configuration: the ranked votes are written once, a row per prompt, and
    each iteration is one pass over them (:func:`sweep_step`).  The driver keeps
    the workers' accuracies, a number per worker of each crowd.  ``packed``:
    :func:`prompt_votes` of at least the largest L, where they are there already."""
    import numpy as np

    spark = votes.sparkSession
    prompts, n_total = packed or prompt_votes(votes, worker_truth, max(c.L for c in configs), seed, hot_threshold)
    cur = {c.config_id: np.full(c.N, em.ONECOIN_INIT_ALPHA) for c in configs}
    prev: dict = {}
    fixed: dict = {}  # votes for B, all votes, sum and number of true accuracies per worker
    seen: dict = {}  # workers with votes
    history, frames, active = [], [], list(configs)
    for it in range(1, max_iter + 1):
        table = sweep_step(prompts, n_total, active, cur, prev, it == 1).toArrow()  # a row per worker of each crowd
        step = {c: table.column(c).to_numpy() for c in table.column_names}
        going = []
        for c in active:
            i, own = c.config_id, {k: v[step["config_id"] == c.config_id] for k, v in step.items()}
            w = own["annotator_id"]
            if it == 1:
                if not len(w):  # no vote
                    continue
                fixed[i], seen[i] = np.zeros((4, c.N)), np.sort(w)
                fixed[i][:, w] = [own[k] for k in ("minus", "tot", "acc", "n_acc")]
            signed = np.zeros(c.N)
            signed[w] = own["signed"]
            w = seen[i]
            minus, tot, acc, n_acc = fixed[i][:, w]
            prev[i], cur[i] = cur[i], cur[i].copy()
            alpha = cur[i][w] = np.clip((minus + signed[w]) / np.maximum(tot, 1.0), em.ONECOIN_EPS, 1.0 - em.ONECOIN_EPS)
            known = n_acc > 0
            l1 = float(np.abs(acc[known] / n_acc[known] - alpha[known]).mean()) if known.any() else None
            shift = float(own["shift"].max(initial=0.0))
            history.append((i, l1, shift, it))
            if tol is None or not shift < tol:
                going.append(c)
        if track_frames:
            frames += [(i, int(w), float(cur[i][w]), it) for i in seen for w in seen[i]]
        active = going
        if not active:
            break
    state = [(i, int(w), float(cur[i][w]), float(prev[i][w])) for i in seen for w in seen[i]]
    state = spark.createDataFrame(state, "config_id int, annotator_id long, alpha_cur double, alpha_prev double")
    trust = sweep_trust(prompts, n_total, [c for c in configs if c.config_id in seen], prev)
    params = state.select("config_id", "annotator_id", F.col("alpha_cur").alias("alpha"), F.col("alpha_cur").alias("inferred_acc"))
    hist = spark.createDataFrame(history, "config_id int, l1_parameter_loss double, max_gamma_shift double, iteration int")
    frames_table = spark.createDataFrame(frames, "config_id int, annotator_id long, inferred_acc double, iteration int") if track_frames else None
    return em.EMResult(trust, params, hist.select("config_id", "iteration", "l1_parameter_loss", "max_gamma_shift"), frames_table, state, ["config_id"])


def in_task(configs: list[Config]) -> bool:
    """Whether the accuracies of all crowds are few enough to be broadcast."""
    return sum(c.N for c in configs) <= BROADCAST_ROW_LIMIT


def run_sweep(votes: DataFrame, worker_truth: DataFrame, configs: list[Config] | None = None,
              max_iter: int = em.DEFAULT_MAX_ITER, tol: float | None = em.DEFAULT_TOL, seed: int = 42,
              track_frames: bool = False, packed: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, em.EMResult]:
    """R4 + E12 + M1: sweep matrix (config_id, variable_tested, L, Adv, N, Error).

    Crowds of more than ``BROADCAST_ROW_LIMIT`` workers in all are too many to
    broadcast: their votes are written per configuration and fitted by
    :func:`em.fit`.  ``packed``: see :func:`fit_sweep`."""
    configs = configs or sweep_configs()
    spark = votes.sparkSession
    if in_task(configs):
        res = fit_sweep(votes, worker_truth, configs, max_iter, tol, seed, track_frames, packed=packed)
    else:
        pv, wt = perturbed_votes(votes, worker_truth, configs, seed)
        res = em.fit(pv, "onecoin", max_iter=max_iter, tol=tol, worker_truth=wt, group_cols=["config_id"],
                     track_frames=track_frames)
    err = res.history.groupBy("config_id").agg(F.max_by("l1_parameter_loss", "iteration").alias("Error"),
                                               F.max("iteration").alias("iterations"))
    return config_table(spark, configs).join(err, "config_id", "left"), res


def failure_points(matrix: DataFrame, threshold: float = ERROR_THRESHOLD, base_n: int = BASE_N,
                   base_l: int = BASE_L, base_adv: float = BASE_ADV, l_grid=L_GRID, adv_grid=ADV_GRID,
                   n_grid=N_GRID, any_adv: bool = False) -> DataFrame:
    """Edge L (max failing L at base adv/N; ``any_adv``: at any adversary
    share, since the grid of shares need not hold the base one), edge Adv (min
    failing adv at base L/N), edge N (min failing N of the scale rows), with
    the reference's defaults when nothing fails."""
    bad = F.col("Error") > threshold
    bad_l = bad & (F.col("N") == base_n)
    if not any_adv:
        bad_l = bad_l & (F.col("Adv") == base_adv)
    bad_a = bad & (F.col("L") == base_l) & (F.col("N") == base_n)
    bad_n = bad & (F.col("variable_tested") == "Scale")
    return matrix.agg(
        F.coalesce(F.max(F.when(bad_l, F.col("L"))), F.lit(l_grid[0])).alias("edge_L"),
        F.coalesce(F.min(F.when(bad_a, F.col("Adv"))), F.lit(float(adv_grid[-1]))).alias("edge_Adv"),
        F.coalesce(F.min(F.when(bad_n, F.col("N"))), F.lit(n_grid[0])).alias("edge_N"))


def worst_config(matrix: DataFrame, min_l: int = 3) -> Config:
    """The heatmap configuration with the largest error among those with
    at least ``min_l`` votes per prompt (with one vote, EM is majority vote)."""
    r = (matrix.filter((F.col("variable_tested") == "Heatmap") & (F.col("L") >= min_l))
         .orderBy(F.desc(F.round("Error", 6)), "config_id").first())
    return Config(int(r["config_id"]), "worst", int(r["L"]), float(r["Adv"]), int(r["N"]))


def heatmap(matrix: DataFrame, adv_values=ADV_GRID) -> DataFrame:
    """L × Adv pivot of the error, L descending, percent column labels.
    A cell with two different errors is a mistake in the matrix: the job fails
    and names it."""
    h = matrix.filter(F.col("variable_tested") == "Heatmap")
    named = F.concat(F.lit("two errors for L = "), F.col("L").cast("string"), F.lit(", Adv = "), F.col("Adv").cast("string"))
    cells = h.groupBy("L", "Adv").agg(F.min("Error").alias("_lo"), F.max("Error").alias("_hi"))
    cells = cells.withColumn("Error", F.when(F.col("_lo") != F.col("_hi"), F.raise_error(named).cast("double")).otherwise(F.col("_lo")))
    p = cells.groupBy("L").pivot("Adv", [float(a) for a in adv_values]).agg(F.first("Error"))
    ren = {str(float(a)): f"{int(round(a * 100))}%" for a in adv_values}
    for old, new in ren.items():
        if old in p.columns:
            p = p.withColumnRenamed(old, new)
    return p.orderBy(F.desc("L"))


def error_vs_n(matrix: DataFrame, threshold: float = ERROR_THRESHOLD) -> DataFrame:
    """Scale rows ordered by N with a failure flag."""
    s = matrix.filter(F.col("variable_tested") == "Scale")
    return s.select("N", "Error", (F.col("Error") > threshold).cast("int").alias("failed")).orderBy("N")


def majority_vs_em(votes: DataFrame, trust: DataFrame, truth: DataFrame, group_cols=()) -> DataFrame:
    """Majority-vote accuracy vs EM accuracy on the same votes, and the lift."""
    keys = list(group_cols)
    maj = majority_vote(votes, keys).join(truth, "prompt_id").groupBy(*keys).agg(
        F.avg((F.col("label") == F.col("truth_is_a")).cast("double")).alias("majority_accuracy"))
    emv = trust.join(truth, "prompt_id").groupBy(*keys).agg(
        F.avg((hard_label(F.round("trust_weight", 6)) == F.col("truth_is_a")).cast("double")).alias("em_accuracy"))
    if keys:
        out = maj.join(emv, keys)
    else:
        out = maj.withColumn("_k", F.lit(0)).join(emv.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return out.withColumn("lift", F.col("em_accuracy") - F.col("majority_accuracy"))


def balanced_assignment(prompts: DataFrame, workers_per_task: int, n_annotators: int, seed: int = 42) -> DataFrame:
    """Each task gets L slots; slots in a seeded random order are dealt
    round-robin to N workers, so every worker gets ⌊T·L/N⌋ or one more task.
    Returns (prompt_id, slot, annotator_id, collision) where collision marks a
    worker drawn twice for the same task."""
    stubs = prompts.select("prompt_id").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(workers_per_task - 1))))
    stubs = stubs.withColumn("_h", hash32(F.concat_ws("|", F.lit(f"{seed}|assign"), F.col("prompt_id").cast("string"),
                                                      F.col("slot").cast("string"))))
    idx = dense_index(stubs, ["_h", "prompt_id", "slot"], "_i")
    a = idx.select("prompt_id", "slot", F.pmod(F.col("_i"), F.lit(n_annotators)).alias("annotator_id"))
    w = Window.partitionBy("prompt_id", "annotator_id").orderBy("slot")
    return a.withColumn("collision", (F.row_number().over(w) > 1).cast("int"))


def assignment_report(assign: DataFrame) -> DataFrame:
    """R9 summary: tasks per worker range and the number of collisions."""
    per = assign.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("r"))
    a = per.agg(F.min("r").cast("bigint").alias("min_tasks"), F.max("r").cast("bigint").alias("max_tasks"),
                F.count(F.lit(1)).cast("bigint").alias("n_workers"))
    b = assign.agg(F.sum("collision").cast("bigint").alias("collisions"),
                   F.count(F.lit(1)).cast("bigint").alias("n_edges"))
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")


def edge_case_configs(edges: dict, base_n: int = BASE_N, base_l: int = BASE_L, base_adv: float = BASE_ADV) -> list[Config]:
    """The three isolated failures plus the golden-standard set.
    Fixed values: the names of the four cases."""
    gl, ga, gn = GOLDEN
    return [Config(0, "isolated_sparsity_failure", int(edges["edge_L"]), base_adv, base_n),
            Config(1, "isolated_adversarial_failure", base_l, float(edges["edge_Adv"]), base_n),
            Config(2, "isolated_scale_failure", base_l, base_adv, int(edges["edge_N"])),
            Config(3, "golden_standard", gl, ga, gn)]
