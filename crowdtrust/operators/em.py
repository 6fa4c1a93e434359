"""Dawid–Skene EM as DataFrame jobs.

One iteration is one Spark job over the vote store:

    E:  votes ⋈ params (broadcast, or routed to the votes' buckets)
        → group by prompt                                  (no exchange of votes: bucketed)
    M:  votes ⋈ posterior (same buckets, shuffle-hash join) → partial sums by
        annotator → small exchange → new params

The per-annotator parameter table carries the current and the previous
parameters, so the same aggregate produces the posterior of this and of
the previous iteration.  That yields the convergence shift
``max |γ_k − γ_{k−1}|`` inside the M-step aggregate, and no per-prompt
table is ever written during the loop.  The small parameter table is
checkpointed to the shared checkpoint folder every iteration (lineage cut,
survives executor loss).  Scalars such as the two-coin class prior π₁ live
as columns of the parameter table, which is how batched EM over many
configurations (``group_cols``) keeps one π₁ per configuration.

A packed store (:mod:`crowdtrust.operators.packed`) takes both steps in one
pass over a row per prompt; the driver sends the parameters along.

Order is E then M; the outputs are γ from the last E-step and the parameters
from the last M-step (one half-step newer), as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtrust.functions.columns import clip, gamma_bin, two_class_posterior
from crowdtrust.operators import packed as pk
from crowdtrust.operators.votes import BUCKET, PromptTable, VoteStore, group_part
from crowdtrust.session import checkpoint_root
from crowdtrust.sources.io import dense_ids

# Fixed values of the reference models.
ONECOIN_INIT_ALPHA = 0.6
ONECOIN_EPS = 1e-4
TWOCOIN_INIT = 0.7
TWOCOIN_EPS = 1e-6
INIT_GAMMA = 0.5
PRIOR_EPS = pk.PRIOR_EPS
LEGACY_PRIOR_EPS = pk.LEGACY_PRIOR_EPS
DEFAULT_MAX_ITER = 20
DEFAULT_TOL = 1e-4

_G = "_grp"  # internal constant group key when the caller passes none


def _c(name: str) -> Column:
    return F.col(name)


class OneCoin:
    """α_j = P(correct) for both classes; flat 50/50 prior."""

    name = "onecoin"
    prior_mode = None
    params = ("alpha",)
    scalars: tuple = ()
    init = {"alpha": ONECOIN_INIT_ALPHA}

    def vote_terms(self, v: Column, p: dict) -> tuple[Column, Column]:
        a = p["alpha"]
        la, l1a = F.log(a), F.log(1.0 - a)
        return F.when(v == 1, la).otherwise(l1a), F.when(v == 1, l1a).otherwise(la)

    def prior_terms(self, prior: Column | None, s: dict) -> tuple[Column, Column]:
        if prior is None:
            return F.log(F.lit(0.5)), F.log(F.lit(0.5))
        p = clip(F.coalesce(prior, F.lit(0.5)), PRIOR_EPS, 1.0 - PRIOR_EPS)
        return F.log(p), F.log(1.0 - p)

    def m_sums(self, v: Column, n: Column, g: Column) -> dict:
        return {"corr": F.sum(n * F.when(v == 1, g).otherwise(1.0 - g)),
                "tot": F.sum(n).cast("double")}

    def m_params(self, s: dict) -> dict:
        return {"alpha": clip(s["corr"] / F.greatest(s["tot"], F.lit(1.0)), ONECOIN_EPS, 1.0 - ONECOIN_EPS)}

    def m_scalars(self, gsum: Column, gcnt: Column) -> dict:
        return {}

    def evidence(self, p: dict):
        """What a vote of each annotator adds to the log odds of A, per kind of vote: the difference of :meth:`vote_terms`."""
        import numpy as np

        z = np.log(p["alpha"]) - np.log(1.0 - p["alpha"])
        return np.stack([-z, z, -z], 1).ravel()

    def packed_sums(self) -> dict:
        """:meth:`m_sums` from the sums of packed votes."""
        return {"corr": _c("g_yes") + _c("h_no") + _c("h_none"), "tot": _c("tot")}

    def accuracy(self, p: dict) -> Column:
        return p["alpha"]

    def unseen_params(self) -> dict:
        # an id with no votes: clip(0 / max(0, 1)) = eps
        return {"alpha": ONECOIN_EPS}


class TwoCoin:
    """α_j = P(vote A | A), β_j = P(vote B | B), class prior π₁.

    ``prior_mode="textbook"`` adds log π₁ (or the injected prior) once;
    ``"legacy"`` reproduces the reference implementation, which adds the
    prior twice: log(prior_A + 1e-9) with prior_A = π₁ when no prior is
    injected, and log π₁ again.
    """

    name = "twocoin"
    params = ("alpha", "beta")
    scalars = ("pi1",)
    init = {"alpha": TWOCOIN_INIT, "beta": TWOCOIN_INIT, "pi1": 0.5}

    def __init__(self, prior_mode: str = "textbook"):
        if prior_mode not in ("textbook", "legacy"):
            raise ValueError("prior_mode must be 'textbook' or 'legacy'")
        self.prior_mode = prior_mode

    def vote_terms(self, v: Column, p: dict) -> tuple[Column, Column]:
        a, b = p["alpha"], p["beta"]
        return (F.when(v == 1, F.log(a)).otherwise(F.log(1.0 - a)),
                F.when(v == 1, F.log(1.0 - b)).otherwise(F.log(b)))

    def prior_terms(self, prior: Column | None, s: dict) -> tuple[Column, Column]:
        pi1 = clip(s["pi1"], PRIOR_EPS, 1.0 - PRIOR_EPS)
        if self.prior_mode == "textbook":
            if prior is None:
                return F.log(pi1), F.log(1.0 - pi1)
            p = clip(F.coalesce(prior, s["pi1"]), PRIOR_EPS, 1.0 - PRIOR_EPS)
            return F.log(p), F.log(1.0 - p)
        pa = s["pi1"] if prior is None else F.coalesce(prior, s["pi1"])
        return (F.log(pa + LEGACY_PRIOR_EPS) + F.log(pi1),
                F.log(1.0 - pa + LEGACY_PRIOR_EPS) + F.log(1.0 - pi1))

    def m_sums(self, v: Column, n: Column, g: Column) -> dict:
        return {"an": F.sum(F.when(v == 1, n * g).otherwise(F.lit(0.0))),
                "ad": F.sum(n * g),
                "bn": F.sum(F.when(v == 0, n * (1.0 - g)).otherwise(F.lit(0.0))),
                "bd": F.sum(n * (1.0 - g))}

    def m_params(self, s: dict) -> dict:
        return {"alpha": clip(s["an"] / (s["ad"] + TWOCOIN_EPS), TWOCOIN_EPS, 1.0 - TWOCOIN_EPS),
                "beta": clip(s["bn"] / (s["bd"] + TWOCOIN_EPS), TWOCOIN_EPS, 1.0 - TWOCOIN_EPS)}

    def m_scalars(self, gsum: Column, gcnt: Column) -> dict:
        return {"pi1": gsum / gcnt}

    def evidence(self, p: dict):
        import numpy as np

        a, b = p["alpha"], p["beta"]
        no = np.log(1.0 - a) - np.log(b)
        return np.stack([no, np.log(a) - np.log(1.0 - b), no], 1).ravel()

    def packed_sums(self) -> dict:
        return {"an": _c("g_yes"), "ad": _c("g_yes") + _c("g_no") + _c("g_none"),
                "bn": _c("h_no"), "bd": _c("h_yes") + _c("h_no") + _c("h_none")}

    def accuracy(self, p: dict) -> Column:
        return (p["alpha"] + p["beta"]) / 2.0

    def unseen_params(self) -> dict:
        return {"alpha": TWOCOIN_EPS, "beta": TWOCOIN_EPS}


def make_model(model: str = "onecoin", prior_mode: str = "textbook"):
    if model == "onecoin":
        return OneCoin()
    if model == "twocoin":
        return TwoCoin(prior_mode)
    raise ValueError(model)


@dataclass
class EMResult:
    trust: DataFrame          # (group.., prompt_id, trust_weight[, hard_label]) – γ of the last E-step
    params: DataFrame         # (group.., annotator_id, params.., inferred_acc)
    history: DataFrame        # (group.., iteration, l1_parameter_loss, max_gamma_shift[, pi1])
    frames: DataFrame | None  # (group.., iteration, annotator_id, inferred_acc) when tracked
    state: DataFrame          # checkpointed parameter table (cur/prev) for warm steps
    group_cols: list          # group columns of the caller
    gamma_histogram: DataFrame | None = None  # (group.., iteration, bin, n_prompts) at the chosen iterations

    @property
    def iterations(self) -> dict:
        """Group key tuple -> iterations run; (0,) without groups.  Collects a row per group."""
        most = self.history.groupBy(*self.group_cols).agg(F.max("iteration").alias("_n"))
        return {tuple(r[g] for g in self.group_cols) or (0,): r["_n"] for r in most.collect()}


class EMEngine:
    """Runs one EM model over a ``VoteStore``."""

    def __init__(self, store: VoteStore, model, prior: DataFrame | PromptTable | None = None, truth: PromptTable | None = None):
        self.store = store
        self.model = model
        self.prior = prior
        self.truth = truth
        self.gk = store.prompt_keys
        self.ak = store.annotator_keys
        self.spark = store.cold.sparkSession
        checkpoint_root(self.spark)

    # ----------------------------------------------------------- state
    def initial_state(self, init: dict | None = None) -> DataFrame:
        init = dict(self.model.init, **(init or {}))
        ann = self.store.rows().select(*self.ak).distinct()
        cols = {}
        for p in self.model.params + self.model.scalars:
            cols[f"{p}_cur"] = F.lit(float(init[p]))
            cols[f"{p}_prev"] = F.lit(None).cast("double")
        return ann.withColumns(cols).checkpoint(eager=True)

    def _pdict(self, suffix: str) -> dict:
        return {p: _c(f"{p}_{suffix}") for p in self.model.params}

    def _sdict(self, suffix: str) -> dict:
        return {s: _c(f"{s}_{suffix}") for s in self.model.scalars}

    # ----------------------------------------------------------- E-step
    def _with_params(self, state: DataFrame, hot: bool) -> DataFrame:
        """Vote rows with their annotator's parameters; rows of annotators that are not in the state go."""
        store, m = self.store, self.model
        st = state.select(*self.ak, *[f"{p}_{s}" for p in m.params + m.scalars for s in ("cur", "prev")])
        if store.broadcast_params:
            return (store.hot if hot else store.cold).join(F.broadcast(st), self.ak)
        if hot:
            return store.hot.join(st.repartition(store.num_buckets, *self.ak).hint("shuffle_hash"), self.ak)
        return store.cold.join(store.params_at_cold(st).hint("shuffle_hash"), [BUCKET, *self.ak])

    def _beside(self, g: DataFrame, values: DataFrame | PromptTable, hot: bool, col: str, name: str) -> DataFrame:
        """Per-prompt rows with a per-prompt value."""
        if not isinstance(values, PromptTable):
            return g.join(values.select(*self.gk, F.col(col).alias(name)), self.gk, "left")
        if hot:
            return g.join(F.broadcast(values.hot.select(*self.gk, F.col(col).alias(name))), self.gk, "left")
        keys = self.store.cold_keys
        return g.join(values.cold.select(*keys, F.col(col).alias(name)).hint("shuffle_hash"), keys, "left")

    def _posteriors(self, hot: bool, state: DataFrame, with_prev: bool) -> DataFrame:
        """Per-prompt posterior γ (and γ of the previous parameters) of the hot or the cold prompts."""
        m = self.model
        j = self._with_params(state, hot)
        v, n = _c("vote"), _c("n")
        ta, tb = m.vote_terms(v, self._pdict("cur"))
        aggs = [F.sum(n * ta).alias("_sa"), F.sum(n * tb).alias("_sb"),
                F.min(_c("annotator_id") * 2 + _c("vote")).alias("_lead")]
        aggs += [F.first(f"{s}_cur").alias(f"{s}_cur") for s in m.scalars]
        if with_prev:
            pa, pb = m.vote_terms(v, self._pdict("prev"))
            aggs += [F.sum(n * pa).alias("_sa0"), F.sum(n * pb).alias("_sb0"),
                     F.max(F.col(f"{m.params[0]}_prev").isNull().cast("int")).alias("_first")]
            aggs += [F.first(f"{s}_prev").alias(f"{s}_prev") for s in m.scalars]
        g = j.groupBy(*(self.gk if hot else self.store.cold_keys)).agg(*aggs)
        prior = None
        if self.prior is not None:
            g = self._beside(g, self.prior, hot, "prior", "_prior")
            prior = _c("_prior")
        if with_prev and self.truth is not None:
            g = self._beside(g, self.truth, hot, "truth_is_a", "_truth")
        la, lb = m.prior_terms(prior, self._sdict("cur"))
        g = g.withColumn("_g", two_class_posterior(la + _c("_sa"), lb + _c("_sb")))
        if with_prev:
            la0, lb0 = m.prior_terms(prior, self._sdict("prev"))
            g = g.withColumn("_g0", F.when(_c("_first") == 1, F.lit(INIT_GAMMA))
                             .otherwise(two_class_posterior(la0 + _c("_sa0"), lb0 + _c("_sb0"))))
        return g

    def posterior_table(self, state: DataFrame, which: str = "prev") -> DataFrame:
        """γ per prompt computed with the ``which`` parameters of ``state``
        ("prev" = the last E-step of a finished fit)."""
        m = self.model
        ren = {}
        for p in m.params + m.scalars:
            ren[f"{p}_cur"] = _c(f"{p}_{which}")
        st = state.withColumns(ren)
        cols = [*self.gk, _c("_g").alias("trust_weight")]
        out = self._packed_posteriors(st) if self.store.packed is not None else self._posteriors(False, st, False).select(*cols)
        return out if self.store.hot is None else out.unionByName(self._posteriors(True, st, False).select(*cols))

    # ----------------------------------------------------------- packed votes
    def _packed_inputs(self, state: DataFrame):
        """(packed rows, with their prior where there is one; a broadcast of the
        annotators' ids in order, and for the current and the previous parameters
        the evidence of their votes and π₁).  A row per annotator on the driver."""
        m, packed = self.model, self.store.packed
        names = [f"{p}_{w}" for p in m.params + m.scalars for w in ("cur", "prev")]
        rows = state.filter("annotator_id is not null").select("annotator_id", *[_c(c).cast("double") for c in names]).toArrow()
        got = {c: rows.column(c).to_numpy() for c in rows.column_names}  # NaN for null
        order = got["annotator_id"].argsort()
        got = {c: x[order] for c, x in got.items()}
        sides = [(m.evidence({p: got[f"{p}_{w}"] for p in m.params}),
                  float(got[f"{m.scalars[0]}_{w}"][0]) if m.scalars and len(order) else 0.5) for w in ("cur", "prev")]
        if self.prior is not None:
            bucketed = isinstance(self.prior, PromptTable)
            prior = (self.prior.cold if bucketed else self.prior).select("prompt_id", _c("prior").cast("double").alias("prior"))
            packed = packed.join(prior.hint("shuffle_hash") if bucketed else prior, "prompt_id", "left")
        return packed, self.spark.sparkContext.broadcast((got["annotator_id"], sides))

    def _packed_posteriors(self, state: DataFrame) -> DataFrame:
        """Per-prompt posterior under the current parameters of ``state``."""
        packed, shared = self._packed_inputs(state)
        run = pk.posterior_task(shared, self.model.prior_mode, self.prior is not None, INIT_GAMMA)
        cols = ["prompt_id", "annotators", "votes", "ns"] + (["prior"] if self.prior is not None else [])
        out = packed.select(*cols).mapInArrow(run, "prompt_id long, trust_weight double")
        return out.select(F.lit(0).alias(_G), "prompt_id", "trust_weight")

    def _packed_step(self, state: DataFrame) -> DataFrame:
        """A row per annotator and task: sums of the M-step, shift, Σγ and its count."""
        packed, shared = self._packed_inputs(state)
        run = pk.step_task(shared, self.model.prior_mode, self.prior is not None, INIT_GAMMA)
        # a prompt without an id has a posterior, but its votes meet none
        cols = ["annotators", "votes", "ns"] + (["prior"] if self.prior is not None else [])
        out = packed.filter("prompt_id is not null").select(*cols).mapInArrow(run, pk.SUMS)
        sums = [e.alias(k) for k, e in self.model.packed_sums().items()]
        return out.select(F.lit(0).alias(_G), "annotator_id", *sums, "_shift", "_gsum", "_gcnt")

    # ----------------------------------------------------------- one iteration
    def _m_rows(self, hot: bool, state: DataFrame) -> DataFrame:
        """Votes with their prompt's posterior: inside the bucket, the hot ones by broadcast."""
        keys = self.gk if hot else self.store.cold_keys
        values = ["_g", "_g0", "_lead"] + (["_truth"] if self.truth is not None else [])
        keep = self._posteriors(hot, state, True).select(*keys, *values)
        rows = (self.store.hot if hot else self.store.cold).join(F.broadcast(keep) if hot else keep.hint("shuffle_hash"), keys)
        return rows.select(*self.gk, "annotator_id", "vote", "n", *values)

    def step(self, state: DataFrame, bins: int | None = None) -> DataFrame:
        """E-step with ``*_cur`` params, M-step → next state (cur ← new, prev ← cur).
        ``bins``: also count the prompts' γ in so many equal bins."""
        m = self.model
        packed = self.store.packed is not None and self.truth is None and not bins
        rows = None if packed else self._m_rows(False, state)
        if self.store.hot is not None:
            hot = self._m_rows(True, state)
            rows = hot if rows is None else rows.unionByName(hot)
        v, n, g = _c("vote"), _c("n"), _c("_g")
        # exactly one "lead" row per prompt: its smallest (annotator, vote)
        lead = (_c("annotator_id") * 2 + v) == _c("_lead")
        sums = m.m_sums(v, n, g)
        aggs = [e.alias(k) for k, e in sums.items()]
        aggs += [F.max(F.abs(g - _c("_g0"))).alias("_shift"),
                 F.sum(F.when(lead, g).otherwise(F.lit(0.0))).alias("_gsum"),
                 F.sum(F.when(lead, F.lit(1)).otherwise(F.lit(0))).cast("double").alias("_gcnt")]
        extra = []
        if self.truth is not None:
            error = F.when(lead, F.pow(g - _c("_truth"), 2))  # null without a label
            aggs += [F.sum(error).alias("_lse"), F.count(error).alias("_lcnt")]
            extra += ["_lse", "_lcnt"]
        if bins:
            own = gamma_bin(g, bins)
            aggs += [F.count(F.when(lead & (own == i), 1)).alias(f"_bin{i}") for i in range(bins)]
            extra += [f"_bin{i}" for i in range(bins)]
        if packed:
            parts = self._packed_step(state)
            if rows is not None:
                parts = parts.unionByName(rows.groupBy(*self.ak).agg(*aggs))
            a = parts.groupBy(*self.ak).agg(*[F.sum(k).alias(k) for k in (*sums, "_gsum", "_gcnt")], F.max("_shift").alias("_shift"))
        else:
            a = rows.groupBy(*self.ak).agg(*aggs)
        # the current params become the previous ones: joined to the aggregate, a row per annotator, not to the votes
        st = state.select(*self.ak, *[_c(f"{p}_cur").alias(f"{p}_prev") for p in m.params])
        a = a.join(F.broadcast(st) if self.store.broadcast_params else st, self.ak)
        newp = m.m_params({k: _c(k) for k in sums})
        a = a.withColumns({f"{p}_cur": e for p, e in newp.items()})
        cols = [*self.ak] + [f"{p}_{s}" for p in m.params for s in ("cur", "prev")]
        return a.select(*cols, "_shift", "_gsum", "_gcnt", *extra)

    def group_stats(self, stepped: DataFrame, state: DataFrame, worker_truth: DataFrame | None) -> DataFrame:
        """A row per group: shift, L1 against worker truth, next scalars; with
        labels the two parts of 𝓛_EM; the γ histogram where it was counted."""
        m = self.model
        gc = self.store.group_cols
        p = {q: _c(f"{q}_cur") for q in m.params}
        bins = [c for c in stepped.columns if c.startswith("_bin")]
        acc = stepped.withColumn("_acc", m.accuracy(p))
        l1 = mse = F.lit(None).cast("double")
        if worker_truth is not None:
            wt = worker_truth.select(*self.ak, F.col("true_acc").cast("double").alias("_true"))
            acc = acc.join(wt, self.ak, "left")
            l1, mse = F.avg(F.abs(_c("_true") - _c("_acc"))), F.avg(F.pow(_c("_true") - _c("_acc"), 2))
        aggs = [F.max("_shift").alias("max_gamma_shift"), l1.alias("l1_parameter_loss"),
                F.sum("_gsum").alias("_tgs"), F.sum("_gcnt").alias("_tgc")]
        if self.truth is not None:
            aggs += [(F.sum("_lse") / F.sum("_lcnt")).alias("label_mse"), mse.alias("worker_mse")]
        if bins:
            aggs.append(F.array(*[F.sum(f"_bin{i}") for i in range(len(bins))]).alias("_bins"))
        out = acc.groupBy(*gc).agg(*aggs)
        if self.truth is not None:
            out = out.withColumn("em_loss", _c("label_mse") + _c("worker_mse"))
        if m.scalars:
            prev = state.groupBy(*gc).agg(*[F.first(f"{s}_cur").alias(f"{s}_prev") for s in m.scalars])
            out = out.join(prev, gc)
            out = out.withColumns({f"{s}_cur": e for s, e in m.m_scalars(_c("_tgs"), _c("_tgc")).items()})
        return out

    def per_group(self, df: DataFrame) -> DataFrame:
        """A table with a row per group, to be joined: no more groups than (group, annotator) pairs."""
        return F.broadcast(df) if self.store.broadcast_params else df

    def with_scalars(self, stepped: DataFrame, stats: DataFrame) -> DataFrame:
        """Next state: stepped params plus the group scalars."""
        m = self.model
        gc = self.store.group_cols
        base = stepped.select(*self.ak, *[f"{p}_{s}" for p in m.params for s in ("cur", "prev")])
        if not m.scalars:
            return base
        return base.join(self.per_group(stats.select(*gc, *[f"{s}_{w}" for s in m.scalars for w in ("cur", "prev")])), gc)


def _norm_groups(votes: DataFrame, group_cols) -> tuple[DataFrame, list[str], bool]:
    group_cols = list(group_cols or [])
    if group_cols:
        return votes, group_cols, False
    return votes.withColumn(_G, F.lit(0)), [_G], True


def _accuracy_table(model, state: DataFrame, ak: list[str]) -> DataFrame:
    p = {q: _c(f"{q}_cur") for q in model.params}
    return state.select(*ak, *[p[q].alias(q) for q in model.params], model.accuracy(p).alias("inferred_acc"))


def build_store(votes: DataFrame, group_cols=(), **kw) -> VoteStore:
    """A vote store that several fits can share (bench, sweeps, joint loop)."""
    votes, gcols, _ = _norm_groups(votes, group_cols)
    return VoteStore.build(votes, gcols, **kw)


def fit(votes: DataFrame | VoteStore, model: str = "onecoin", *, prior_mode: str = "textbook",
        max_iter: int = DEFAULT_MAX_ITER, tol: float | None = DEFAULT_TOL,
        prior: DataFrame | None = None, worker_truth: DataFrame | None = None,
        group_cols=(), track_frames: bool = False, init: dict | None = None,
        state: DataFrame | None = None, num_buckets: int | None = None,
        hot_threshold: int | None = None, compacted: bool = False, dense: bool = False,
        truth: DataFrame | None = None, histogram_at=(), bins: int = 10) -> EMResult:
    """Run EM until ``max|Δγ| < tol`` or ``max_iter``.

    ``votes``: (group.., prompt_id, annotator_id, vote) or a built store.
    ``prior``: optional (group.., prompt_id, prior) injected into every E-step (E7).
    ``worker_truth``: optional (group.., annotator_id, true_acc) for the L1 history.
    ``group_cols``: fit every group (configuration) independently in the same
    jobs; a group that converged keeps its parameters while others go on.
    ``tol=None`` runs exactly ``max_iter`` iterations.
    ``dense``: also list the ids below the largest one that have no vote, as
    arrays over 0..max do: γ = 0.5 and the parameters of an empty sum
    (without groups only).
    ``truth``: optional (prompt_id, truth_is_a); the history then also has
    ``label_mse``, ``worker_mse`` and their sum ``em_loss`` (𝓛_EM, which needs
    ``worker_truth``, too) of every iteration.
    ``histogram_at``: iterations for which γ is counted in ``bins`` bins.
    A store that the fit built itself is gone when it returns.
    """
    em_model = make_model(model, prior_mode)
    internal_group = False
    owned = not isinstance(votes, VoteStore)
    if not owned:
        if not votes.group_cols:
            raise ValueError("build a shared store with em.build_store()")
        store = votes
    else:
        votes, gcols, internal_group = _norm_groups(votes, group_cols)
        store = VoteStore.build(votes, gcols, num_buckets=num_buckets, hot_threshold=hot_threshold,
                                compacted=compacted, packed=internal_group and truth is None and not histogram_at)
    gcols = store.group_cols
    internal_group = internal_group or gcols == [_G]
    spark = store.cold.sparkSession
    if prior is not None and internal_group and _G not in prior.columns:
        prior = prior.withColumn(_G, F.lit(0))
    if worker_truth is not None and internal_group and _G not in worker_truth.columns:
        worker_truth = worker_truth.withColumn(_G, F.lit(0))
    if worker_truth is not None:
        # per-annotator table read by every iteration's stats: materialise once
        worker_truth = worker_truth.select(*store.annotator_keys, "true_acc").checkpoint(eager=True)
    if prior is not None and max_iter > 1:
        prior = store.per_prompt(prior.select(*[c for c in prior.columns if c in [*store.prompt_keys, "prior"]]))
    labels = None if truth is None else store.per_prompt(truth.select("prompt_id", F.col("truth_is_a").cast("double")))
    eng = EMEngine(store, em_model, prior, labels)
    st = state if state is not None else eng.initial_state(init)
    counted = set(histogram_at)
    history, frames, hists, frozen = [], [], [], []
    run = eng
    for it in range(1, max_iter + 1):
        stepped = run.step(st, bins if it in counted else None).checkpoint(eager=True)
        stats = run.group_stats(stepped, st, worker_truth)
        if store.single_group:  # one row
            rows = stats.collect()
            stats = spark.createDataFrame(rows, stats.schema)
        else:
            stats = stats.checkpoint(eager=True)
        history.append(stats.withColumn("iteration", F.lit(it)))
        if it in counted:
            hists.append(stats.select(*gcols, F.lit(it).alias("iteration"), F.posexplode("_bins").alias("bin", "n_prompts")))
        nxt = run.with_scalars(stepped, stats)
        if em_model.scalars:
            nxt = nxt.checkpoint(eager=True)
        if track_frames:
            frames.append(_accuracy_table(em_model, nxt, store.annotator_keys)
                          .select(*store.annotator_keys, "inferred_acc").withColumn("iteration", F.lit(it)))
        st = nxt
        if tol is None:
            continue
        done = F.col("max_gamma_shift") < tol
        if store.single_group:
            if rows and rows[0]["max_gamma_shift"] < tol:
                break
            continue
        left = stats.agg(F.count(F.when(done, 1)).alias("done"), F.count(F.when(~done, 1)).alias("active"),
                         F.collect_set(F.when(~done, group_part(gcols))).alias("parts")).first()  # GROUP_PARTS numbers at most
        if left["done"]:
            marked = nxt.join(run.per_group(stats.select(*gcols, done.alias("_done"))), gcols)
            frozen.append((it, marked.filter("_done").drop("_done").checkpoint(eager=True)))
            if not left["active"]:
                st = None
                break
            st = marked.filter("not _done").drop("_done").checkpoint(eager=True)
            run = EMEngine(store.pruned(sorted(left["parts"])), em_model, prior, labels)
    pieces = [f for _, f in frozen] + ([st] if st is not None else [])
    st = reduce(DataFrame.unionByName, pieces)
    trust = eng.posterior_table(st, "prev")
    if owned or truth is not None or isinstance(prior, PromptTable):  # nothing of the store outlives the fit
        trust = trust.checkpoint(eager=True)
    if owned:
        store.drop()
    params = _accuracy_table(em_model, st, store.annotator_keys)
    measures = ["l1_parameter_loss", "max_gamma_shift"] + (["label_mse", "worker_mse", "em_loss"] if truth is not None else [])
    cols = [*gcols, "iteration", *measures, *[F.col(f"{s}_cur").alias(s) for s in em_model.scalars]]
    hist = reduce(DataFrame.unionByName, [h.select(*cols) for h in history])
    gamma_bins = reduce(DataFrame.unionByName, hists).filter("n_prompts > 0") if hists else None
    fr = None
    if frames:
        last = len(history)
        for at, f in frozen:  # a frozen group keeps its parameters in the later frames
            if at < last:
                frames.append(_accuracy_table(em_model, f, store.annotator_keys).select(*store.annotator_keys, "inferred_acc")
                              .withColumn("iteration", F.explode(F.sequence(F.lit(at + 1), F.lit(last)))))
        fr = reduce(DataFrame.unionByName, frames)
    if internal_group:
        trust, params, hist = trust.drop(_G), params.drop(_G), hist.drop(_G)
        gamma_bins = gamma_bins.drop(_G) if gamma_bins is not None else None
        if dense:
            unseen = em_model.unseen_params()
            acc = sum(unseen.values()) / len(unseen)
            trust = dense_ids(trust, "prompt_id", {"trust_weight": INIT_GAMMA})
            params = dense_ids(params, "annotator_id", unseen | {"inferred_acc": acc})
        fr = fr.drop(_G) if fr is not None else None
    return EMResult(trust, params, hist, fr, st, [] if internal_group else gcols, gamma_bins)
