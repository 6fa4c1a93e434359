"""E- and M-step over packed votes: a row per prompt with all its votes.

Numpy inside Arrow batches: a prompt's evidence is a sum over a stretch of an
array, an annotator's sums are counts by place.  Each task adds up its own
prompts; Spark adds up the tasks.  The parameters (at most
``BROADCAST_ROW_LIMIT`` annotators) come by broadcast.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not have the package on their path

NO, YES, NEITHER = 0, 1, 2  # a vote for B, for A, and one that is null
FLUSH = 1 << 18  # votes that are added up at once, at least
PRIOR_EPS = 1e-9  # fixed values of the reference models
LEGACY_PRIOR_EPS = 1e-9
SUMS = ("annotator_id long, g_no double, g_yes double, g_none double, h_no double, h_yes double, h_none double, "
        "tot double, _shift double, _gsum double, _gcnt double")


def prior_odds(batch, mode: str | None, has_prior: bool, pi1: float):
    """Log odds of A before any vote; ``mode`` is that of the two-coin model, None with one coin."""
    import numpy as np

    start = 0.5 if mode is None else pi1
    p = batch.column("prior").to_numpy(zero_copy_only=False) if has_prior else start
    p = np.where(np.isnan(p), start, p)
    if mode == "legacy":
        own = np.clip(pi1, PRIOR_EPS, 1.0 - PRIOR_EPS)
        return np.log(p + LEGACY_PRIOR_EPS) + np.log(own) - np.log(1.0 - p + LEGACY_PRIOR_EPS) - np.log(1.0 - own)
    p = np.clip(p, PRIOR_EPS, 1.0 - PRIOR_EPS)
    return np.log(p) - np.log(1.0 - p)


def read(batch, ids):
    """(starts, place, code, n, here) of a batch's votes: where each prompt's
    begin, the annotator's place in ``ids``, the vote, how often it occurs, and
    whether ``ids`` has the annotator (``n`` is 0 if not)."""
    import numpy as np
    import pyarrow.compute as pc

    column = batch.column("annotators")
    starts = (column.offsets.to_numpy() - column.offsets[0].as_py())[:-1]
    who = column.flatten().to_numpy()
    place = np.searchsorted(ids, who)
    place[place == len(ids)] = 0
    here = ids[place] == who if len(ids) else np.zeros(len(who), dtype=bool)
    code = pc.fill_null(batch.column("votes").flatten(), NEITHER).to_numpy().astype(np.int64)
    n = batch.column("ns").flatten().to_numpy().astype(float)
    return starts, place, code, n if here.all() else np.where(here, n, 0.0), here


def posterior(votes, evidence, prior, start: float):
    """P(A) of every prompt: ``prior`` is the log odds before its votes,
    ``evidence`` what a vote in the cell 3 x place + code adds to them.
    ``start`` where there are no parameters yet (NaN)."""
    import numpy as np

    starts, place, code, n, here = votes
    z = evidence[3 * place + code] * n
    z[~here] = 0.0
    z = np.add.reduceat(z, starts) + prior
    with np.errstate(over="ignore"):
        g = 1.0 / (1.0 + np.exp(-z))
    return np.where(np.isnan(z), start, g)


def posterior_task(shared, mode: str | None, has_prior: bool, start: float):
    """(prompt_id, γ) under the current parameters, for prompts with a vote of a known annotator."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, ((now, pi1), _) = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                votes = read(batch, ids)
                g = posterior(votes, now, prior_odds(batch, mode, has_prior, pi1), start)
                has = np.logical_or.reduceat(votes[4], votes[0])
                yield pa.RecordBatch.from_arrays([batch.column("prompt_id").filter(pa.array(has)), pa.array(g[has])], names=["prompt_id", "trust_weight"])

    return run


def step_task(shared, mode: str | None, has_prior: bool, start: float):
    """Sums of a task, see :func:`step`."""

    def run(batches):
        import pyarrow as pa

        ids, ((now, pi1), (before, pi0)) = shared.value
        who, g, h, *rest = step(batches, ids, now, before, lambda b: (prior_odds(b, mode, has_prior, pi1), prior_odds(b, mode, has_prior, pi0)), start)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who, *g.T, *h.T, *rest)], names=[c.split()[0] for c in SUMS.split(", ")])

    return run


def step(batches, ids, now, before, prior_of, start: float):
    """Sums of one task, a row per annotator with votes: the weights n·γ and
    n·(1−γ) per kind of vote, and the votes; the largest |Δγ| of the task; the
    sum and number of the γ of the prompts whose smallest (annotator, vote) is
    theirs.  ``prior_of(batch)``: the prompts' prior log odds, now and before."""
    import numpy as np

    k = len(ids)
    g_sums, h_sums, tot = np.zeros(3 * k), np.zeros(3 * k), np.zeros(k)
    g_led, led, shift, waiting, size = np.zeros(k), np.zeros(k), 0.0, [], 0
    nobody = np.iinfo(np.int64).max

    def flush():
        nonlocal size
        if waiting:
            cell, ng, nh, n, lead, g = (np.concatenate(x) for x in zip(*waiting, strict=True))
            g_sums[:] += np.bincount(cell, ng, 3 * k)
            h_sums[:] += np.bincount(cell, nh, 3 * k)
            tot[:] += np.bincount(cell // 3, n, k)
            g_led[:] += np.bincount(lead, g, k)
            led[:] += np.bincount(lead, minlength=k)
        waiting.clear()
        size = 0

    for batch in batches:
        if not batch.num_rows or not k:
            continue
        votes = read(batch, ids)
        starts, place, code, n, here = votes
        p, p0 = prior_of(batch)
        g = posterior(votes, now, p, start)
        has = np.logical_or.reduceat(here, starts)
        if has.any():
            shift = max(shift, float(np.abs(g - posterior(votes, before, p0, start))[has].max()))
        lead = np.minimum.reduceat(np.where(here & (code != NEITHER), 2 * ids[place] + code, nobody), starts)
        counted = lead != nobody
        own = np.repeat(g, np.diff(np.r_[starts, len(place)]))
        waiting.append((3 * place + code, n * own, n * (1.0 - own), n, np.searchsorted(ids, lead[counted] >> 1), g[counted]))
        size += len(place)
        if size >= max(FLUSH, k):
            flush()
    flush()
    at = np.flatnonzero(tot)
    return (ids[at], g_sums.reshape(k, 3)[at], h_sums.reshape(k, 3)[at], tot[at], np.full(len(at), shift), g_led[at], led[at])
