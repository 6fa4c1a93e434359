"""Preference model fits on MLlib.

The DPO objective with a linear policy is a binomial GLM:

    P(A preferred) = σ(β·[(π_A − π_B) − (ref_A − ref_B)])
                   = σ(w·Δφ + offset),   offset = −β·(ref_A − ref_B)

so minimising the soft-label loss γ·L_A + (1−γ)·L_B (D5) is a binomial
regression with fractional label γ, the frozen reference as an offset and
no intercept.  Two solvers on the cluster:

* up to 4,096 features MLlib's ``GeneralizedLinearRegression`` (IRLS), which
  takes fractional labels and an offset as they are;
* beyond, on sparse features of any width, L-BFGS on the same loss: each step
  is one Spark job that adds up loss and gradient over the partitions.  (MLlib's
  ``LogisticRegression`` has no offset; held in place by equal coefficient
  bounds, its bound-constrained solver had not converged on 2^18 features
  after 300 steps: the largest gradient stayed at 0.13.)

Hard-label baselines, oracle fits and static-EM fits differ only in the
label column.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtrust.functions.columns import sigmoid
from crowdtrust.operators.preference import DEFAULT_BETA
from crowdtrust.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need not have the package on their path


def _labelled(features: DataFrame, logps: DataFrame | None, labels: DataFrame, label_col: str,
              weight: DataFrame | None, beta: float) -> DataFrame:
    """Features with offset, label and weight per prompt.  What is hashed in
    the joins are the numbers; features are neither sorted nor, where they lie
    in buckets by prompt, exchanged."""
    t = features.join(labels.select("prompt_id", F.col(label_col).cast("double").alias("label")).hint("shuffle_hash"), "prompt_id")
    if logps is not None:
        t = t.join(logps.select("prompt_id", (-F.lit(beta) * (F.col("ref_a") - F.col("ref_b"))).alias("offset")).hint("shuffle_hash"),
                   "prompt_id", "left")
        t = t.withColumn("offset", F.coalesce("offset", F.lit(0.0)))
    else:
        t = t.withColumn("offset", F.lit(0.0))
    if weight is not None:
        t = t.join(weight.select("prompt_id", F.col("n").cast("double").alias("weight")).hint("shuffle_hash"), "prompt_id", "left")
        t = t.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        t = t.withColumn("weight", F.lit(1.0))
    return t


def training_table(features: DataFrame, logps: DataFrame | None, labels: DataFrame, label_col: str,
                   weight: DataFrame | None = None, beta: float = DEFAULT_BETA) -> DataFrame:
    """(prompt_id, features vector, offset, label, weight) per prompt.

    ``features``: (prompt_id, phi array<double>[, len_diff]);
    ``logps``: reference log-probs (ref_a, ref_b) for the offset, or None;
    ``labels``: (prompt_id, <label_col>) with values in [0, 1];
    ``weight``: (prompt_id, n) votes per prompt (Q9), default 1."""
    t = _labelled(features, logps, labels, label_col, weight, beta)
    extra = [F.col("len_diff")] if "len_diff" in features.columns else []
    vec = F.concat(F.col("phi"), F.array(*extra)) if extra else F.col("phi")
    return t.select("prompt_id", array_to_vector(vec).alias("features"), "offset", "label", "weight")


def fit_preference_model(train: DataFrame, reg_param: float = 1e-3, max_iter: int = 25,
                         tol: float = 1e-6) -> GeneralizedLinearRegressionModel:
    """Soft-label preference regression (binomial GLM, offset, no intercept)."""
    glr = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False, offsetCol="offset",
                                      weightCol="weight", labelCol="label", featuresCol="features",
                                      regParam=reg_param, maxIter=max_iter, tol=tol)
    rows = train.select("features", "offset", "label", "weight").persist(StorageLevel.MEMORY_AND_DISK)  # read in every step
    try:
        return glr.fit(rows)
    finally:
        rows.unpersist()


# ------------------------------------------------------------------ wide feature spaces
def wide_training_table(features: DataFrame, num_features: int, logps: DataFrame | None, labels: DataFrame, label_col: str,
                        weight: DataFrame | None = None, beta: float = DEFAULT_BETA) -> DataFrame:
    """(prompt_id, indices, values, offset, label, weight) from sparse pair
    features (prompt_id, indices, values[, len_diff]); ``len_diff``, where
    there is one, becomes feature ``num_features``."""
    t = _labelled(features, logps, labels, label_col, weight, beta)
    if "len_diff" in t.columns:
        t = t.withColumns({"indices": F.concat("indices", F.array(F.lit(num_features))), "values": F.concat("values", F.array("len_diff"))})
    return t.select("prompt_id", "indices", "values", "offset", "label", "weight")


def _products(batch, w):
    """(row, index, value) of a batch's sparse features and w·x of each row."""
    import numpy as np

    column = batch.column("indices")
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    index = column.flatten().to_numpy()
    value = batch.column("values").flatten().to_numpy()
    return row, index, value, np.bincount(row, weights=w[index] * value, minlength=len(size))


#: The columns of a block and the kind of their numbers; ``size`` is how many features each row has.
_BLOCK = {"size": "int64", "indices": "int32", "values": "float64", "offset": "float64", "label": "float64", "weight": "float64"}
GRADIENT_PIECE = 1 << 13  # numbers in a row of a gradient on its way
BLOCK_VALUES = 1 << 19  # values in a block, at most (a larger row is a block of its own)


def _blocks(batches):
    """The rows of each batch as few rows of plain arrays: no list is put together again for a step."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        column = batch.column("indices")
        ends = column.offsets.to_numpy()
        own = [column.flatten().to_numpy(), batch.column("values").flatten().to_numpy(), *(batch.column(c).to_numpy() for c in ("offset", "label", "weight"))]
        ends, at, blocks = ends - ends[0], 0, []
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_VALUES, "right")) - 1)
            i, j = ends[at], ends[to]
            blocks.append([np.diff(ends[at:to + 1]).astype("int64"), own[0][i:j], own[1][i:j], *(x[at:to] for x in own[2:])])
            at = to
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(
            zip(*blocks) if blocks else [[]] * len(_BLOCK), _BLOCK.values(), strict=True)], names=list(_BLOCK))


@dataclass
class WidePreferenceModel:
    """w of a fitted wide model, and the largest gradient of its objective at the end."""

    weights: object
    gradient: float
    steps: int

    def probability(self, table: DataFrame) -> DataFrame:
        """(prompt_id, p_a, beta_z): P(A preferred) and w·Δφ, the logit without the offset."""
        shared = table.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("prompt_id"), pa.array(_products(batch, shared.value)[3]), batch.column("offset")],
                                                 names=["prompt_id", "beta_z", "offset"])

        z = table.select("prompt_id", "indices", "values", "offset").mapInArrow(run, "prompt_id long, beta_z double, offset double")
        return z.select("prompt_id", sigmoid(F.col("beta_z") + F.col("offset")).alias("p_a"), "beta_z")


def fit_wide_preference_model(train: DataFrame, width: int, reg_param: float = 1e-3, max_iter: int = 200, tol: float = 1e-6,
                              memory: int = 10) -> WidePreferenceModel:
    """T1 on ``width`` sparse features (:func:`wide_training_table`): minimises
    the weighted mean of the soft-label loss plus reg_param/2·|w|², the offset
    added to the logit, until no feature's gradient is over ``tol``.

    The driver keeps 2 x ``memory`` vectors of that width.  Rows are written
    once as blocks of plain arrays (:func:`_blocks`), which a step reads as they
    are, in a task per core; a task sends its gradient in a few pieces, which
    Spark adds up."""
    import numpy as np

    spark = train.sparkSession
    rows = written(train.select("indices", "values", "offset", "label", "weight").mapInArrow(_blocks, ", ".join(f"{c} binary" for c in _BLOCK)), "wide_blocks")
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)  # as many gradients are added up, however many rows there are
    total = float(train.agg(F.sum("weight")).first()[0] or 1.0)

    kinds, piece = _BLOCK, GRADIENT_PIECE

    def evaluate(w):
        shared = spark.sparkContext.broadcast(w)

        def run(batches):
            import pyarrow as pa

            loss, gradient = 0.0, np.zeros(width)
            now = shared.value
            for batch in batches:
                for block in zip(*(batch.column(c) for c in kinds), strict=True):
                    size, index, value, offset, label, weight = (np.frombuffer(x.as_buffer(), kinds[c]) for c, x in zip(kinds, block, strict=True))
                    z, some = offset.copy(), size > 0
                    if some.any():
                        z[some] += np.add.reduceat(now[index] * value, (np.cumsum(size) - size)[some])
                    loss += float((weight * (np.logaddexp(0, z) - label * z)).sum())
                    error = weight * (np.exp(-np.logaddexp(0, -z)) - label)
                    gradient += np.bincount(index, weights=np.repeat(error, size) * value, minlength=width)
            sums = np.r_[loss, gradient]
            pieces = [sums[k:k + piece].tobytes() for k in range(0, len(sums), piece)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["k", "sums"])

        def add(table):
            import pyarrow as pa

            total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
            return pa.table({"k": table.column("k")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        kind = "k int, sums binary"
        got = rows.mapInArrow(run, kind).groupBy("k").applyInArrow(add, kind).toArrow()  # width + 1 numbers
        shared.destroy()
        sums = np.zeros(width + 1)
        for k, x in zip(got.column("k").to_pylist(), got.column("sums"), strict=True):
            own = np.frombuffer(x.as_buffer())
            sums[k * piece:k * piece + len(own)] = own
        return float(sums[0]) / total + reg_param / 2 * float(w @ w), reg_param * w + sums[1:] / total

    w = np.zeros(width)
    loss, g = evaluate(w)
    pairs: list = []
    step = 0
    while step < max_iter and np.abs(g).max(initial=0.0) > tol:
        step += 1
        d, used = -g, []
        for s, y, r in reversed(pairs):  # the two loops of L-BFGS
            used.append(r * (s @ d))
            d = d - used[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - r * (y @ d)) * s
        length = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).max())
        slope = float(g @ d)
        while True:
            new = w + length * d
            new_loss, new_g = evaluate(new)
            if new_loss <= loss + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        s, y = new - w, new_g - g
        if s @ y > 1e-14 * float(np.sqrt((s @ s) * (y @ y))):
            pairs = [*pairs, (s, y, 1.0 / (s @ y))][-memory:]
        if new_loss >= loss and length < 1e-10:
            break
        w, loss, g = new, new_loss, new_g
    return WidePreferenceModel(w, float(np.abs(g).max(initial=0.0)), step)


def loss_gradient(train: DataFrame, model: WidePreferenceModel, reg_param: float) -> DataFrame:
    """(index, gradient) of the objective of :func:`fit_wide_preference_model`
    for every feature that occurs, by joins and sums of its own.  At the
    minimum all are zero."""
    scored = model.probability(train).select("prompt_id", "p_a").join(train, "prompt_id")
    total = F.lit(float(train.agg(F.sum("weight")).first()[0]))
    terms = scored.select((F.col("weight") * (F.col("p_a") - F.col("label"))).alias("e"), F.explode(F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("x"))).alias("z"))
    sums = terms.groupBy(F.col("z.i").alias("index")).agg((F.sum(F.col("e") * F.col("z.x")) / total).alias("g"))
    # the coefficients that are not zero: a row each
    own = train.sparkSession.createDataFrame([(int(i), float(model.weights[i])) for i in model.weights.nonzero()[0]], "index int, w double")
    return sums.join(own, "index", "left").select("index", (F.col("g") + F.lit(reg_param) * F.coalesce("w", F.lit(0.0))).alias("gradient"))


def predict_prior(model: GeneralizedLinearRegressionModel, table: DataFrame) -> DataFrame:
    """P(A preferred) per prompt from a fitted model (the next EM prior, D3)."""
    return model.transform(table).select("prompt_id", F.col("prediction").alias("prior"),
                                         (F.col("offset")).alias("offset"))


def policy_logps_from_model(model: GeneralizedLinearRegressionModel, table: DataFrame,
                            beta: float = DEFAULT_BETA) -> DataFrame:
    """The fitted policy as a log-ratio table: ``pi_diff`` = π_A − π_B and
    ``ref_diff`` = ref_A − ref_B, so that β·(pi_diff − ref_diff) = w·Δφ."""
    terms = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(c)) for c in model.coefficients]), lambda x, w: x * w)
    wx = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    ref_diff = -F.col("offset") / F.lit(beta)
    return table.select("prompt_id", wx.alias("_wx"), ref_diff.alias("ref_diff")).select(
        "prompt_id", (F.col("_wx") / F.lit(beta) + F.col("ref_diff")).alias("pi_diff"), "ref_diff", F.col("_wx").alias("beta_z"))


def baseline_labels(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T3 baseline: hard crowd votes.  Summing the hard-label loss over a
    prompt's votes equals n × the soft loss with label = share of A votes,
    so the per-vote fit is a per-prompt fit with label = share, weight = n."""
    g = votes.groupBy("prompt_id").agg(F.avg("vote").alias("share"), F.count(F.lit(1)).alias("n"))
    return g.select("prompt_id", "share"), g.select("prompt_id", "n")


def save_model(model: GeneralizedLinearRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_and_score(path: str, table: DataFrame) -> DataFrame:
    """T5: batch preference inference with a saved model."""
    m = GeneralizedLinearRegressionModel.load(path)
    out = m.transform(table)
    return out.select("prompt_id", F.col("prediction").alias("p_a"),
                      (F.col("prediction") > 0.5).cast("int").alias("prefers_a"))
