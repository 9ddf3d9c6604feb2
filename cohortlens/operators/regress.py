"""Regression models and metrics (survey H1-H8).

Models are MLlib pipelines (assembler + estimator), trained on executors.
Metrics and residuals are plain aggregates/projections over the scored frame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import keep_existing
from cohortlens.operators.classify import ONE_FOREST, _pipeline, feature_importance
from cohortlens.operators.stages import LinearPredictor


# H1
#: Triangles that one task of the reduction takes together.
_FAN_IN = 16


def tall_qr(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """R of the QR decomposition of a tall table: every partition makes its own triangle, and groups of
    ``_FAN_IN`` triangles are decomposed again until one is left. Only triangles, the square of the number of
    columns, travel; their product with themselves is never formed, so the condition is not squared.

    Rows with a missing value in any column are left out. Signs of rows of R are free."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(["part long", *[f"{c} double" for c in names]])

    def triangle(batches) -> np.ndarray:
        step, held = max(4_096, 4 * len(names)), np.zeros((0, len(names)))
        for batch in batches:
            X = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            X = X[~np.isnan(X).any(axis=1)]
            for a in range(0, len(X), step):
                held = np.linalg.qr(np.vstack([held, X[a:a + step]]), mode="r")
        return held

    def emit(part: int, R: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(R), pa.int64()), *[pa.array(R[:, i]) for i in range(len(names))]], ["part", *names])

    def whole(batches):
        R = triangle(batches)
        if len(R):
            yield emit(TaskContext.get().partitionId(), R)

    def merge(key, table):
        return pa.Table.from_batches([emit(key[0].as_py(), triangle(table.to_batches()))])

    slim = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    parts, left = slim.mapInArrow(whole, schema), slim.rdd.getNumPartitions()
    while left > 1:
        parts = parts.withColumn("part", F.expr(f"part div {_FAN_IN}")).groupBy("part").applyInArrow(merge, schema)
        left = -(-left // _FAN_IN)
    rows = parts.select(*names).collect()
    R = np.array([tuple(r) for r in rows], float).reshape(-1, len(names))
    return np.linalg.qr(R, mode="r") if len(R) else R


def fit_linear(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Ordinary least squares with intercept, by a distributed QR decomposition.

    Near-collinear and constant features are no obstacle: among equally good coefficients the smallest (about the
    columns' means) are taken, as NumPy's ``lstsq`` does. A missing feature is an error, rows without a label are left out."""
    some = train.where(F.col(label).isNotNull())
    given = [F.coalesce(F.col(f"`{c}`").cast("double"), F.raise_error(F.lit(f"missing value in {c}")).cast("double")) for c in features]
    R = tall_qr(some, [F.lit(1.0), *given, F.col(f"`{label}`")])
    d = len(features)
    if len(R) < 1:
        raise ValueError("no row with a label")
    # Behind the row of the constant stands the decomposition of the columns about their means.
    square = np.zeros((d + 2, d + 2))
    square[:len(R)] = R
    w = np.linalg.lstsq(square[1:d + 1, 1:d + 1], square[1:d + 1, d + 1], rcond=np.finfo(float).eps * max(d, 1) * 8)[0]
    intercept = (square[0, d + 1] - square[0, 1:d + 1] @ w) / square[0, 0]
    return PipelineModel([LinearPredictor(inputCols=list(features), coefficients=[float(x) for x in w], intercept=float(intercept))])


# H2
def fit_ridge(train: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> PipelineModel:
    """min ||y - Xw - b||^2 + alpha ||w||^2 with the intercept unpenalised.

    MLlib minimises (1/2n)||.||^2 + (lambda/2)||w||^2 and, with the normal
    solver, scales lambda by the label's population std, so
    ``lambda = alpha * std_pop(y) / n`` reproduces the closed form."""
    row = train.agg(F.count(F.col(label)).alias("n"), F.stddev_pop(label).alias("s")).first()
    n, s = row["n"], row["s"] or 0.0
    reg = alpha * s / n if n and s else 0.0
    est = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                           solver="normal", standardization=False)
    return _pipeline(features, est).fit(train)


# H3
def fit_rf_regressor(train: DataFrame, features: Sequence[str], label: str, n_trees: int = 200,
                     max_depth: int = 8, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    """All features considered at each split (MLlib's default would use a third)."""
    est = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=n_trees, maxDepth=max_depth,
                                featureSubsetStrategy="all", seed=seed, maxBins=max_bins,
                                cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=512)
    with ONE_FOREST:
        return _pipeline(features, est).fit(train)


# H4
def fit_gbt_regressor(train: DataFrame, features: Sequence[str], label: str, n_rounds: int = 150,
                      max_depth: int = 5, rate: float = 0.08, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    est = GBTRegressor(featuresCol="features", labelCol=label, maxIter=n_rounds, maxDepth=max_depth,
                       stepSize=rate, seed=seed, lossType="squared", maxBins=max_bins)
    return _pipeline(features, est).fit(train)


# H5
def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R^2 = 1 - SS_res / SS_tot, MAE, RMSE and n over rows with both values."""
    both = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    y = F.when(both, F.col(label).cast("double"))
    e = F.when(both, F.col(label).cast("double") - F.col(prediction).cast("double"))
    a = pred.agg(F.sum(e * e).alias("ss_res"), (F.var_pop(y) * F.count(y)).alias("ss_tot"),
                 F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(y).alias("n"))
    return a.select((1 - F.col("ss_res") / F.nullif(F.col("ss_tot"), F.lit(0.0))).alias("r2"), "mae", "rmse", "n")


# H6
def regression_importance(models: Mapping[str, PipelineModel], k: int | None = 15) -> DataFrame:
    """Ranked importances per target, each from its own fitted model."""
    parts = [feature_importance(m, k).select(F.lit(t).alias("target"), "*") for t, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# H7
def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              keep: Sequence[str] = ()) -> DataFrame:
    return pred.select(*keep, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                       (F.col(label) - F.col(prediction)).alias("residual"))


# H8
Fitter = Callable[[DataFrame, Sequence[str], str], PipelineModel]

DEFAULT_MODELS: dict[str, Fitter] = {
    "Linear Regression": fit_linear,
    "Ridge": fit_ridge,
    "Random Forest": fit_rf_regressor,
    "Gradient Boosting": fit_gbt_regressor,
}


def fit_targets(train: DataFrame, test: DataFrame, features: Sequence[str], targets: Sequence[str],
                models: Mapping[str, Fitter] | None = None, parallel: int = 4) -> tuple[DataFrame, dict[str, dict[str, PipelineModel]]]:
    """Fit every model on every present target (fresh model per target).

    Returns (metrics table: target, model, r2, mae, rmse, n, is_best) and the
    fitted models. Targets absent from the table are skipped.
    """
    from pyspark.sql import Window
    from cohortlens.operators.cluster import run_parallel
    models = models or DEFAULT_MODELS
    present = keep_existing(train, targets)
    grid = [(t, name) for t in present for name in models]

    def fit_one(t: str, name: str) -> PipelineModel:
        return models[name](train.where(F.col(t).isNotNull()), features, t)

    # Fits are independent: a few run concurrently on the same session.
    done = run_parallel([lambda t=t, n=n: fit_one(t, n) for t, n in grid], parallel)
    fitted: dict[str, dict[str, PipelineModel]] = {}
    parts = []
    for (t, name), m in zip(grid, done):
        fitted.setdefault(t, {})[name] = m
        met = regression_metrics(m.transform(test.where(F.col(t).isNotNull())), t, "prediction")
        parts.append(met.select(F.lit(t).alias("target"), F.lit(name).alias("model"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("target").orderBy(F.col("r2").desc(), "model")  # rows = targets x models
    return out.withColumn("is_best", F.row_number().over(w) == 1), fitted
