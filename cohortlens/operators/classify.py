"""Binary classification: MLlib tree models and evaluation tables
(survey G1-G12; exact k-NN is in ``neighbours``).

Evaluation works on any scored frame (label, prediction, score) and is
expressed as aggregates; ROC points and AUC aggregate per distinct score
first and then use range-partitioned running totals, so nothing is sorted
in a single task.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import classify_by_prefix
from cohortlens.operators.neighbours import knn_classify, knn_neighbors, knn_pairs  # noqa: F401  (G1)
from cohortlens.operators.ranking import ordered_cumsum
from cohortlens.session import written as _written


# G2-G5 ---------------------------------------------------------------------

def _pipeline(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features",
                                            handleInvalid="error"), estimator])


def fit_decision_tree(train: DataFrame, features: Sequence[str], label: str, max_depth: int = 7,
                      min_leaf: int = 10, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    """Depth 7, at least 10 rows per leaf (which implies the reference's
    minimum of 20 rows to split)."""
    est = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=max_depth,
                                 minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed,
                                 cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=512)
    return _pipeline(features, est).fit(train)


#: A forest keeps two numbers for each tree and row while it grows (bags and node ids), so forests of one session grow one
#: after another; each has a task a core.
ONE_FOREST = threading.Lock()


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, n_trees: int = 200,
                      max_depth: int = 10, min_leaf: int = 5, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    # Deep trees: node ids cached per row (trees are not shipped to executors
    # each level), checkpointed every 10 levels; larger histogram memory.
    est = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=n_trees, maxDepth=max_depth,
                                 minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed,
                                 maxBins=max_bins, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=512)
    with ONE_FOREST:
        return _pipeline(features, est).fit(train)


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, n_rounds: int = 150, max_depth: int = 5,
            rate: float = 0.08, seed: int = 42, max_bins: int = 64) -> PipelineModel:
    est = GBTClassifier(labelCol=label, featuresCol="features", maxIter=n_rounds, maxDepth=max_depth,
                        stepSize=rate, seed=seed, maxBins=max_bins)
    return _pipeline(features, est).fit(train)


def predict(model: PipelineModel, df: DataFrame, score: str = "score") -> DataFrame:
    """Class prediction plus the probability of class 1 as ``score``."""
    out = model.transform(df)
    return out.withColumn(score, vector_to_array(F.col("probability"))[1]).withColumn(
        "prediction", F.col("prediction").cast("int"))


# G6-G8 ---------------------------------------------------------------------

def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             by: str | None = None) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    if by is None:
        return pred.agg(F.avg(hit).alias("accuracy"))
    return pred.groupBy(by).agg(F.avg(hit).alias("accuracy"))


def precision_recall_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                        positive=1) -> DataFrame:
    """Positive-class precision, recall and F1; 0 where undefined."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / F.nullif(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(0))
    return c.select("tp", "fp", "fn", "tn", acc.alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     labels: Sequence = (0, 1)) -> DataFrame:
    """(actual, predicted, n) for every label pair; empty cells give 0."""
    spark = pred.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], ["actual", "predicted"]).select(
        F.col("actual").cast(pred.schema[label].dataType), F.col("predicted").cast(pred.schema[prediction].dataType))
    counts = pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    # The grid is |labels|^2 rows of driver data.
    return (grid.join(F.broadcast(counts.where(F.col("actual").isin(list(labels)) & F.col("predicted").isin(list(labels)))), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("actual", "predicted"))


# G9-G10 --------------------------------------------------------------------

def _score_counts(pred: DataFrame, score: str, label: str, positive) -> DataFrame:
    return pred.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) != positive).alias("neg"))


def roc_curve(pred: DataFrame, score: str = "score", label: str = "label", positive=1,
              drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, descending, plus the
    (0, 0) start with a NULL threshold. ``drop_intermediate`` removes points
    collinear with both neighbours (scikit-learn's default): a point goes when
    the next lower score adds the same positives and negatives as it did;
    the first and last points always stay."""
    # One row per distinct score, written once: the predictions are evaluated for it and not again for splitters, sums and totals.
    sc = _written(_score_counts(pred, score, label, positive), "score-counts")
    cum = ordered_cumsum(sc, "threshold", ["pos", "neg"], descending=True,
                         next_cols=["pos", "neg"] if drop_intermediate else ())
    if drop_intermediate:
        first = (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))
        same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        cum = cum.where(first | F.col("next_pos").isNull() | ~same)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    pts = cum.select("threshold", (F.col("neg_cum") / F.nullif(N, F.lit(0))).alias("fpr"),
                     (F.col("pos_cum") / F.nullif(P, F.lit(0))).alias("tpr"))
    start = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(pred: DataFrame, score: str = "score", label: str = "label", positive=1) -> DataFrame:
    """Area under the ROC curve (ties count one half), i.e. the Mann-Whitney
    statistic from per-score counts; NULL when a class is absent."""
    # One row per distinct score, persisted: the range splitters and the
    # running sums both read it, so the predictions (often a costly model
    # transform) are evaluated once. The answer is one number.
    sc = _score_counts(pred, score, label, positive).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cum = ordered_cumsum(sc, "threshold", ["neg"], descending=False)
        # neg_cum - neg = negatives strictly below this score.
        part = cum.agg(F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + 0.5 * F.col("neg"))).alias("u"),
                       F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        row = part.select((F.col("u") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("auc")).first()
    finally:
        sc.unpersist()
    return pred.sparkSession.range(1).select(F.lit(row["auc"]).cast("double").alias("auc"))


# G11-G12 -------------------------------------------------------------------

def feature_importance(model: PipelineModel, k: int | None = 15, rules: Sequence[tuple[str, str]] = (),
                       default: str = "Feature") -> DataFrame:
    """Ranked importances of the fitted tree stage, with a provenance label."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = assembler.getInputCols()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = model.stages[-1].sparkSession if hasattr(model.stages[-1], "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    # d rows (one per model feature): driver data of known size.
    df = spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")
    df = df.withColumn("kind", classify_by_prefix("feature", rules, default))
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(k) if k else df


def compare_models(scored: Mapping[str, DataFrame], label: str = "label", prediction: str = "prediction",
                   score: str | None = "score", is_test: str | None = None) -> DataFrame:
    """One metrics row per model (accuracy, precision, recall, F1, AUC and
    train accuracy when the boolean ``is_test`` marks the hold-out rows) plus ``is_best`` by F1
    (ties -> model name).

    Every scored frame is evaluated once: what the metrics need of its rows is written, and all metrics read that."""
    rows = []
    for name, pred in scored.items():
        used = [label, prediction, *([score] if score else []), *([is_test] if is_test else [])]
        pred = _written(pred.select(*used), "scored")
        test = pred.where(F.col(is_test)) if is_test else pred
        m = precision_recall_f1(test, label, prediction).select("accuracy", "precision", "recall", "f1")
        # One-row results are attached as scalar subqueries, not joins.
        auc = roc_auc(test, score, label).select("auc").scalar() if score else F.lit(None).cast("double")
        m = m.withColumn("auc", auc)
        if is_test:
            tr = accuracy(pred.where(~F.col(is_test)), label, prediction).select("accuracy").scalar()
            m = m.withColumn("train_accuracy", tr)
        rows.append(m.select(F.lit(name).alias("model"), "*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    w = Window.orderBy(F.col("f1").desc(), F.col("model"))  # one row per model
    return out.withColumn("is_best", F.row_number().over(w) == 1)
