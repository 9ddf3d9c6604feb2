"""Registered feature, classification, regression and clustering queries
(survey F-I, A5, A6).

Deterministic parts (splits, z-scores, exact k-NN, evaluation tables,
silhouette, Davies-Bouldin, segment naming) have oracle SQL. Fitted MLlib
models are not bit-comparable with any SQL; their queries return small
metric tables and are covered by invariant tests instead.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark import SparkContext
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.functions.columns import fill_nulls, numeric_features
from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import features as fe
from cohortlens.operators import regress as rg
from cohortlens.operators import stages as sg
from cohortlens.plans.oracle import with_profile
from cohortlens.plans.registry import query, r6
from cohortlens.session import release, scratch_path, written
from cohortlens.sources import io
from cohortlens.sources.views import profile

LEAKAGE = ["id", "target_amount", "target_flag", "tier_code"]
SEED = 42
ZSCORE_COLS = ["balance", "avg_price", "qty", "n_parts"]
REG_TARGETS = ["target_amount", "score_1_10"]
REG_LEAKAGE = LEAKAGE + ["score_1_10", "n_urgent"]

_cache: dict = {}
_locks: defaultdict = defaultdict(threading.Lock)


def _memo(key, fn):
    """Per-session memo for fitted models and cached training frames (several
    queries share one fit); keyed by the application so a new session never
    sees frames of a stopped one. Sections of one run that want the same wait for the first."""
    key = (SparkContext.getOrCreate().applicationId,) + tuple(key)
    with _locks[key]:
        if key not in _cache:
            _cache[key] = fn()
    return _cache[key]


# ------------------------------------------------------------------ shared

def _profile(spark, root):
    """The profile for queries that read it more than once: its joins are computed once a session."""
    def build():
        p = written(profile(spark, root), "profile")
        release(spark)
        return p
    return _memo(("profile", root), build)


def _clf_frame(p):
    p = p.where(F.col("target_flag").isNotNull())
    feats = numeric_features(p, exclude=LEAKAGE)
    return fill_nulls(p, feats, 0), feats


def _clf_split(spark, root):
    def build():
        p, feats = _clf_frame(_profile(spark, root))
        return _ready(fe.stratified_split(p, "id", "target_flag", 0.2, SEED)), feats
    return _memo(("clf_split", root), build)


def _ready(df):
    """A training set, sized and cached once."""
    out = fe.size_partitions(df).cache()
    out.count()
    return out


def _scored_sql(score: str, cut: str, where: str = "") -> str:
    return (f"SELECT id, target_flag AS label, round(CAST({score} AS DOUBLE) / 30.0, 6) AS score, "
            f"CAST(round(CAST({score} AS DOUBLE) / 30.0, 6) >= {cut} AS INTEGER) AS prediction "
            f"FROM profile WHERE target_flag IS NOT NULL {where}")


def _scored(spark, root, col="n_orders", cut=0.333):
    p = profile(spark, root).where(F.col("target_flag").isNotNull())
    s = F.round(F.col(col).cast("double") / 30.0, 6)
    return p.select("id", F.col("target_flag").alias("label"), s.alias("score"),
                    (s >= cut).cast("int").alias("prediction"))


# ----------------------------------------------------------------- F features

_FEATURES = ["region_code", "balance", "n_orders", "avg_price", "max_price", "n_urgent", "n_closed", "qty", "avg_discount", "n_parts", "n_returned", "score_1_10"]


@query("assemble", sql=with_profile(
    "SELECT id, CAST(i AS INTEGER) AS place, round(x, 6) AS value FROM (SELECT id, unnest(["
    + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in _FEATURES) + f"]) AS x, unnest(range(0, {len(_FEATURES)})) AS i FROM profile WHERE target_flag IS NOT NULL) f"))
def q_assemble(spark, root):
    """The feature vector of every row, one line per place."""
    p, feats = _clf_frame(profile(spark, root))
    return r6(fe.assemble(p, feats).select("id", F.posexplode(vector_to_array("features")).alias("place", "value")))


_Z_SQL = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}" for c in ZSCORE_COLS)


@query("zscore", sql=with_profile(f"SELECT id, {_Z_SQL} FROM profile"))
def q_zscore(spark, root):
    p = profile(spark, root).select("id", *ZSCORE_COLS)
    return r6(fe.zscore(p, ZSCORE_COLS))


_SPLIT_SQL = """
, cnt AS (SELECT target_flag, count(*) AS c FROM profile WHERE target_flag IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(c) AS n, CAST(ceil(0.2 * sum(c)) AS BIGINT) AS n_test FROM cnt),
q AS (SELECT target_flag, c, floor(c * (n - n_test) / n) AS fl,
             c * (n - n_test) / n - floor(c * (n - n_test) / n) AS rem, n, n_test FROM cnt, tot),
q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, target_flag) AS rr,
              (n - n_test) - sum(fl) OVER () AS extra FROM q),
quota AS (SELECT target_flag, c - (fl + CASE WHEN rr <= extra THEN 1 ELSE 0 END) AS q_test FROM q2),
sp AS (SELECT p.*, row_number() OVER (PARTITION BY p.target_flag ORDER BY md5('42:' || CAST(p.id AS VARCHAR)), p.id)
              <= quota.q_test AS is_test FROM profile p JOIN quota ON p.target_flag = quota.target_flag)"""


@query("stratified_split", sql=with_profile(_SPLIT_SQL + " SELECT id, target_flag, is_test FROM sp"))
def q_stratified_split(spark, root):
    p = profile(spark, root).select("id", "target_flag")
    return fe.stratified_split(p, "id", "target_flag", 0.2, SEED)


@query("random_split", sql=(
    "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) "
    "<= CAST(ceil(0.2 * count(*) OVER ()) AS BIGINT) AS is_test FROM orders"))
def q_random_split(spark, root):
    o = io.read_table(spark, root, "orders").select("o_orderkey")
    return fe.random_split(o, "o_orderkey", 0.2, SEED)


# ----------------------------------------------------------- G classification

_DIST = "sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))))"
_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query("knn_neighbors", sql=(
    f"WITH {_EMB}, pairs AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, {_DIST} AS dist FROM e a, e b) "
    "SELECT test_id, train_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rank FROM pairs) t WHERE rank <= 9"))
def q_knn_neighbors(spark, root):
    e = io.read_table(spark, root, "embeddings")
    nb = clf.knn_neighbors(e, e, "embedding", 9, "vec_id", "vec_id")
    return r6(nb.select("test_id", "train_id", "dist", "rank"))


_EMB_SPLIT = ("s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) "
              "<= CAST(ceil(0.2 * count(*) OVER ()) AS BIGINT) AS is_test FROM e)")


@query("knn_pruned", sql=(
    f"WITH {_EMB}, pairs AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, {_DIST} AS dist FROM e a JOIN e b ON a.vec_id % 5 = 0) "
    "SELECT test_id, train_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rank FROM pairs) t WHERE rank <= 9"))
def q_knn_pruned(spark, root):
    """A stated fifth of the rows as queries against all rows, by many pivots."""
    e = io.read_table(spark, root, "embeddings")
    nb = clf.knn_neighbors(e, e.where("vec_id % 5 = 0"), "embedding", 9, "vec_id", "vec_id", cells=48)
    return r6(nb.select("test_id", "train_id", "dist", "rank"))


@query("knn_pairs")
def q_knn_pairs(spark, root):
    """The share of all pairs that bounds leave to be compared: z-scored customer features, and the embeddings."""
    z = _cluster_frame(spark, root)
    e = io.read_table(spark, root, "embeddings")
    parts = [clf.knn_pairs(z, z, CLUSTER_COLS, 9, cells=48).select(F.lit("profile").alias("points"), "*"),
             clf.knn_pairs(e, e, "embedding", 9, "vec_id", "vec_id", cells=48).select(F.lit("embeddings").alias("points"), "*")]
    return r6(parts[0].unionByName(parts[1]))


@query("knn_classify", sql=(
    f"WITH {_EMB}, {_EMB_SPLIT}, "
    f"pairs AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, b.label AS nb_label, {_DIST} AS dist "
    "FROM s a JOIN s b ON a.is_test AND NOT b.is_test), "
    "nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rk "
    "FROM pairs) t WHERE rk <= 9), "
    "votes AS (SELECT test_id, nb_label, count(*) AS n FROM nb GROUP BY 1, 2), "
    "best AS (SELECT test_id, nb_label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY test_id "
    "ORDER BY n DESC, nb_label) AS r FROM votes) t WHERE r = 1), "
    "sc AS (SELECT test_id, count(*) FILTER (WHERE nb_label = 1) / count(*) AS score FROM nb GROUP BY 1) "
    "SELECT best.test_id, e.label, best.prediction, round(sc.score, 6) AS score FROM best JOIN sc USING (test_id) "
    "JOIN e ON e.vec_id = best.test_id"))
def q_knn_classify(spark, root):
    e = io.read_table(spark, root, "embeddings")
    sp = fe.random_split(e, "vec_id", 0.2, SEED)
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    pred = clf.knn_classify(train, test, "embedding", "label", 9, "vec_id", "vec_id")
    out = pred.join(e.select(F.col("vec_id").alias("test_id"), "label"), "test_id")
    return r6(out.select("test_id", "label", "prediction", "score"))


@query("accuracy", sql=with_profile(f", sc AS ({_scored_sql('n_orders', '0.333')}) "
                                    "SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM sc"))
def q_accuracy(spark, root):
    return r6(clf.accuracy(_scored(spark, root)))


_PRF_SQL = ("SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, "
            "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, "
            "round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, "
            "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ("
            "SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, "
            "count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp, "
            "count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, "
            "count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn FROM sc) c")


@query("precision_recall_f1", sql=with_profile(f", sc AS ({_scored_sql('n_orders', '0.333')}) " + _PRF_SQL))
def q_precision_recall_f1(spark, root):
    return r6(clf.precision_recall_f1(_scored(spark, root)))


@query("confusion_matrix", sql=with_profile(
    f", sc AS ({_scored_sql('n_orders', '0.333')}), g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) "
    "v(actual, predicted)), c AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM sc GROUP BY 1, 2) "
    "SELECT g.actual, g.predicted, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (actual, predicted)"))
def q_confusion_matrix(spark, root):
    return clf.confusion_matrix(_scored(spark, root))


_SC_COUNTS = ("cnt AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, "
              "count(*) FILTER (WHERE label <> 1) AS neg FROM sc WHERE score IS NOT NULL GROUP BY score)")


@query("roc_curve", sql=with_profile(
    f", sc AS ({_scored_sql('n_orders', '0.333')}), {_SC_COUNTS}, "
    "t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM cnt), "
    "c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp, "
    "sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM cnt) "
    "SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
    "SELECT threshold, round(fp / t.n, 6) AS fpr, round(tp / t.p, 6) AS tpr FROM c, t"))
def q_roc_curve(spark, root):
    return r6(clf.roc_curve(_scored(spark, root)))


@query("roc_curve_drop_intermediate", sql=with_profile(
    f", sc AS ({_scored_sql('n_parts', '1.5')}), {_SC_COUNTS}, "
    "t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM cnt), "
    "c AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp, "
    "sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp, "
    "lead(pos) OVER (ORDER BY threshold DESC) AS npos, lead(neg) OVER (ORDER BY threshold DESC) AS nneg, "
    "row_number() OVER (ORDER BY threshold DESC) AS rn FROM cnt) "
    "SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL "
    "SELECT threshold, round(fp / t.n, 6) AS fpr, round(tp / t.p, 6) AS tpr FROM c, t "
    "WHERE rn = 1 OR npos IS NULL OR NOT (npos = pos AND nneg = neg)"))
def q_roc_curve_drop_intermediate(spark, root):
    return r6(clf.roc_curve(_scored(spark, root, "n_parts", 1.5), drop_intermediate=True))


def _auc_sql(sc_sql: str) -> str:
    return (f", sc AS ({sc_sql}), {_SC_COUNTS}, "
            "c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING) - neg AS below FROM cnt) "
            "SELECT round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM c")


@query("roc_auc", headline=True, sql=with_profile(_auc_sql(_scored_sql("n_orders", "0.333"))))
def q_roc_auc(spark, root):
    return r6(clf.roc_auc(_scored(spark, root)))


def _model_metrics_sql(name: str, col: str, cut: str) -> str:
    sc = _scored_sql(col, cut)
    return (
        f"SELECT '{name}' AS model, m.accuracy, m.precision, m.recall, m.f1, a.auc FROM "
        "(SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, "
        "coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 "
        "FROM (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, "
        "count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp, "
        "count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, "
        f"count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn FROM ({sc}) s1) c) m, "
        "(SELECT sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM ("
        "SELECT pos, neg, sum(neg) OVER (ORDER BY threshold ROWS UNBOUNDED PRECEDING) - neg AS below FROM ("
        "SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
        f"FROM ({sc}) s2 WHERE score IS NOT NULL GROUP BY score) cnt) c2) a")


@query("compare_models", sql=with_profile(
    ", allm AS (" + _model_metrics_sql("orders", "n_orders", "0.333") + " UNION ALL "
    + _model_metrics_sql("parts", "n_parts", "1.5") + ") "
    "SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, round(auc, 6) AS auc, row_number() OVER (ORDER BY f1 DESC, model) = 1 AS is_best FROM allm"))
def q_compare_models(spark, root):
    scored = {"orders": _scored(spark, root, "n_orders", 0.333), "parts": _scored(spark, root, "n_parts", 1.5)}
    return r6(clf.compare_models(scored))


def _fitted_classifiers(spark, root):
    def build():
        sp, feats = _clf_split(spark, root)
        train = sp.where(~F.col("is_test"))
        fits = {
            "Decision Tree": lambda: clf.fit_decision_tree(train, feats, "target_flag", seed=SEED),
            "Random Forest": lambda: clf.fit_random_forest(train, feats, "target_flag", seed=SEED),
            "Gradient Boosting": lambda: clf.fit_gbt(train, feats, "target_flag", seed=SEED),
        }
        models = dict(zip(fits, cl.run_parallel(list(fits.values()), 3)))
        return sp, feats, models
    return _memo(("clf", root), build)


def _classifier_report(spark, root, names):
    sp, feats, models = _fitted_classifiers(spark, root)
    scored = {n: clf.predict(models[n], sp).withColumnRenamed("target_flag", "label") for n in names}
    return r6(clf.compare_models(scored, is_test="is_test"))


@query("fit_decision_tree")
def q_fit_decision_tree(spark, root):
    return _classifier_report(spark, root, ["Decision Tree"])


@query("fit_random_forest")
def q_fit_random_forest(spark, root):
    return _classifier_report(spark, root, ["Random Forest"])


@query("fit_gbt")
def q_fit_gbt(spark, root):
    return _classifier_report(spark, root, ["Gradient Boosting"])


@query("knn_on_features")
def q_knn_on_features(spark, root):
    """k-NN on z-scored customer features (scaler fitted on train only)."""
    sp, feats = _clf_split(spark, root)
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    stats = fe.fit_zscore(train, feats)
    ztr, zte = fe.apply_zscore(train, stats), fe.apply_zscore(test, stats)
    pred = clf.knn_classify(ztr, zte, feats, "target_flag", 9, "id", "id")
    scored = pred.join(test.select(F.col("id").alias("test_id"), F.col("target_flag").alias("label")), "test_id")
    return r6(clf.compare_models({"KNN": scored}))


@query("predict")
def q_predict(spark, root):
    sp, feats, models = _fitted_classifiers(spark, root)
    return r6(clf.predict(models["Random Forest"], sp.where(F.col("is_test"))).select("id", "prediction", "score"))


# How a profile column came about, by its prefix.
PROVENANCE_RULES = [("n_", "Count"), ("avg_", "Average"), ("max_", "Maximum")]


@query("feature_importance")
def q_feature_importance(spark, root):
    _, _, models = _fitted_classifiers(spark, root)
    return r6(clf.feature_importance(models["Random Forest"], 15, PROVENANCE_RULES, "Attribute"))


def _knn_scored(spark, root):
    """Every row scored by its nine nearest training rows (a training row is its own nearest)."""
    sp, feats = _clf_split(spark, root)
    train = sp.where(~F.col("is_test"))
    stats = fe.fit_zscore(train, feats)
    pred = clf.knn_classify(fe.apply_zscore(train, stats), fe.apply_zscore(sp, stats), feats, "target_flag", 9, "id", "id")
    return pred.join(sp.select(F.col("id").alias("test_id"), F.col("target_flag").alias("label"), "is_test"), "test_id")


@query("classifier_comparison")
def q_classifier_comparison(spark, root):
    """All four classifiers on the same hold-out rows."""
    (sp, feats, models), knn = cl.run_parallel([lambda: _fitted_classifiers(spark, root), lambda: _knn_scored(spark, root)], 2)
    scored = {n: clf.predict(m, sp).withColumnRenamed("target_flag", "label") for n, m in models.items()}
    scored["KNN"] = knn
    return r6(clf.compare_models(scored, is_test="is_test"))


@query("fitted_confusion_matrix")
def q_fitted_confusion_matrix(spark, root):
    """Confusion matrix of the fitted random forest on the hold-out rows."""
    sp, _, models = _fitted_classifiers(spark, root)
    pred = clf.predict(models["Random Forest"], sp.where(F.col("is_test"))).withColumnRenamed("target_flag", "label")
    return clf.confusion_matrix(pred)


@query("fitted_roc_curve")
def q_fitted_roc_curve(spark, root):
    """ROC points of the fitted random forest on the hold-out rows."""
    sp, _, models = _fitted_classifiers(spark, root)
    pred = clf.predict(models["Random Forest"], sp.where(F.col("is_test"))).withColumnRenamed("target_flag", "label")
    return r6(clf.roc_curve(pred))


@query("accuracy_by_split", sql=with_profile(
    ", s AS (SELECT id % 5 = 0 AS is_test, target_flag AS label, CASE WHEN id % 5 = 0 THEN CASE WHEN n_orders >= 12 THEN 1 ELSE 0 END "
    "ELSE target_flag END AS p FROM profile WHERE target_flag IS NOT NULL) "
    "SELECT 'rule' AS model, round(avg(CASE WHEN label = p THEN 1.0 ELSE 0.0 END) FILTER (is_test), 6) AS accuracy, "
    "round(avg(CASE WHEN label = p THEN 1.0 ELSE 0.0 END) FILTER (NOT is_test), 6) AS train_accuracy FROM s"))
def q_accuracy_by_split(spark, root):
    """Hold-out and training accuracy of a rule that is perfect on the training rows only."""
    p = profile(spark, root).where("target_flag IS NOT NULL").withColumn("is_test", F.expr("id % 5 = 0"))
    rule = F.when(F.col("is_test"), F.when(F.coalesce(F.col("n_orders") >= 12, F.lit(False)), 1).otherwise(0)).otherwise(F.col("target_flag"))
    scored = p.select(F.col("target_flag").alias("label"), rule.alias("prediction"), "is_test")
    return r6(clf.compare_models({"rule": scored}, score=None, is_test="is_test").select("model", "accuracy", "train_accuracy"))


# -------------------------------------------------------------- H regression

_PRED = "qty * 1400.0"


@query("regression_metrics", sql=with_profile(
    f", pr AS (SELECT target_amount AS y, {_PRED} AS yh FROM profile WHERE target_amount IS NOT NULL AND qty IS NOT NULL) "
    "SELECT round(1 - sum((y - yh) * (y - yh)) / nullif(var_pop(y) * count(y), 0), 6) AS r2, "
    "round(avg(abs(y - yh)), 4) AS mae, round(sqrt(avg((y - yh) * (y - yh))), 4) AS rmse, count(y) AS n FROM pr"))
def q_regression_metrics(spark, root):
    p = profile(spark, root).withColumn("pred", F.col("qty") * 1400.0)
    return r6(rg.regression_metrics(p, "target_amount", "pred"), {"mae": 4, "rmse": 4})


@query("residuals", sql=with_profile(
    f"SELECT id, round(target_amount, 4) AS actual, round({_PRED}, 4) AS predicted, "
    f"round(target_amount - {_PRED}, 4) AS residual FROM profile"))
def q_residuals(spark, root):
    p = profile(spark, root).withColumn("pred", F.col("qty") * 1400.0)
    return r6(rg.residuals(p, "target_amount", "pred", keep=["id"]), {"actual": 4, "predicted": 4, "residual": 4})


def _reg_frames(spark, root):
    def build():
        # Split, scaler fit and sizing each read the frame: compute the joins once.
        p = _profile(spark, root)
        feats = numeric_features(p, exclude=REG_LEAKAGE)
        p = fill_nulls(p, feats, 0)
        sp = fe.random_split(p, "id", 0.2, SEED)
        # Statistics from the training rows only (the reference fitted them on all rows).
        stats = fe.fit_zscore(sp.where(~F.col("is_test")), feats)
        return _ready(fe.apply_zscore(sp, stats)), feats
    return _memo(("reg", root), build)


def _fit_one(spark, root, name):
    z, feats = _reg_frames(spark, root)
    train, test = z.where(~F.col("is_test")), z.where(F.col("is_test"))
    table, fitted = _memo(("reg_models", root, name), lambda: rg.fit_targets(
        train, test, feats, REG_TARGETS, {name: rg.DEFAULT_MODELS[name]}))
    return r6(table.drop("is_best"), {"mae": 4, "rmse": 4})


@query("fit_linear")
def q_fit_linear(spark, root):
    return _fit_one(spark, root, "Linear Regression")


_TWO = ["qty", "n_orders"]
_TWO_SQL = ("f AS (SELECT target_amount AS y, coalesce(CAST(qty AS DOUBLE), 0) AS a, coalesce(CAST(n_orders AS DOUBLE), 0) AS b FROM profile WHERE target_amount IS NOT NULL), "
            "m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb FROM f)")


def _terms(spark, coefficients, intercept):
    return r6(spark.createDataFrame([*zip(_TWO, map(float, coefficients)), ("intercept", float(intercept))], "term string, coefficient double"), {"coefficient": 3})


@query("linear_coefficients", sql=with_profile(
    f", {_TWO_SQL}, w AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM m) "
    "SELECT 'qty' AS term, round(wa, 3) AS coefficient FROM w UNION ALL SELECT 'n_orders', round(wb, 3) FROM w UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 3) FROM w"))
def q_linear_coefficients(spark, root):
    """Least squares of two columns, by QR; the SQL solves the normal equations."""
    p = fill_nulls(profile(spark, root), _TWO, 0)
    m = rg.fit_linear(p, _TWO, "target_amount").stages[-1]
    return _terms(spark, m.getOrDefault(m.coefficients), m.getOrDefault(m.intercept))


@query("ridge_coefficients", sql=with_profile(
    f", {_TWO_SQL}, z AS (SELECT n, my, ya / sqrt(aa) AS ya, yb / sqrt(bb) AS yb, ab / sqrt(aa * bb) AS ab FROM m), "
    "w AS (SELECT (n * ya * (n + 1) - n * yb * n * ab) / ((n + 1) * (n + 1) - n * ab * n * ab) AS wa, (n * yb * (n + 1) - n * ya * n * ab) / ((n + 1) * (n + 1) - n * ab * n * ab) AS wb, my FROM z) "
    "SELECT 'qty' AS term, round(wa, 3) AS coefficient FROM w UNION ALL SELECT 'n_orders', round(wb, 3) FROM w UNION ALL SELECT 'intercept', round(my, 3) FROM w"))
def q_ridge_coefficients(spark, root):
    """Ridge (alpha 1) of two z-scored columns; the SQL solves the penalised normal equations."""
    # Scaler, label deviation and fit each read the rows: their joins are computed once.
    p = fill_nulls(_profile(spark, root), _TWO, 0).where(F.col("target_amount").isNotNull()).select(*_TWO, "target_amount")
    m = rg.fit_ridge(fe.zscore(p, _TWO), _TWO, "target_amount", 1.0).stages[-1]
    return _terms(spark, m.coefficients.toArray(), m.intercept)


@query("fit_ridge")
def q_fit_ridge(spark, root):
    return _fit_one(spark, root, "Ridge")


@query("fit_rf_regressor")
def q_fit_rf_regressor(spark, root):
    return _fit_one(spark, root, "Random Forest")


@query("fit_gbt_regressor")
def q_fit_gbt_regressor(spark, root):
    return _fit_one(spark, root, "Gradient Boosting")


@query("regression_importance")
def q_regression_importance(spark, root):
    z, feats = _reg_frames(spark, root)
    train, test = z.where(~F.col("is_test")), z.where(F.col("is_test"))
    _, fitted = _memo(("reg_models", root, "Random Forest"), lambda: rg.fit_targets(
        train, test, feats, REG_TARGETS, {"Random Forest": rg.DEFAULT_MODELS["Random Forest"]}))
    return r6(rg.regression_importance({t: m["Random Forest"] for t, m in fitted.items()}, 15))


@query("fit_targets")
def q_fit_targets(spark, root):
    z, feats = _reg_frames(spark, root)
    table, _ = _memo(("fit_targets", root), lambda: rg.fit_targets(
        z.where(~F.col("is_test")), z.where(F.col("is_test")), feats, REG_TARGETS + ["not_a_column"], rg.DEFAULT_MODELS))
    return r6(table, {"mae": 4, "rmse": 4})


# -------------------------------------------------------------- I clustering

CLUSTER_COLS = ["balance", "n_orders", "avg_price", "qty", "avg_discount", "n_parts", "n_returned", "score_1_10"]


def _cluster_frame(spark, root):
    def build():
        p = fill_nulls(_profile(spark, root), CLUSTER_COLS, 0)
        return _ready(fe.zscore(p, CLUSTER_COLS).select("id", *CLUSTER_COLS))
    return _memo(("clu", root), build)


def _kmeans5(spark, root):
    z = _cluster_frame(spark, root)
    return _memo(("km5", root), lambda: cl.kmeans(z, CLUSTER_COLS, k=5, n_init=20, seed=SEED))


@query("kmeans")
def q_kmeans(spark, root):
    z = _cluster_frame(spark, root)
    model, cost, costs = _kmeans5(spark, root)
    lab = cl.assign(model, z, CLUSTER_COLS, "cluster")
    # The cost again from the labels alone: squares about each cluster's own means.
    squares = sum((F.var_pop(c) * F.count(F.lit(1)) for c in CLUSTER_COLS), F.lit(0.0))
    sizes = lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), squares.alias("within"))
    total = sizes.agg(F.sum("within")).scalar()
    return sizes.select("cluster", "n", F.round("within", 4).alias("within"), F.round(F.lit(cost), 4).alias("best_cost"),
                        F.round(F.lit(max(costs)), 4).alias("worst_cost"), F.round(total / F.lit(cost), 4).alias("label_cost_ratio"))


@query("kmeans_line", sql=with_profile(
    ", v AS (SELECT CAST(balance AS DOUBLE) AS x FROM profile WHERE balance IS NOT NULL), "
    "c AS (SELECT x, row_number() OVER w AS i, sum(x) OVER w AS s, sum(x * x) OVER w AS q FROM v WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), "
    "t AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM v), "
    "cut AS (SELECT c.i, c.s / c.i AS low, (t.s - c.s) / (t.n - c.i) AS high, t.n - c.i AS j, (c.q - c.s * c.s / c.i) + (t.q - c.q - (t.s - c.s) * (t.s - c.s) / (t.n - c.i)) AS cost "
    "FROM c, t WHERE c.i < t.n ORDER BY cost LIMIT 1) "
    "SELECT i AS n, round(low, 4) AS centre, round(cost / 1e6, 4) AS cost FROM cut UNION ALL SELECT j, round(high, 4), round(cost / 1e6, 4) FROM cut"))
def q_kmeans_line(spark, root):
    """Two clusters of one column: the best of 20 runs is the best of all cuts of the sorted values, which the SQL tries."""
    p = profile(spark, root).where(F.col("balance").isNotNull()).withColumn("balance", F.col("balance").cast("double"))
    model, cost, _ = cl.kmeans(p, ["balance"], k=2, n_init=20, seed=SEED, tol=0.0)
    out = cl.assign(model, p, ["balance"], "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 4).alias("centre"))
    return out.select("n", "centre", F.round(F.lit(cost / 1e6), 4).alias("cost"))


@query("cluster_quality")
def q_cluster_quality(spark, root):
    """Silhouette and Davies-Bouldin of the fitted clusters."""
    model, _, _ = _kmeans5(spark, root)
    z = cl.assign(model, _cluster_frame(spark, root), CLUSTER_COLS, "cluster")
    sil = cl.silhouette(z, "cluster", CLUSTER_COLS, sample=600, seed=SEED, key="id")
    return r6(sil.select("silhouette", cl.davies_bouldin(z, "cluster", CLUSTER_COLS).scalar().alias("davies_bouldin")))


@query("clustered_export", sql=with_profile("SELECT count(*) AS n_rows, count(*) AS n_named, count(*) AS n_same, CAST(5 AS BIGINT) AS n_clusters FROM profile"))
def q_clustered_export(spark, root):
    """The whole table with each row's cluster and segment name, written as CSV and read again."""
    model, _, _ = _kmeans5(spark, root)
    labelled = cl.assign(model, _cluster_frame(spark, root), CLUSTER_COLS, "cluster").select("id", "cluster")
    named = cl.name_segments(_profile(spark, root).join(labelled, "id"), "cluster", RANK_COLS, NAME_RULES, NAME_DEFAULT)
    path = io.write_csv(named, scratch_path(spark, "clustered-csv"))
    again = io.read_csv(spark, path, schema=named.schema).select("id", F.col("cluster").alias("c"), F.col("segment_name").alias("s"))
    both = labelled.join(again, "id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count("s").alias("n_named"), F.count_if(F.col("c") == F.col("cluster")).alias("n_same"), F.countDistinct("c").alias("n_clusters"))


@query("k_sweep")
def q_k_sweep(spark, root):
    z = _cluster_frame(spark, root)
    return r6(cl.k_sweep(z, CLUSTER_COLS, range(2, 9), n_init=10, seed=SEED, sample=500, key="id"))


@query("cluster_segments")
def q_cluster_segments(spark, root):
    """The reference flow: k-means (k=5, best of 20) on z-scored features,
    clusters named by rank rules over their profile, then the named-segment
    profile on the original (unscaled) columns."""
    z = _cluster_frame(spark, root)
    model, _, _ = _kmeans5(spark, root)
    labelled = cl.assign(model, z, CLUSTER_COLS, "cluster").select("id", "cluster")
    raw = _profile(spark, root).join(labelled, "id")
    named = cl.name_segments(raw, "cluster", RANK_COLS, NAME_RULES, NAME_DEFAULT)
    return r6(cl.segment_profile(named, "segment_name", {
        "n": ("id", "count"), "amount": ("target_amount", "mean"), "discount": ("avg_discount", "mean"),
        "balance": ("balance", "mean"), "score": ("score_1_10", "mean")}), {"amount": 4})


@query("pca")
def q_pca(spark, root):
    z = _cluster_frame(spark, root)
    model, _, _ = _kmeans5(spark, root)
    points, _ = cl.pca(z, CLUSTER_COLS, 2, key="id")
    labels = cl.assign(model, z, CLUSTER_COLS, "cluster").select("id", "cluster")
    return r6(points.join(labels, "id"))


@query("pca_variance", sql=with_profile(
    ", f AS (SELECT coalesce(score_1_10, 0) AS a, coalesce(n_parts, 0) AS b FROM profile), "
    "m AS (SELECT var_pop(a) AS p, var_pop(b) AS q, covar_pop(a, b) AS c, count(*) AS n FROM f), "
    "e AS (SELECT p + q AS t, sqrt((p - q) * (p - q) / 4 + c * c) AS d, n FROM m) "
    "SELECT 1 AS component, round((t / 2 + d) / t, 6) AS variance_ratio, round(t / 2 + d, 4) AS point_variance, CAST(0 AS DOUBLE) AS point_mean, n FROM e "
    "UNION ALL SELECT 2, round((t / 2 - d) / t, 6), round(t / 2 - d, 4), CAST(0 AS DOUBLE), n FROM e"))
def q_pca_variance(spark, root):
    """Both components of two columns: shares of variance, and what the projected points themselves have."""
    z = fill_nulls(profile(spark, root), ["score_1_10", "n_parts"], 0).select("id", "score_1_10", "n_parts")
    points, var = cl.pca(z, ["score_1_10", "n_parts"], 2, key="id")
    seen = points.agg(*[f(c).alias(f"{n}{c}") for c in ("pc1", "pc2") for f, n in ((F.var_pop, "v"), (F.avg, "m"))], F.count("id").alias("n"))
    seen = seen.select(F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"vpc{k}").alias("point_variance"),
                                                   (F.round(F.col(f"mpc{k}"), 6) + 0.0).alias("point_mean"), F.col("n")) for k in (1, 2)])))
    return r6(var.join(seen, "component"), {"point_variance": 4})


def _sil_sql(m: int) -> str:
    return (f"WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings "
            f"ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT {m}), "
            f"d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {_DIST} AS dist FROM s a JOIN s b ON a.vec_id <> b.vec_id), "
            "m AS (SELECT vec_id, la, lb, avg(dist) AS md FROM d GROUP BY vec_id, la, lb), "
            "ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b "
            "FROM m GROUP BY vec_id), sz AS (SELECT label, count(*) AS n FROM s GROUP BY label) "
            "SELECT round(avg(CASE WHEN sz.n > 1 THEN (ab.b - ab.a) / greatest(ab.a, ab.b) ELSE 0 END), 6) AS silhouette "
            "FROM s JOIN sz USING (label) LEFT JOIN ab USING (vec_id)")


@query("silhouette", sql=_sil_sql(600))
def q_silhouette(spark, root):
    e = io.read_table(spark, root, "embeddings")
    return r6(cl.silhouette(e, "label", "embedding", sample=600, seed=SEED, key="vec_id"))


@query("davies_bouldin", sql=(
    "WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "ex AS (SELECT label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM e), "
    "cd AS (SELECT label, i, avg(v) AS cv FROM ex GROUP BY label, i), "
    "c AS (SELECT label, list(cv ORDER BY i) AS cen FROM cd GROUP BY label), "
    "sp AS (SELECT e.label, avg(sqrt(list_sum(list_transform(range(1, len(e.x) + 1), "
    "lambda i: (e.x[i] - c.cen[i]) * (e.x[i] - c.cen[i]))))) AS s FROM e JOIN c ON e.label = c.label GROUP BY e.label), "
    "pr AS (SELECT a.label, max((sa.s + sb.s) / sqrt(list_sum(list_transform(range(1, len(a.cen) + 1), "
    "lambda i: (a.cen[i] - b.cen[i]) * (a.cen[i] - b.cen[i]))))) AS r FROM c a JOIN c b ON a.label <> b.label "
    "JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY a.label) "
    "SELECT round(avg(r), 6) AS davies_bouldin FROM pr"))
def q_davies_bouldin(spark, root):
    e = io.read_table(spark, root, "embeddings")
    return r6(cl.davies_bouldin(e, "label", "embedding"))


# Naming rules for the fixture's own segments, over average ranks of their profile; the first that holds names it.
RANK_COLS = ["avg_discount", "n_parts", "balance", "score_1_10"]
NAME_RULES = [
    ("Bulk buyers", "n_parts_rank >= 5"),
    ("Deal seekers", "avg_discount_rank >= 4 AND score_1_10_rank <= 3"),
    ("Cash-rich fans", "balance_rank > 3 AND score_1_10_rank > 3"),
]
NAME_DEFAULT = "Everyday"


def _rank_sql(c: str) -> str:
    return (f"CAST(floor(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS INTEGER) "
            f"AS {c}_rank")


_NAMES_SQL = (
    ", prof AS (SELECT segment, " + ", ".join(f"round(avg({c}), 2) AS {c}" for c in RANK_COLS)
    + " FROM profile GROUP BY segment), rk AS (SELECT segment, " + ", ".join(_rank_sql(c) for c in RANK_COLS)
    + " FROM prof), nm AS (SELECT segment, CASE " + " ".join(f"WHEN {cond} THEN '{lab}'" for lab, cond in NAME_RULES)
    + f" ELSE '{NAME_DEFAULT}' END AS segment_name FROM rk), named AS (SELECT p.*, nm.segment_name FROM profile p "
    "LEFT JOIN nm ON p.segment = nm.segment)")


def _named(spark, root):
    return cl.name_segments(profile(spark, root), "segment", RANK_COLS, NAME_RULES, NAME_DEFAULT)


@query("name_segments", sql=with_profile(_NAMES_SQL + " SELECT id, segment, segment_name FROM named"))
def q_name_segments(spark, root):
    return _named(spark, root).select("id", "segment", "segment_name")


@query("segment_profile", sql=with_profile(
    _NAMES_SQL + " SELECT segment_name, count(id) AS n, round(avg(target_amount), 4) AS amount, "
    "round(avg(avg_discount), 6) AS discount, round(avg(balance), 6) AS balance, round(avg(score_1_10), 6) AS score "
    "FROM named GROUP BY segment_name"))
def q_segment_profile(spark, root):
    g = cl.segment_profile(_named(spark, root), "segment_name", {
        "n": ("id", "count"), "amount": ("target_amount", "mean"), "discount": ("avg_discount", "mean"),
        "balance": ("balance", "mean"), "score": ("score_1_10", "mean")})
    return r6(g, {"amount": 4})


_NORM_COLS = ["avg_discount", "n_parts", "target_amount", "balance"]


@query("segment_profile_normalised", sql=with_profile(
    _NAMES_SQL + ", mm AS (SELECT segment_name, " + ", ".join(f"avg({c}) AS {c}" for c in _NORM_COLS)
    + " FROM named GROUP BY segment_name) SELECT segment_name, " + ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9), 6) AS {c}" for c in _NORM_COLS)
    + " FROM mm"))
def q_segment_profile_normalised(spark, root):
    return r6(cl.segment_profile_normalised(_named(spark, root), "segment_name", _NORM_COLS))


# ------------------------------------------------------------ A5, A6 sinks

SAVED = ["classifier", "clusters", "components", "regressor"]


def _saved_pipelines(spark, root):
    """The four fitted artefacts as pipelines that take raw profile rows: name -> (pipeline, its result as an array)."""
    def build():
        # Training frames are prepared, sized and cached before a fit: a fit reads its rows once a level, and every one of its
        # partitions sends its own histograms.
        raw = _profile(spark, root)
        willing = raw.where(F.col("target_flag").isNotNull())
        _, feats = _clf_frame(raw)
        prep = sg.fit_preparation(willing, feats)
        train = _ready(prep.transform(willing).select("target_flag", *feats))
        forest = clf.fit_random_forest(train, feats, "target_flag", seed=SEED)
        train.unpersist()
        scale = sg.fit_preparation(raw, CLUSTER_COLS)
        ready = _ready(scale.transform(raw).select(*CLUSTER_COLS))
        centres, _, _ = cl.kmeans(ready, CLUSTER_COLS, k=5, n_init=20, seed=SEED)
        assemble = VectorAssembler(inputCols=CLUSTER_COLS, outputCol="features")
        axes = PCA(k=2, inputCol="features", outputCol="components").fit(assemble.transform(ready))
        ready.unpersist()
        amounts = raw.where(F.col("target_amount").isNotNull())
        reg_feats = numeric_features(raw, exclude=REG_LEAKAGE)
        reg_prep = sg.fit_preparation(amounts, reg_feats)
        train = _ready(reg_prep.transform(amounts).select("target_amount", *reg_feats))
        trees = rg.fit_rf_regressor(train, reg_feats, "target_amount", seed=SEED)
        train.unpersist()
        number = F.array(F.col("prediction").cast("double"))
        return raw, {"classifier": (sg.chain(prep, forest), vector_to_array("probability")), "clusters": (sg.chain(scale, centres), number),
                     "components": (sg.chain(scale, assemble, axes), vector_to_array("components")), "regressor": (sg.chain(reg_prep, trees), number)}
    return _memo(("saved", root), build)


@query("save_load_pipeline", sql=with_profile(
    "SELECT unnest([" + ", ".join(f"'{n}'" for n in SAVED) + "]) AS pipeline, n_rows, n_rows AS n_same FROM (SELECT count(*) AS n_rows FROM profile) c"))
def q_save_load_pipeline(spark, root):
    """Scaler and forest, k-means, PCA and forest regressor saved and loaded again; how many raw rows each pair scores alike."""
    raw, models = _saved_pipelines(spark, root)
    parts = []
    for name, (model, result) in models.items():
        again = io.load_pipeline(io.save_pipeline(model, scratch_path(spark, f"{name}-pipeline")))
        if sg.feature_names(again) != sg.feature_names(model):
            raise ValueError(f"{name}: the feature list changed on the way")
        before, after = (m.transform(raw).select("id", result.alias(c)) for m, c in ((model, "before"), (again, "after")))
        same = F.count_if(F.col("before").eqNullSafe(F.col("after")))
        parts.append(before.join(after, "id").agg(F.lit(name).alias("pipeline"), F.count(F.lit(1)).alias("n_rows"), same.alias("n_same")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("write_results")
def q_write_results(spark, root):
    from cohortlens.operators import aggregates as agg
    p = profile(spark, root)
    sections = {"funnel": agg.funnel(p, [("Total", None), ("Willing", "target_flag = 1")]),
                "segments": agg.group_means(p, "segment", ["balance", "score_1_10"])}
    paths = io.write_results(sections, scratch_path(spark, "results"))
    parts = [spark.read.json(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
             for name, path in paths.items()]
    return parts[0].unionByName(parts[1])
