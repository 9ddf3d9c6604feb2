"""Findings of round 3: what a query reads more than once is computed once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import features as fe
from cohortlens.plans import catalog_models as cm
from cohortlens.sources import views


def _counting(spark, df, name):
    """``df`` with column ``name`` passed through a function that counts its rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def note(x):
        seen.add(1)
        return None if x is None else float(x)
    return df.withColumn(name, note.asNondeterministic()(name)), seen


def test_scored_rows_are_evaluated_once(spark):
    base = spark.range(0, 400, 1, 2).selectExpr("cast(id % 2 as int) label", "cast(id % 3 = 0 as int) prediction", "id / 400 score", "id % 5 = 0 is_test")
    scored, seen = _counting(spark, base, "prediction")
    rows = clf.compare_models({"a": scored}, is_test="is_test").collect()
    assert seen.value == 400
    assert rows == clf.compare_models({"a": base}, is_test="is_test").collect()


def test_joins_of_the_profile_are_computed_once_a_session(spark, monkeypatch):
    """k-NN on features: split, scaler, both sides and the join with labels read one frame."""
    made, plain = [], cm.profile

    def counted(spark, root):
        df, seen = _counting(spark, plain(spark, root), "avg_price")
        made.append(seen)
        return df
    monkeypatch.setattr(cm, "profile", counted)
    monkeypatch.setattr(cm, "_cache", {})
    root = "/root/testdata/sf0.001"
    cm.q_knn_on_features(spark, root).collect()
    assert len(made) == 1 and made[0].value == plain(spark, root).count()


def test_saved_forests_are_fitted_on_cached_sized_rows(spark, monkeypatch):
    seen = []

    def noting(fit):
        def run(train, *args, **kw):
            seen.append((train.storageLevel.useMemory, train.rdd.getNumPartitions()))
            return fit(train, *args, **kw, n_trees=3)
        return run
    monkeypatch.setattr(cm, "_cache", {})
    monkeypatch.setattr(cm.clf, "fit_random_forest", noting(cm.clf.fit_random_forest))
    monkeypatch.setattr(cm.rg, "fit_rf_regressor", noting(cm.rg.fit_rf_regressor))
    cm._saved_pipelines(spark, "/root/testdata/sf0.001")
    assert seen == [(True, 1), (True, 1)]


def _profile_rows_made(spark, monkeypatch, query, column="avg_price", root="/root/testdata/sf0.001"):
    """Rows that the profile's joins made for a query, and rows of the profile."""
    made, plain = [], cm.profile

    def counted(spark, root):
        df, seen = _counting(spark, plain(spark, root), column)
        made.append(seen)
        return df
    monkeypatch.setattr(cm, "profile", counted)
    monkeypatch.setattr(cm, "_cache", {})
    query(spark, root).collect()
    return sum(x.value for x in made), plain(spark, root).count()


def test_segments_and_export_read_one_profile(spark, monkeypatch):
    for q in (cm.q_cluster_segments, cm.q_clustered_export):
        with monkeypatch.context() as m:
            made, n = _profile_rows_made(spark, m, q)
        assert made == n


def test_ridge_reads_one_profile(spark, monkeypatch):
    made, n = _profile_rows_made(spark, monkeypatch, cm.q_ridge_coefficients, "qty")
    assert made == n


def test_passes_that_only_move_centres_do_not_cost_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 3)), rng.normal(size=(2500, 3)) + 4])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "__x array<double>").repartition(3)
    runs = [x[[0, 9, 5000]], x[[1, 4000]]]
    moved, costs = cl._step(df, runs)
    for c, m, cost in zip(runs, moved, costs, strict=True):
        off = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = off.argmin(axis=1)
        assert np.allclose(m, [x[own == j].mean(axis=0) for j in range(len(c))]) and np.isclose(cost, off.min(axis=1).sum())
    again, none = cl._step(df, runs, costed=False)
    assert all(np.allclose(a, b) for a, b in zip(again, moved, strict=True)) and not none.any()
    asked, step = [], cl._step

    def noting(points, runs, costed=True):
        asked.append(costed)
        return step(points, runs, costed)
    monkeypatch.setattr(cl, "_step", noting)
    cl.kmeans_runs(df, "__x", [2, 3])
    assert asked[-1] and not any(asked[:-1])


def test_a_small_training_set_is_one_task(spark):
    """Twelve thousand rows, the training rows of sf0.1: a fit of a thousand jobs would start a task a core in each."""
    assert fe.size_partitions(spark.range(0, 12_000, 1, 8)).rdd.getNumPartitions() == 1


def test_lines_of_the_profile_are_dealt_by_their_number(spark, monkeypatch):
    """No data-sized table is a broadcast, and a task's share of lines and of distinct pairs does not grow with the table."""
    monkeypatch.setattr(views, "_LINES_A_TASK", 400)
    root = "/root/testdata/sf0.001"
    n = -(-views.read_table(spark, root, "lineitem").count() // 400)
    p = views.profile(spark, root)
    plan = p._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert n > 8 and all("_nationkey" in line for line in joins)
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 3 and all(f", {n})" in line for line in dealt)
    monkeypatch.undo()
    assert sorted(map(repr, p.collect())) == sorted(map(repr, views.profile(spark, root).collect()))


def test_runs_with_equal_centres_are_computed_once(spark, monkeypatch):
    """Two far groups: all runs of k = 2 start from the same centres, one of them is carried through the passes."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(200, 2)) + 30])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "__x array<double>")
    asked, step = [], cl._step

    def noting(points, runs, costed=True):
        asked.append(len(runs))
        return step(points, runs, costed)
    monkeypatch.setattr(cl, "_step", noting)
    runs = cl.kmeans_runs(df, "__x", [2] * 6)
    assert set(asked) == {1}
    means = np.array([x[:300].mean(axis=0), x[300:].mean(axis=0)])
    cost = ((x[:300] - means[0]) ** 2).sum() + ((x[300:] - means[1]) ** 2).sum()
    assert len(runs) == 6
    for c, found in runs:
        assert np.isclose(found, cost) and np.allclose(c[np.argsort(c[:, 0])], means)


def test_a_row_as_near_to_two_centres_belongs_to_the_first(spark):
    x = np.array([[0.0], [1.0], [-1.0], [0.0], [5.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "__x array<double>")
    runs = [np.array([[-1.0], [1.0]]), np.array([[2.0], [2.0], [-9.0]])]
    for costed in (False, True):
        (a, b), _ = cl._step(df, runs, costed)
        assert np.allclose(a, [[-1 / 3], [3.0]]) and np.allclose(b, [[1.0], [2.0], [-9.0]])
