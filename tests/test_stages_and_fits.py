"""Saved stages, QR least squares, stacked k-means."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cohortlens.functions.columns import numeric_features
from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import regress as rg
from cohortlens.operators import stages as sg
from cohortlens.sources import io
from cohortlens.sources.views import profile


def raw_frame(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 11), float("nan") if i % 5 == 0 else i * 0.1, 3, f"t{i}", i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "id long, a double, b double, c int, note string, y int")


def test_preparation_fills_scales_and_reloads(spark, tmp_path):
    raw = raw_frame(spark)
    prep = sg.fit_preparation(raw, ["a", "b", "c"], value=2.5)
    again = PipelineModel.load(io.save_pipeline(prep, str(tmp_path / "prep")))
    assert sg.feature_names(again) == ["a", "b", "c"]
    x = np.array([[2.5 if i % 7 == 0 else i % 11, 2.5 if i % 5 == 0 else i * 0.1, 3.0] for i in range(200)])
    want = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    for model in (prep, again):
        out = model.transform(raw).orderBy("id").collect()
        assert np.allclose([[r.a, r.b, r.c] for r in out], want) and out[3].note == "t3"


def test_stages_can_write_to_new_columns_and_take_empty_tables(spark):
    raw = raw_frame(spark)
    f = sg.NullFiller(inputCols=["a"], outputCols=["a2"], value=-1.0).transform(raw)
    assert f.where("a is null and a2 = -1").count() == raw.where("a is null").count() > 0
    m = sg.PopulationScaler(inputCols=["a2"], outputCols=["a3"]).fit(f)
    assert m.transform(f).agg(F.abs(F.avg("a3")) < 1e-9).first()[0] and "a2" in m.transform(f).columns
    assert sg.PopulationScaler(inputCols=["a2"]).fit(f.limit(0)).transform(f).select("a2").first() == f.select("a2").first()


def test_every_saved_model_scores_raw_rows_alike(spark, tmp_path):
    raw = profile(spark, SF_SMALL).withColumn("balance", F.when(F.col("id") % 4 > 0, F.col("balance")))
    feats = numeric_features(raw, exclude=["id", "target_amount", "target_flag", "tier_code"])
    willing = raw.where("target_flag is not null")
    prep = sg.fit_preparation(willing, feats)
    forest = sg.chain(prep, clf.fit_random_forest(prep.transform(willing), feats, "target_flag", n_trees=5, max_depth=3))
    linear = sg.chain(prep, rg.fit_linear(prep.transform(raw.where("target_amount is not null")), feats, "target_amount"))
    centres, _, _ = cl.kmeans(prep.transform(raw), feats, k=3, n_init=2)
    for name, model, result in (("rf", forest, "probability"), ("lin", linear, "prediction"), ("km", sg.chain(prep, centres), "prediction")):
        again = PipelineModel.load(io.save_pipeline(model, str(tmp_path / name)))
        assert sg.feature_names(again) == feats
        a, b = (m.transform(raw).orderBy("id").select(result).collect() for m in (model, again))
        assert a == b and len(a) == raw.count()


def test_least_squares_of_collinear_columns_is_numpys(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 1e3, 1e-2] + [5, 1e4, 0]
    x = np.column_stack([x, x[:, 0] * 2 - 1 + 1e-9 * x[:, 1], x[:, 0] + x[:, 2], np.full(500, 7.0)])
    y = x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=500)
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"])).repartition(37)
    m = rg.fit_linear(df, names, "y").stages[-1]
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.lstsq(xc, yc, rcond=np.finfo(float).eps * 48)[0]
    got = np.array(m.getOrDefault(m.coefficients))
    assert np.allclose(xc @ got, xc @ want, atol=1e-6) and np.linalg.norm(got) <= np.linalg.norm(want) * 1.001
    assert m.getOrDefault(m.intercept) == pytest.approx(y.mean() - x.mean(0) @ got, rel=1e-6)


def test_least_squares_beats_normal_equations_where_they_lose_digits(spark):
    e = 1e-7
    x = np.array([[1.0, 1.0 + e * (i % 3 - 1), i] for i in range(90)])
    y = x @ [2.0, 3.0, -1.0] + 4
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    p = rg.fit_linear(df, ["b", "c"], "y").transform(df).select((F.abs(F.col("prediction") - F.col("y"))).alias("e")).agg(F.max("e")).first()[0]
    assert p < 1e-7


def test_least_squares_of_few_rows_nulls_and_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0)], "x double, y double")
    assert [round(r.prediction, 9) for r in rg.fit_linear(df, ["x"], "y").transform(df).orderBy("x").collect()] == [2.0, 4.0, 6.0]
    one = rg.fit_linear(df.limit(1), ["x"], "y").transform(df.limit(1)).first()
    assert one.prediction == pytest.approx(2.0)
    with pytest.raises(Exception, match="missing value in x"):
        rg.fit_linear(spark.createDataFrame([(None, 1.0)], "x double, y double"), ["x"], "y")
    with pytest.raises(ValueError, match="no row"):
        rg.fit_linear(df.where("y > 100"), ["x"], "y")


def blobs(spark, n=600):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.3, (n // 3, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double").repartition(5)


def test_all_kmeans_runs_advance_together(spark):
    x, df = blobs(spark)
    runs = cl.kmeans_runs(df, ["a", "b"], [3, 3, 2, 1], seed=1)
    for (centres, cost), k in zip(runs, [3, 3, 2, 1], strict=True):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert len(centres) == k and cost == pytest.approx(near.min(axis=1).sum())
        assert np.allclose(centres, [x[near.argmin(axis=1) == j].mean(axis=0) for j in range(k)], atol=1e-4)
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    best = min(KMeans(k=3, seed=s).fit(v).summary.trainingCost for s in range(5))
    assert min(runs[0][1], runs[1][1]) <= best * 1.000001


def test_kmeans_of_few_repeated_and_missing_points(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])] * 50 + [(2, [1.0, 1.0]), (3, None)], "id int, x array<double>")
    model, cost, costs = cl.kmeans(df, "x", k=2, n_init=3)
    assert cost == pytest.approx(0.0) and len(costs) == 3
    assert {tuple(c) for c in model.clusterCenters()} == {(0.0, 0.0), (1.0, 1.0)}
    assert len(cl.kmeans_runs(df.where("id = 2"), "x", [4])[0][0]) == 1
    with pytest.raises(ValueError, match="at least one row"):
        cl.kmeans(df.limit(0), "x")


def test_sweep_scores_each_k_on_one_sample(spark):
    _, df = blobs(spark)
    got = cl.k_sweep(df, ["a", "b"], [2, 3, 4], n_init=3, sample=150, key="id").collect()
    assert [r.k for r in got] == [2, 3, 4] and [r.is_best for r in got] == [False, True, False]
    runs = cl.kmeans_runs(df, ["a", "b"], [3] * 3)
    best = cl.CentreModel.of(min(runs, key=lambda r: r[1])[0], ["a", "b"]).transform(df)
    assert got[1].silhouette == pytest.approx(cl.silhouette(best, "prediction", ["a", "b"], sample=150, key="id").first()[0])
