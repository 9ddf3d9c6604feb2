"""Cases that the oracle tables do not hold: swapped splits, ties, offsets, duplicates, nulls, quotes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import features as fe
from cohortlens.sources import io


def test_comparison_reports_hold_out_rows_as_test(spark):
    rows = [(1, 1, 1.0, False), (0, 0, 0.0, False), (1, 0, 0.0, True), (0, 1, 1.0, True)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double, is_test boolean")
    r = clf.compare_models({"m": df}, is_test="is_test").first()
    assert (r["accuracy"], r["train_accuracy"]) == (0.0, 1.0)


def brute(train, q, k):
    return [i for _, i in sorted((math.dist(x, q), i) for i, x in train)[:k]]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_knn_is_exact_on_ties_and_offsets(spark, offset):
    rng = np.random.default_rng(3)
    step = (lambda n: rng.integers(1, 4, (n, 2)).astype(float)) if not offset else (lambda n: rng.normal(size=(n, 2)) + offset)
    train, test = list(enumerate(step(3000).tolist())), list(enumerate(step(20).tolist()))
    rows = lambda x: spark.createDataFrame([(i, *v) for i, v in x], "id long, a double, b double")
    got = {}
    for r in clf.knn_neighbors(rows(train), rows(test), ["a", "b"], 9).collect():
        got.setdefault(r["test_id"], {})[r["rank"]] = r["train_id"]
    assert {t: [v[i] for i in range(1, 10)] for t, v in got.items()} == {t: brute(train, q, 9) for t, q in test}


def test_knn_rejects_nulls_and_keeps_integer_types(spark):
    a = spark.createDataFrame([(1, 0.0, 7), (2, 1.0, None)], "id long, a double, tag int")
    out = clf.knn_neighbors(a, a.select("id", "a"), ["a"], 1, keep=["tag"])
    assert dict(out.dtypes)["nb_tag"] == "int" and sorted((r["test_id"], r["nb_tag"]) for r in out.collect()) == [(1, 7), (2, None)]
    bad = spark.createDataFrame([(1, None)], "id long, a double")
    with pytest.raises(Exception, match="NULL or NaN"):
        clf.knn_neighbors(a, bad, ["a"], 1).collect()


def test_silhouette_of_duplicates_and_without_a_sample(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (3, 1, 1.0)], "id long, label int, x double")
    assert cl.silhouette(df, "label", ["x"], sample=10, key="id").first()[0] == 0.0
    with pytest.raises(ValueError):
        cl.silhouette(df, "label", ["x"], sample=None, key="id")


def test_davies_bouldin_with_equal_centroids_and_empty_input(spark):
    rows = [(0, -1.0), (0, 1.0), (1, -2.0), (1, 2.0), (2, 9.0), (2, 11.0)]
    df = spark.createDataFrame(rows, "label int, x double")
    assert cl.davies_bouldin(df, "label", ["x"]).first()[0] == pytest.approx((2 / 10 + 3 / 10 + 3 / 10) / 3)
    assert cl.davies_bouldin(df.limit(0), "label", ["x"]).first()[0] is None


@pytest.mark.parametrize("nulls", [6, 40])
def test_splits_keep_null_keys(spark, nulls):
    df = spark.createDataFrame([(i if i >= nulls else None, i % 2) for i in range(200)], "id long, y int")
    out = fe.random_split(df, "id").groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in out} == {True: 40, False: 160}


def test_nan_is_null_at_ingest(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double").write.parquet(f"{tmp_path}/t.parquet")
    assert io.read_table(spark, str(tmp_path), "t").agg(F.avg("x")).first()[0] == 2.0
    assert io.resolve_source(spark, "t", [str(tmp_path)]).agg(F.avg("x")).first()[0] == 2.0


def test_csv_with_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a ""quoted"", b"\n2,"two\nlines"\n')
    rows = io.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string", multi_line=True).collect()
    assert [r["t"] for r in rows] == ['a "quoted", b', "two\nlines"]
    df = spark.createDataFrame([(1, 'x "y", z')], "id int, t string")
    io.write_csv(df, f"{tmp_path}/out")
    assert io.read_csv(spark, f"{tmp_path}/out", "id int, t string").first()["t"] == 'x "y", z'


def test_training_sets_use_the_cores_once_they_are_worth_it(spark):
    cores = spark.sparkContext.defaultParallelism
    n = fe._ROWS_WORTH_A_TASK
    assert fe.size_partitions(spark.range(n)).rdd.getNumPartitions() == 1
    assert fe.size_partitions(spark.range(n * cores)).rdd.getNumPartitions() == cores


def test_correlations_pairwise_offsets_and_constants(spark):
    from cohortlens.operators import stats as st
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"a": rng.normal(size=2000) + 1e8, "b": rng.normal(size=2000)})
    d["c"], d["k"], d["none"] = d.a - 1e8 + 0.5 * d.b, 0.1, np.nan
    d["h"] = np.where(rng.random(2000) < 0.3, np.nan, d.b)
    d["z"] = np.where(d.h.isna(), d.b, 7.3)  # constant where h is present
    want = d.corr()
    df = spark.createDataFrame(d).repartition(7)
    for r in st.corr_matrix(df, list(d.columns)).collect():
        x = want.loc[r.var_x, r.var_y]
        assert (r.r is None) == bool(np.isnan(x)) and (r.r is None or abs(r.r - x) < 1e-7)
    assert [r.r for r in st.corr_with_target(df.limit(0), ["a", "b"], "c").collect()] == [None, None]


def test_reports_handle_empty_and_constant(spark):
    from cohortlens.plans import reports as rp
    df = spark.createDataFrame([(1, 7, 5.0, "x"), (0, 5, 5.0, "y"), (None, None, None, None)], "f int, s int, m double, c string")
    got = {(r.section, r.key): r.value for r in rp.descriptive_report(df, "f", "s", "m", "c", bins=4, demographics={"label": ("f", {1: "yes"})}).collect()}
    assert got["kpi", "median_amount"] == 5.0 and got["amount_range", "min"] == 4.5 and got["amount_range", "max"] == 5.5
    assert [got["amount_histogram", str(i)] for i in range(4)] == [0, 0, 2, 0]
    assert got["score_band", "High"] == 1 and got["score_band", "Medium"] == 1 and got["label", "yes"] == 1
    assert ("flag_dist", None) not in got
    empty = {(r.section, r.key): r.value for r in rp.descriptive_report(df.limit(0), "f", "s", "m", "c", bins=2).collect()}
    assert empty["kpi", "median_amount"] is None and empty["amount_histogram", "1"] == 0
    rep = rp.business_report(df, ["f", "s"], {"s": "Score"}, "c", None, "f", "m", {"high": "s >= 7"}, top=1).collect()
    assert {(r.section, r.key, r.value) for r in rep} >= {("top_items", "Score", 6.0), ("choice_mode", "x", 1.0), ("summary", "high", 1.0)}
