"""Hand-made frames for the semantics that real data rarely hits."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import columns as fx
from cohortlens.operators import aggregates as agg
from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import ranking as rk
from cohortlens.operators import rules as ar
from cohortlens.operators import stats as st
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.sources.io import nan_to_null


def test_nan_is_null_for_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = nan_to_null(df).agg(F.avg("x").alias("m"), F.count("x").alias("n")).first()
    assert (r.m, r.n) == (2.0, 2)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "c double, y double")
    assert st.pearson(df, "c", "y").first()["r"] is None
    m = {(r.var_x, r.var_y): r.r for r in st.corr_matrix(df, ["c", "y"]).collect()}
    assert m[("y", "y")] == pytest.approx(1.0) and m[("c", "y")] is None


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, 1.0), (3.0, 3.5, 2.0), (4.0, None, 3.0)],
                               "a double, b double, c double")
    m = {(r.var_x, r.var_y): r.r for r in st.corr_matrix(df, ["a", "b", "c"], triangle="lower").collect()}
    assert m[("c", "a")] == pytest.approx(1.0)
    assert len(m) == 3


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)], "k string, v double")
    got = {r.k: r.v_rank for r in rk.average_rank(df, ["v"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h = {r.bin: r.n for r in agg.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    rows = agg.histogram(df, "x", 4).collect()
    assert rows[0].lo == pytest.approx(1.5) and rows[-1].hi == pytest.approx(2.5)
    assert sum(r.n for r in rows) == 2


def test_unmapped_code_is_null_and_dropped_from_crosstab(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (9, 1)], "code int, flag int")
    d = fx.decode(df, "code", {1: "one", 2: "two"}, "label")
    assert [r.label for r in d.orderBy("code").collect()] == ["one", "one", "two", None]
    ct = {(r.label, r.flag): (r.n, r.pct) for r in agg.crosstab(d, "label", "flag").collect()}
    assert ct[("two", 0)] == (0, 0.0)  # empty cell kept as zero
    assert ct[("one", 1)] == (1, 50.0)
    assert len(ct) == 4


def test_frequency_pct_base_counts_null_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    got = {r.x: r.pct for r in agg.frequency_pct(df, "x", digits=None).collect()}
    assert got == {"a": 50.0, "b": 25.0}


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "x string")
    assert agg.mode(df, "x").first().x == "a"


def test_exact_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5, 0.25])["x"] == [2.5, 1.75]


def test_describe_matches_sample_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = agg.describe(df, ["x"]).first()
    assert r["count"] == 4 and r["std"] == pytest.approx(math.sqrt(5 / 3)) and r["p50"] == 2.5


def test_funnel_independent_and_cumulative(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1)], "a int, b int")
    ind = [r.n for r in agg.funnel(df, [("all", None), ("a", "a = 1"), ("b", "b = 1")]).collect()]
    cum = [r.n for r in agg.funnel(df, [("all", None), ("a", "a = 1"), ("b", "b = 1")], cumulative=True).collect()]
    assert ind == [3, 2, 2] and cum == [3, 2, 1]


def test_empty_table_kpis(spark):
    df = spark.createDataFrame([], "x double, f int")
    r = agg.kpis(df, [("m", "mean", "x"), ("med", "median", "x"), ("n", "count", "x")]).first()
    assert r.m is None and r.med is None and r.n == 0


def test_auc_single_class_is_null_and_ties_count_half(spark):
    one = spark.createDataFrame([(1, 0.3), (1, 0.7)], "label int, score double")
    assert clf.roc_auc(one).first().auc is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert clf.roc_auc(tied).first().auc == pytest.approx(0.875)
    pts = clf.roc_curve(tied).collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and len(pts) == 4


def test_golden_confusion_arithmetic(spark):
    # Confusion rows [[52, 41], [22, 125]] -> accuracy .7375, precision .7530, recall .8503, F1 .7987.
    rows = [(0, 0)] * 52 + [(0, 1)] * 41 + [(1, 0)] * 22 + [(1, 1)] * 125
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = clf.precision_recall_f1(df).first()
    assert round(m.accuracy, 4) == 0.7375 and round(m.precision, 4) == 0.7530
    assert round(m.recall, 4) == 0.8503 and round(m.f1, 4) == 0.7987
    cm = {(r.actual, r.predicted): r.n for r in clf.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 52, (0, 1): 41, (1, 0): 22, (1, 1): 125}


def test_itemset_at_exact_threshold_and_four_way_splits(spark):
    # 10 baskets; {a,b,c,d} appears exactly once -> support 0.1 = threshold.
    rows = [(i, ["a", "b", "c", "d"] if i == 0 else ["a", "b"] if i < 6 else ["c"]) for i in range(10)]
    b = spark.createDataFrame(rows, "id int, items array<string>")
    fi = {tuple(r.itemset): r.support for r in ar.frequent_itemsets(b, 0.10, 4).collect()}
    assert fi[("a", "b", "c", "d")] == pytest.approx(0.1)
    rules = ar.association_rules(ar.frequent_itemsets(b, 0.10, 4), "support", 0.0)
    four = rules.where(F.size("antecedents") + F.size("consequents") == 4).count()
    assert four == 14
    r = rules.where((F.array_join("antecedents", ",") == "a") & (F.array_join("consequents", ",") == "b")).first()
    assert r.confidence == pytest.approx(1.0) and r.lift == pytest.approx(1 / 0.6)


def test_max_len_stops_growth(spark):
    b = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(4)], "id int, items array<string>")
    sizes = {r.size for r in ar.frequent_itemsets(b, 0.5, 2).collect()}
    assert sizes == {1, 2}


def test_silhouette_singleton_cluster_scores_zero(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [10.0, 10.0])],
                               "id int, c int, x array<double>")
    s = cl.silhouette(df, "c", "x", sample=10, key="id").first().silhouette
    h1, h2 = math.hypot(10, 10), math.hypot(10, 9)
    assert s == pytest.approx(((h1 - 1) / h1 + (h2 - 1) / h2 + 0.0) / 3)


def test_band_and_prefix_rules(spark):
    df = spark.createDataFrame([(8,), (5,), (1,), (None,)], "s int")
    got = [r.b for r in df.select(fx.band("s", [7, 5], ["High", "Mid", "Low"]).alias("b")).collect()]
    assert got == ["High", "Mid", "Low", None]
    names = spark.createDataFrame([("Eng_x",), ("Derived_y",), ("Q1",)], "f string")
    kinds = [r.k for r in names.select(clf.classify_by_prefix("f", [("Eng_", "Engineered"), ("Derived_", "Derived Composite")], "Survey Item").alias("k")).collect()]
    assert kinds == ["Engineered", "Derived Composite", "Survey Item"]


def test_ordered_cumsum_across_ranges(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = rng.choice(10_000, size=2_000, replace=False).astype(float)
    w = rng.integers(0, 5, size=2_000)
    df = spark.createDataFrame([(float(v), int(x)) for v, x in zip(vals, w)], "v double, w long")
    for desc in (False, True):
        got = {r.v: (r.w_cum, r.next_w) for r in
               rk.ordered_cumsum(df, "v", ["w"], descending=desc, n_ranges=7, next_cols=["w"]).collect()}
        order = np.argsort(-vals if desc else vals)
        cum = np.cumsum(w[order])
        for pos, i in enumerate(order):
            nxt = int(w[order[pos + 1]]) if pos + 1 < len(order) else None
            assert got[vals[i]] == (int(cum[pos]), nxt)


def test_crosstab_wide_zero_fills(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "r string, c string")
    rows = {r.r: (r.a, r.b) for r in agg.crosstab_wide(df, "r", "c", ["a", "b"]).collect()}
    assert rows == {"x": (50.0, 50.0), "y": (100.0, 0.0)}
