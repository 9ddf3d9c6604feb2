"""Exact k-NN by pivots: against all pairs, on odd ids and clustered points."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import neighbours as nn


def brute(train, test, k):
    """(test row, train row) numbers and distances, ties by id (missing first), then by row."""
    out = []
    for q, (_, x) in enumerate(test):
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i is not None, i or 0, n) for n, (i, y) in enumerate(train))
        out.append([(n, dist) for dist, _, _, n in d[:k]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], n) for n, (i, x) in enumerate(rows)], "id long, x array<double>, n int")


def found(nb):
    out = {}
    for r in nb.orderBy("test_id", "rank").collect():
        out.setdefault(r.test_id, []).append((r.nb_n, r.dist))
    return out


@pytest.mark.parametrize(("cells", "block"), [(None, 20_000), (None, 9), (7, 20_000), (30, 11), (200, 5)])
@pytest.mark.parametrize("far", [0.0, 1e6])
def test_pivots_find_what_all_pairs_find(spark, cells, block, far):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 3)) * 20
    pts = [centres[rng.integers(6)] + rng.normal(size=3) + far for _ in range(150)]
    pts += [pts[0]] * 20 + [np.round(p) for p in pts[:30]]
    train = [(i % 120, p) for i, p in enumerate(pts)]
    test = [(i, p + rng.normal(size=3) * rng.choice([0, 0, 1, 30])) for i, p in enumerate(pts[::4])]
    got = found(nn.knn_neighbors(frame(spark, train), frame(spark, test), "x", 5, block_rows=block, cells=cells, keep=["n"]))
    for q, want in enumerate(brute(train, test, 5)):
        assert [d for _, d in got[q]] == [d for _, d in want]
        assert [train[n][0] for n, _ in got[q]] == [train[n][0] for n, _ in want]
        assert [tuple(train[n][1]) for n, _ in got[q]] == [tuple(train[n][1]) for n, _ in want]


@pytest.mark.parametrize("cells", [None, 3])
def test_rows_of_one_id_and_of_none_keep_their_own_columns(spark, cells):
    train = spark.createDataFrame([(1, 0.0, 1), (1, 9.0, 0), (None, 0.05, 1), (2, 50.0, 7)], "id long, a double, y int")
    test = spark.createDataFrame([(5, 0.0), (5, 9.0), (None, 0.0)], "id long, a double")
    got = sorted((str(r.test_id), r.rank, str(r.train_id), round(r.dist, 6), r.nb_y) for r in nn.knn_neighbors(train, test, ["a"], 2, keep=["y"], cells=cells).collect())
    near = [("1", 0.0, 1), ("None", 0.05, 1)]
    assert got == sorted([(t, k + 1, *x) for t in ("5", "None") for k, x in enumerate(near)] + [("5", 1, "1", 0.0, 0), ("5", 2, "None", 8.95, 1)])
    votes = sorted((str(r.test_id), r.prediction, r.score) for r in nn.knn_classify(train, test, ["a"], "y", 2, cells=cells).collect())
    assert votes == [("5", 0, 0.5), ("5", 1, 1.0), ("None", 1, 1.0)]


def test_bounds_spare_most_pairs_of_clustered_points(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 50
    pts = [(i, centres[i % 20] + rng.normal(size=8)) for i in range(2_000)]
    df = frame(spark, pts)
    r = nn.knn_pairs(df, df, "x", 5, cells=20).first()
    assert (r.train_rows, r.test_rows) == (2_000, 2_000) and r.fraction < 0.15
    assert nn.knn_pairs(df, df, "x", 5).first().fraction == 1.0


def test_fewer_rows_than_neighbours_hot_points_and_empty_sides(spark):
    same = frame(spark, [(i, [1.0, 2.0]) for i in range(40)])
    got = nn.knn_neighbors(same, same.limit(2), "x", 3, cells=4, block_rows=6).collect()
    assert sorted((r.train_id, r.dist) for r in got) == sorted([(i, 0.0) for i in range(3)] * 2)
    assert nn.knn_neighbors(same.limit(2), same, "x", 9, cells=2).count() == 80
    for a, b in ((same.limit(0), same), (same, same.limit(0))):
        out = nn.knn_neighbors(a, b, "x", 3, keep=["n"])
        assert out.columns == ["test_id", "train_id", "dist", "nb_n", "rank"] and out.count() == 0
        assert nn.knn_pairs(a, b, "x").first().pairs == 0
    with pytest.raises(Exception, match="must not be NULL"):
        nn.knn_neighbors(same, same.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), "x", 2, cells=3).collect()


def test_ids_may_be_text(spark):
    a = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 3.0)], "id string, v double")
    got = [(r.test_id, r.train_id) for r in nn.knn_neighbors(a, a.where("id = 'a'"), ["v"], 2).orderBy("rank").collect()]
    assert got == [("a", "a"), ("a", "b")]


def test_only_rows_in_reach_are_sent_on(spark, monkeypatch):
    """A visit of a further cell gives no row beyond the k-th distance that its own cell gave."""
    rng = np.random.default_rng(8)
    df = frame(spark, [(i, rng.normal(size=4)) for i in range(600)])
    seen, plain = [], nn._compare

    def compare(train, visits, *args):
        out = plain(train, visits, *args)
        seen.append((visits, out))
        return out
    monkeypatch.setattr(nn, "_compare", compare)
    got = found(nn.knn_neighbors(df, df, "x", 3, cells=24, keep=["n"]))
    (_, first), (visits, later) = seen
    rows = later.where("n is not null").join(visits.groupBy("q").agg(F.max("reach").alias("reach")), "q")
    assert rows.where("dist > reach + 1e-6").count() == 0
    assert rows.count() < visits.count()  # three a visit before
    pts = [(r.id, r.x) for r in df.orderBy("n").collect()]
    for i, want in enumerate(brute(pts, pts, 3)):
        assert [d for _, d in got[i]] == [d for _, d in want]
    assert nn.knn_pairs(df, df, "x", 3, cells=24).first().pairs == first.unionByName(later).agg(F.sum("pairs")).first()[0]


def test_a_given_number_of_pivots_is_the_least(spark):
    """More training rows than four a block get further pivots, so that pairs do not grow with their square."""
    rng = np.random.default_rng(9)
    pts = [(i, rng.normal(size=3)) for i in range(400)]
    df = frame(spark, pts)
    few, many = (nn.knn_pairs(df, df, "x", 3, block_rows=b, cells=2).first().fraction for b in (20_000, 40))
    assert many < few / 2
    got = found(nn.knn_neighbors(df, df, "x", 3, block_rows=40, cells=2, keep=["n"]))
    assert all([n for n, _ in got[i]] == [n for n, _ in want] for i, want in enumerate(brute(pts, pts, 3)))


def test_rows_are_measured_against_many_pivots_by_portions():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7))], ["n"])
    parts = list(nn._portions([batch, batch.slice(0, 0)], np.zeros((nn._MEASURED // 3, 1))))
    assert [p.num_rows for p in parts] == [3, 3, 1] and sum((p.column("n").to_pylist() for p in parts), []) == list(range(7))
