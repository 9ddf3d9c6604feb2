"""The large-input branches, forced on small frames by lowering their limits.

Each branch must give the same answer as the small-input branch (or NumPy),
so these tests pin down that the scale paths are not a different result.
"""

import random
from itertools import combinations

import numpy as np
import pytest

from cohortlens.operators import aggregates as agg
from cohortlens.operators import quantiles as qt
from cohortlens.operators import rules as ar


def _values(n=2000, seed=7):
    rnd = random.Random(seed)
    # Heavy duplicates (a hot value holding a third of the rows) plus spread.
    return [(float(rnd.choice([5.0, 5.0, 5.0, rnd.uniform(-50, 50), rnd.randint(0, 9)])),) for _ in range(n)]


def test_summarize_bucket_path_matches_numpy(spark, monkeypatch):
    rows = _values()
    df = spark.createDataFrame(rows + [(None,), (float("nan"),)], "x double")
    xs = np.array([r[0] for r in rows])
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    monkeypatch.setattr(qt, "_MAX_WINDOW_ROWS", 100)
    from pyspark.sql import functions as F
    # Spark orders NaN above every number: the caller's aggregate skips it.
    st, q = qt.summarize(df, ["x"], probs, [F.max(F.when(~F.isnan("x"), F.col("x"))).alias("mx")], ["x"])
    assert q["x"] == pytest.approx(list(np.quantile(xs, probs)))
    assert st["mx"] == pytest.approx(xs.max())


def test_kpis_single_read_matches_lazy_aggregates(spark, monkeypatch):
    rows = [(i % 3, float(i) if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "f int, x double")
    specs = [("share", "share", "f"), ("avg", "mean", "x"), ("med", "median", "x"), ("n", "count", "x"),
             ("sd", "std", "x"), ("lo", "min", "f")]
    monkeypatch.setattr(qt, "_MAX_WINDOW_ROWS", 50)
    got = agg.kpis(df, specs)
    want = df.selectExpr("avg(f) * 100 AS share", "avg(x) AS avg", "median(x) AS med", "count(x) AS n",
                         "stddev_samp(x) AS sd", "min(f) AS lo")
    assert [f.dataType for f in got.schema.fields if f.name != "med"] == \
        [f.dataType for f in want.schema.fields if f.name != "med"]
    g, w = got.first().asDict(), want.first().asDict()
    assert g == pytest.approx(w)


def _baskets(spark, n=300, items="abcdefg", seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # Most baskets hold most items, so itemsets grow to six or seven items.
        rows.append((i, sorted(x for x in items if rnd.random() < 0.8)))
    return spark.createDataFrame(rows, "id int, items array<string>")


def _as_dict(df):
    return {tuple(r.itemset): (r.size, r["count"]) for r in df.collect()}


def test_apriori_beyond_one_long_and_in_several_counts(spark, monkeypatch):
    b = _baskets(spark)
    whole = _as_dict(ar.frequent_itemsets(b, 0.2, None))
    assert max(s for s, _ in whole.values()) >= 5
    monkeypatch.setattr(ar, "_BITS", 3)
    monkeypatch.setattr(ar, "_CANDIDATES", 4)
    assert _as_dict(ar.frequent_itemsets(b, 0.2, None)) == whole


def test_apriori_of_many_items_matches_brute_force(spark):
    rnd = random.Random(8)
    names = [f"i{k:03d}" for k in range(100)]
    rows = [(i, [rnd.choice(names[:5]) for _ in range(3)] + [x for x in names if rnd.random() < 0.45]) for i in range(60)] + [(60, []), (61, None), (62, ["i000", None])]
    b = spark.createDataFrame(rows, "id int, items array<string>")
    want = {}
    sets = [{x for x in r or [] if x} for _, r in rows]
    for k in (1, 2):
        for combo in combinations(names, k):
            c = sum(1 for s in sets if set(combo) <= s)
            if c / len(sets) >= 0.25:
                want[combo] = (k, c)
    assert _as_dict(ar.frequent_itemsets(b, 0.25, 2)) == want and len(want) > 200


def test_mining_leaves_nothing_cached(spark):
    for x in spark.sparkContext._jsc.getPersistentRDDs().values():
        x.unpersist()
    ar.frequent_itemsets(_baskets(spark), 0.2, 3).collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0


def test_a_lattice_answers_any_threshold_above_its_floor(spark, tmp_path):
    b = _baskets(spark, n=150, items="abcde", seed=5)
    lattice = ar.Lattice(spark, ar.Lattice.mine(b, str(tmp_path / "lattice"), 0.2, 3).path)
    key = lambda df: sorted((tuple(r.antecedents), tuple(r.consequents), r.support, r.confidence, r.lift) for r in df.collect())
    for s, c, x in ((0.2, 0.5, 1.0), (0.5, 0.8, 0.9), (0.45, None, None), (0.99, 0.1, 0.1)):
        fresh = ar.association_rules(ar.frequent_itemsets(b, s, 3), min_threshold=None)
        assert key(lattice.rules(s, c, x)) == key(ar.filter_rules(fresh, s, c, x))
        assert _as_dict(lattice.itemsets(s)) == _as_dict(ar.frequent_itemsets(b, s, 3))
    counts = {(r.min_support, r.min_confidence, r.min_lift): r.n_rules for r in lattice.counts([0.2, 0.5], [0.5], [0.9, 1.0]).collect()}
    assert counts == {(s, 0.5, x): lattice.rules(s, 0.5, x).count() for s in (0.2, 0.5) for x in (0.9, 1.0)}
    plan = lattice.rules(0.5, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(support,0.5)" in plan
    with pytest.raises(ValueError, match="mined at support 0.2"):
        lattice.rules(0.1)


def test_an_empty_table_of_baskets(spark, tmp_path):
    b = spark.createDataFrame([], "id int, items array<string>")
    assert ar.frequent_itemsets(b, 0.1).count() == 0
    assert ar.Lattice.mine(b, str(tmp_path / "none"), 0.1).rules(0.1).count() == 0


def test_apriori_matches_brute_force(spark):
    b = _baskets(spark, n=120, items="abcde", seed=11)
    baskets = [set(r.items) for r in b.collect()]
    want = {}
    for k in range(1, 4):
        for combo in combinations("abcde", k):
            c = sum(1 for s in baskets if set(combo) <= s)
            if c / len(baskets) >= 0.3:
                want[combo] = (k, c)
    assert _as_dict(ar.frequent_itemsets(b, 0.3, 3)) == want


def test_crosstab_normalisations(spark):
    rows = [("x", "a")] * 3 + [("x", "b")] + [("y", "a")] * 2 + [("y", "c")] * 4 + [(None, "a"), ("y", None)]
    df = spark.createDataFrame(rows, "r string, c string")

    def cells(norm, values=None):
        return {(t.r, t.c): (t.n, t.pct) for t in agg.crosstab(df, "r", "c", normalize=norm, values=values).collect()}

    idx = cells("index")
    assert idx[("x", "a")] == (3, pytest.approx(75.0)) and idx[("x", "c")] == (0, pytest.approx(0.0))
    allc = cells("all")
    assert allc[("y", "c")] == (4, pytest.approx(40.0)) and sum(v[1] for v in allc.values()) == pytest.approx(100.0)
    # Only cells of the listed labels count towards the grand total.
    assert cells("all", ["a", "b"])[("x", "a")] == (3, pytest.approx(50.0))
    col = cells("columns")
    assert col[("y", "a")] == (2, pytest.approx(40.0)) and col[("y", "c")] == (4, pytest.approx(100.0))
