import importlib.util

from conftest import SF_SMALL

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns[:2] == ["segment", "n"]
    assert sum(r["n"] for r in rows) == 150


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 90
    assert len(o) >= 70
    corpus = any(n.startswith("op") and n[2:3].isdigit() for n in q)
    assert corpus == (importlib.util.find_spec("cohortlens.llm") is not None)
    assert set(o) <= set(q)


def test_fixture_facts(spark):
    from pyspark.sql import functions as F
    from cohortlens.sources.views import basket, profile
    p = profile(spark, SF_SMALL)
    r = p.agg(F.count("*").alias("n"), F.sum("target_flag").alias("f"), F.sum("score_1_10").alias("s"),
              F.sum("tier_code").alias("t"), F.sum("region_code").alias("g")).first()
    assert (r.n, r.f, r.s, r.t, r.g) == (150, 68, 888, 552, 443)
    assert basket(spark, SF_SMALL).count() == 1473
