"""The nested results document and the resumable run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import reports as rp
from cohortlens.sources import documents as nd


def tables(spark):
    kv = spark.createDataFrame([("b", 2), ("a", 1), (None, 9), ("c", None)], "k string, v int")
    two = spark.createDataFrame([("y", "q", 1.5), ("x", "q", 2.5), ("x", "p", 3.5)], "o string, i string, v double")
    return kv, two


def test_document_holds_every_shape_and_reads_back(spark, tmp_path):
    kv, two = tables(spark)
    doc = nd.results_document(spark, {
        "summary": nd.as_record(kv.agg(F.sum("v").alias("total"), F.lit(None).cast("string").alias("note"))),
        "deep": {"map": nd.as_map(kv, "k", "v"), "deeper": {"maps": nd.as_nested_map(two, "o", "i", "v")}},
        "rows": nd.as_rows(two, ["o", "i"]),
    })
    path = str(tmp_path / "doc")
    schema = nd.write_document(doc, path)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    assert len(files) == 1
    lines = open(os.path.join(path, files[0])).read().splitlines()
    assert [json.loads(x) for x in lines] == [{
        "summary": {"total": 12, "note": None}, "deep": {"map": {"a": 1, "b": 2, "c": None}, "deeper": {"maps": {"x": {"p": 3.5, "q": 2.5}, "y": {"q": 1.5}}}},
        "rows": [{"o": "x", "i": "p", "v": 3.5}, {"o": "x", "i": "q", "v": 2.5}, {"o": "y", "i": "q", "v": 1.5}]}]
    again = nd.read_document(spark, path, schema)
    assert again.collect() == doc.collect()
    flat = {r.path: (r.number, r.text) for r in nd.flatten_document(again).collect()}
    assert flat["deep.deeper.maps.x.p"] == (3.5, None) and flat["rows.2.o"] == (None, "y") and flat["summary.note"] == (None, None)
    assert len(flat) == 2 + 3 + 3 + 9


def test_sections_of_empty_tables_and_too_many_entries(spark):
    kv, two = tables(spark)
    none = nd.results_document(spark, {"m": nd.as_map(kv.limit(0), "k", "v"), "n": nd.as_nested_map(two.limit(0), "o", "i", "v"), "r": nd.as_rows(two.limit(0), ["o"])})
    assert none.first().asDict() == {"m": {}, "n": {}, "r": []}
    for section in (nd.as_map(kv, "k", "v", limit=2), nd.as_nested_map(two, "o", "i", "v", limit=2), nd.as_rows(two, ["o"], limit=2), nd.as_record(kv)):
        with pytest.raises(Exception, match="at most"):
            nd.results_document(spark, {"s": section}).collect()


def test_a_stopped_run_does_the_other_sections_only(spark, tmp_path):
    done = []

    def section(name, n):
        def plan():
            done.append(name)
            return spark.range(n)
        return plan
    sections = {f"s{i}": section(f"s{i}", i) for i in range(6)}
    path = str(tmp_path / "run")
    broken = sections | {"s3": lambda: spark.range(3).select(F.raise_error(F.lit("lost")).alias("x")), "s5": lambda: 1 / 0}
    with pytest.raises(RuntimeError, match=r"\['s3', 's5'\] failed"):
        rp.run_all(spark, broken, path, parallel=2)
    assert sorted(done) == ["s0", "s1", "s2", "s4"]
    done.clear()
    out = rp.run_all(spark, sections, path)
    assert sorted(done) == ["s3", "s5"]
    assert sorted((r.section, r.n_rows) for r in out.collect()) == [(f"s{i}", i) for i in range(6)]
    done.clear()
    rp.run_all(spark, sections, path, fmt="json")
    assert done == []


def test_a_run_in_another_format(spark, tmp_path):
    out = rp.run_all(spark, {"a": lambda: spark.range(5), "b": lambda: spark.createDataFrame([("x\ny",)], "t string")}, str(tmp_path / "p"), "parquet")
    assert sorted((r.section, r.n_rows) for r in out.collect()) == [("a", 5), ("b", 1)]
