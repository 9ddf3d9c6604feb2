"""Findings of round 4: a run computes the profile once, starts long sections first and lets go of what it shuffled."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import classify as clf
from cohortlens.operators import cluster as cl
from cohortlens.operators import regress as rg
from cohortlens.plans import catalog_models as cm
from cohortlens.plans import catalog_reports as cr
from cohortlens.plans import catalog_tables as ct
from cohortlens.plans import reports as rp
from cohortlens.plans.registry import QUERIES
from cohortlens.session import release

ROOT = "/root/testdata/sf0.001"


def test_sections_of_a_run_read_one_profile(spark, monkeypatch):
    names = ["descriptive", "diagnostic", "scatter", "opportunity", "crosstabs", "correlations", "business"]
    wanted = {n: sorted(map(repr, QUERIES[cr._SECTIONS[n][0]](spark, ROOT).collect())) for n in names}
    seen, plain = spark.sparkContext.accumulator(0), cm.profile

    @F.udf("double")
    def note(x):
        seen.add(1)
        return x

    def counted(spark, root):
        return plain(spark, root).withColumn("target_amount", note.asNondeterministic()("target_amount"))
    for module in (cm, cr, ct):
        monkeypatch.setattr(module, "profile", counted)
    monkeypatch.setattr(cm, "_cache", {})
    sections = cr._sections(spark, ROOT)
    assert list(sections) == list(cr._SECTIONS)
    found = {n: sorted(map(repr, sections[n]().collect())) for n in names}
    assert seen.value == plain(spark, ROOT).count()
    assert found == wanted


def test_long_sections_start_first(spark, tmp_path):
    started = []

    def section(name):
        started.append(name)
        return spark.range(len(started))
    names = ["a", "b", "c", "d"]
    out = rp.run_all(spark, {n: (lambda n=n: section(n)) for n in names}, str(tmp_path / "p"), parallel=1, first=["d", "b", "none"])
    assert started == ["b", "d", "a", "c"]
    assert sorted(map(tuple, out.collect())) == [("a", 3), ("b", 1), ("c", 4), ("d", 2)]


def test_release_has_the_driver_collect_what_no_plan_uses(spark):
    def whole():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    release(spark)
    assert whole() > before


def test_a_run_lets_go_of_every_section(spark, tmp_path, monkeypatch):
    """Also of one that fails, and of the profile's joins once it is written."""
    calls = []
    for module in (rp, cm):
        monkeypatch.setattr(module, "release", lambda spark: calls.append(module.__name__))
    with pytest.raises(RuntimeError):
        rp.run_all(spark, {"a": lambda: spark.range(2), "b": lambda: spark.range(2).select("none")}, str(tmp_path / "p"), parallel=1)
    assert len(calls) == 2
    monkeypatch.setattr(cm, "_cache", {})
    cm._profile(spark, ROOT)
    assert len(calls) == 3


def test_forests_grow_one_after_another(spark, monkeypatch):
    now, most, lock = [], [], threading.Lock()

    class Slow:
        def fit(self, train):
            with lock:
                now.append(train)
                most.append(len(now))
            time.sleep(0.3)
            with lock:
                now.remove(train)
            return train
    for module in (clf, rg):
        monkeypatch.setattr(module, "_pipeline", lambda features, est: Slow())
    fits = [lambda: clf.fit_random_forest("a", ["x"], "y"), lambda: rg.fit_rf_regressor("b", ["x"], "y"), lambda: rg.fit_rf_regressor("c", ["x"], "z")]
    assert cl.run_parallel(fits, 3) == ["a", "b", "c"] and most == [1, 1, 1]
