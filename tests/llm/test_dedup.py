import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import anchors, simhash
from cohortlens.llm.sais import suffix_array
from cohortlens.llm.substrings import substring_dedup
from cohortlens.llm.suffixes import suffix_dedup
from tests.llm import data as D


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, D.SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        for c in ("d", "h", "at", "anchor", "n_words", "fp", "kept", "text__", "key"):
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = D.documents()
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(frame(spark, rows, extra=True)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == D.brute_substring(rows)
    assert sum(v[1] for v in got.values()) > 1000


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = D.documents(5)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup(frame(spark, rows, extra=True)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == D.brute_suffix(rows)


def test_dedup_of_empty_tables_and_null_ids(spark):
    empty = spark.createDataFrame([], D.SCHEMA)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
    assert simhash.simhash_near_dedup(empty).count() == 0
    t = D.prose(__import__("random").Random(1), 100)
    df = frame(spark, [(None, t, None, None, None), (1, t, None, None, None), (2, t, None, None, None), (2, t, None, None, None)])
    assert sorted((str(r[0]), r[1]) for r in substring_dedup(df).select("doc_id", "n_removed").collect()) == [("1", 100), ("2", 100), ("2", 100), ("None", 0)]
    assert {r[0] for r in suffix_dedup(df).select("n_removed").collect()} == {len(t.encode())}
    assert {r["component_id"] for r in simhash.simhash_near_dedup(df).collect()} == {1}


def test_equal_rows_are_equals(spark):
    t = D.prose(__import__("random").Random(2), 50)
    df = frame(spark, [(1, t, None, None, None)] * 2)
    assert [r[0] for r in substring_dedup(df).select("n_removed").collect()] == [0, 0]


@pytest.mark.parametrize("hot", [simhash.HOT, 0])
def test_simhash_matches_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = __import__("random").Random(7)
    rows = D.documents(9, 48)
    base = D.prose(rng, 400)
    for i in range(60):  # near copies a few bits apart
        w = base.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w), None, None, None))
    prints = {r[0]: D.fingerprint(r[1]) for r in rows}
    want = D.classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.simhash_near_dedup(frame(spark, rows, extra=True)).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want) - 40


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(4)
    for k in range(200):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0)
        if k % 7 == 0:
            t = np.append(np.tile(rng.integers(1, 4, 3), 30), 0)
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_memory_of_a_task_is_bounded_where_pieces_overlap(spark, monkeypatch):
    """Pieces of bytes are made from a part of a slice and written by portions, also when all of a text is wanted."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, 120_000, np.uint8)).decode() for _ in range(60)]
    docs = spark.createDataFrame([], "d long, h long, text string")
    wanted = spark.createDataFrame([], "d long, h long, at long, anchor long, c long")
    hot = spark.createDataFrame([], "d long, h long, at long, tokens binary")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema, *a: fn)
    tokens = lambda data, offsets: (data, offsets)
    u1, n = np.dtype(np.uint8), len(texts)
    ids, zero = pa.array(range(n)), pa.array([0] * n)
    places = []
    for text in texts:
        start, length, anchor, _ = anchors.pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 400, 200)
        places.append([{"at": int(s) << 10 | int(m), "anchor": int(a), "c": 2} for s, m, a in zip(start, length, anchor.view(np.int64), strict=True)])
    lists = pa.array(places, pa.list_(pa.struct([("at", pa.int64()), ("anchor", pa.int64()), ("c", pa.int64())])))
    given = [(anchors._occurrences(docs, tokens, 400, 200, u1), pa.RecordBatch.from_arrays([ids, zero, pa.array(texts)], ["d", "h", "text"])),
             (anchors._extract(docs, wanted, tokens, 400), pa.RecordBatch.from_arrays([ids, zero, lists, pa.array(texts)], ["d", "h", "wanted", "text"])),
             (anchors._cut(hot, u1, 400, 304), pa.RecordBatch.from_arrays([ids, zero, zero, pa.array([t.encode() for t in texts])], ["d", "h", "at", "tokens"]))]
    for run, batch in given:
        tracemalloc.start()
        rows = sum(part.num_rows for part in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= sum(map(len, places)) and peak < 100 << 20
