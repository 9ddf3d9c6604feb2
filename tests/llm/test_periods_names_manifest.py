import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import manifest, naming, periodic
from cohortlens.llm.queries import planted_periods
from tests.llm import data as D

CLASH = ("words", "runs", "key", "name", "n", "hash", "tree", "pos", "path", "size", "group__x", "block", "sha")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, D.SCHEMA)
    for c in CLASH if extra else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_runs(w):
    """Every lag, one comparison per pair of words; the smallest period of each stretch."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(160):
        letters = "abcdefghijklmnopqrstuvwxyz"[:rng.choice([1, 2, 3, 26])]
        w = [rng.choice(letters) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65])
            unit = [rng.choice(letters) + rng.choice(["", "x"]) for _ in range(p)]
            w[rng.randrange(len(w) + 1):0] = (unit * 6)[:rng.randrange(3 * p, 6 * p + 1)]
        out.append(rng.choice([" ", "\t", " \n "]).join(w))
    return out


def test_runs_match_brute_force(spark):
    texts = periodic_texts() + [None, "", " \n ", "a", "a a a a a", "a a a a a a", "ab " * 5000, "a b a b a b a b a b a b",
                                " ".join(D.prose(random.Random(4), 90).split() * 5) + " end", "É é É é É é É é"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (3, texts[3], None, None, None), (3, "x " * 7, None, None, None)]
    got = periodic.periodic_runs(frame(spark, rows, extra=True)).collect()
    want = []
    for i, t, *_ in rows:
        runs = brute_runs(split(t))
        want.append((str(i), len(split(t)), runs, brute_kept(split(t), runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in got) == sorted(want)
    assert sum(len(x[2]) for x in want) > 100 and {q > 16 for _, _, runs, _ in want for *_, q in runs} == {True, False}
    assert periodic.periodic_runs(frame(spark, []).limit(0)).count() == 0


def test_runs_of_random_words_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        docs = [np.concatenate([np.tile(rng.integers(0, rng.integers(1, 40), rng.integers(1, 40)), rng.integers(1, 7)) for _ in range(rng.integers(1, 4))]) for _ in range(rng.integers(1, 5))]
        docs.insert(rng.integers(0, len(docs) + 1), np.zeros(0, np.int64))
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = list(zip(*[x.tolist() for x in periodic.word_runs(np.concatenate(docs), first)], strict=True))
        assert got == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d.tolist())]


def test_a_very_long_text_takes_time_in_proportion():
    import time
    rng = np.random.default_rng(6)
    unit = rng.integers(0, 50_000, 70_000)
    ids = np.concatenate([rng.integers(0, 50_000, 100_000), np.tile(unit, 5), np.tile(rng.integers(0, 9, 3), 100_000), np.zeros(100_000, np.int64)])
    began = time.time()
    doc, start, length, period = periodic.word_runs(ids, np.array([0, len(ids)]))
    assert (100_000, 350_000, 70_000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert 3 in period and 1 in period and time.time() - began < 20


def planted(i, t):
    w, h = split(t), zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def test_the_query_plants_periods_as_its_contract_says(spark):
    rows = D.documents(11, 40) + [(None, "a b c", None, None, None)] + [(5000 + i, t, None, None, None) for i, t in enumerate(["x", "x y", "", None, "x y z"] * 20)]
    got = planted_periods(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), split(r["text"])) for r in got) == sorted((str(i), planted(i, t)) for i, t, *_ in rows)
    assert any(planted(i, t) != split(t) for i, t, *_ in rows)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def dedup_rows():
    rng = random.Random(8)
    rows = D.documents(12, 40)
    base = D.prose(rng, 60)
    for i in range(60):
        rows.append((2000 + i, rng.choice([base, base.upper(), base + " ", base[:-1], base * 3, "", None, "É", "é", "A", "a", "ab" * 100, "ab" * 101, base.replace("e", "É")]), None, "s", None))
    return rows + [(None, base, None, None, None), (None, "only null", None, None, None), (None, "only null", None, None, None), (2100, "twice", None, None, None), (2100, "twice", None, None, None)]


def weak_digest(block):
    return [F.length(block) % 3, F.lit(0)]


@pytest.mark.parametrize(("block", "digest"), [(naming.BLOCK, naming._digest), (7, naming._digest), (16, weak_digest)])
def test_exact_dedup_matches_brute_force(spark, block, digest):
    rows = dedup_rows()
    got = naming.exact_dedup(frame(spark, rows, extra=True), block, digest).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(str(i), str(keep[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_block_naming_is_native_and_takes_empty_and_long_texts(spark):
    assert naming.exact_dedup(frame(spark, []).limit(0)).count() == 0
    long = "Wörter " * 150_000
    got = naming.exact_dedup(frame(spark, [(1, long, None, None, None), (2, long.replace("W", "w"), None, None, None), (3, long + "!", None, None, None)])).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(1, 2), (2, 2), (3, 3)]
    plan = naming._block_names(frame(spark, dedup_rows()), naming.BLOCK, naming._digest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, fanout):
    """(top, proof steps of every leaf)."""
    paths, owner, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(now) > 1:
        runs = [range(a, min(a + fanout, len(now))) for a in range(0, len(now), fanout)]
        for run in runs:
            for s in run:
                for leaf in owner[s]:
                    paths[leaf].append(("".join(now[x] for x in run if x < s), "".join(now[x] for x in run if x > s)))
        now, owner = [H(*[now[s] for s in run]) for run in runs], [[x for s in run for x in owner[s]] for run in runs]
    return now[0], paths


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifest_matches_brute_force(spark, fanout):
    rng = random.Random(13)
    rows = [(i, rng.choice(["Text É", None, "", "ABC"]) , None, rng.choice(["a", "a", "a", "a", "É", None, "B", f"own {i}"]), rng.choice([3, None])) for i in range(300)]
    rng.shuffle(rows)
    docs = frame(spark, rows, extra=True).repartition(5)
    names = [f.name for f in D_FIELDS(spark)]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    leaf = manifest.record_hash(*[F.col(c) for c in ("doc_id", "source", "text")])
    got = manifest.merkle_manifest(docs.withColumn("leaf", leaf), "source", ["doc_id"], ["doc_id", "hash"], fanout).withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held, subs = [], []
    for s in sources:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: r["doc_id"])
        hashes = [H(field(r["doc_id"]), field(r["source"]), field(r["text"])) for r in mine]
        top, paths = tree(hashes, fanout)
        subs.append(top)
        held.append([(r["doc_id"], h, p) for r, h, p in zip(mine, hashes, paths, strict=True)])
    root, above = tree(subs, fanout)
    want = {i: (h, subs[k], root, [*p, *above[k]]) for k, own in enumerate(held) for i, h, p in own}
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["path"]]) for r in got} == want
    assert {r["folded"] for r in got} == {root} and {r["hash"] for r in got} == {"clash"}


def D_FIELDS(spark):
    return spark.createDataFrame([], D.SCHEMA).schema.fields


def test_manifest_of_odd_tables(spark):
    make = lambda rows: manifest.merkle_manifest(spark.createDataFrame(rows, "doc_id long, source string, leaf string"), "source", ["doc_id"], ["doc_id"])
    assert make([]).count() == 0
    one = make([(None, None, "x")]).first()
    assert (one["subroot"], one["root"], one["path"]) == ("x", "x", [])
    same = [(None, "s", "x")] * 40 + [(1, "s", "y"), (1, "s", "z")]
    got = make(same).withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).collect()
    top, _ = tree([x[2] for x in same], 16)
    assert len(got) == 42 and {r["root"] for r in got} == {top} == {r["folded"] for r in got}
    bad = make(same).select(manifest.folded(F.lit("w"), F.col("path")).alias("f")).where(F.col("f") == top)
    assert bad.count() == 0
