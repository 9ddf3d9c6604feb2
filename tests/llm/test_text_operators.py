import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import decontaminate, language
from cohortlens.llm import text as X
from tests.llm import data as D


def packed(texts):
    e = [t.encode() for t in texts]
    return np.frombuffer(b"".join(e), np.uint8), np.cumsum([0] + [len(x) for x in e])


def test_wu_manber_matches_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        voc = ["a", "B", "cé", "9", "z"][:rng.randint(1, 5)]
        items = [(i, " ".join(rng.choice(voc) for _ in range(rng.choice([0, 1, 2, 4, 6])))) for i in range(rng.randint(0, 6))]
        rows = [(i, "-".join(rng.choice([*voc, "q"]) for _ in range(rng.choice([0, 1, 5, 30, 600])))) for i in range(12)]
        m = decontaminate.Matcher(items, 4)
        n, runs, found = m.scan(*packed([t for _, t in rows]))
        got = {i: (int(a), sum(y - x for x, y in r), len(f)) for i, (a, r, f) in enumerate(zip(n, runs, found, strict=True))}
        assert got == {k: v[:3] for k, v in D.brute_decontaminate(rows, items, 4).items()}


def items_and_rows():
    rng = random.Random(8)
    rows = D.documents(8, 36)
    items = [(i, D.prose(rng, 30)) for i in range(12)] + [(20, "One, TWO"), (21, None), (22, "?"), (3, "w1 w2"), (23, "x")]
    rows += [(500 + i, f"{D.prose(rng, 40)}, {t.upper() if t else ''} {D.prose(rng, 9 * i)}", None, None, None) for i, t in items]
    items.append((99, " ".join(D.plain_words(rows[5][1] or "a b c")[:13])))
    return items, rows


def test_benchmark_hits_in_one_and_several_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    items, rows = items_and_rows()
    want = D.brute_decontaminate(rows, items)
    docs = spark.createDataFrame(rows, D.SCHEMA).withColumn("hits", F.lit("clash")).withColumn("n_words", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("part", F.lit(1))
    for limit, scan in ((decontaminate.BLOCK_BYTES, 4), (500, 4), (500, 100)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "SCAN_BLOCKS", scan)
        blocks = decontaminate._blocks(bench)
        assert (len(blocks) > 3 and all(isinstance(b, str) for b in blocks)) if limit == 500 else len(blocks) == 1
        got = decontaminate.benchmark_hits(docs, bench).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), D.sha(",".join(r["items"])), r["contaminated"]) for r in got} == want
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert sum(v[4] for v in want.values()) > 5


def test_a_large_benchmark_takes_a_bounded_broadcast():
    import pickle
    rng = np.random.default_rng(4)
    words = np.array([f"w{i:x}" for i in range(200_000)])
    items = [(str(i), " ".join(words[rng.integers(0, len(words), 60)])) for i in range(decontaminate.BLOCK_BYTES // 390)]
    size = sum(len(t) for _, t in items)
    m = decontaminate.Matcher(items)
    assert size > 0.9 * decontaminate.BLOCK_BYTES and len(pickle.dumps(m)) < 100_000_000
    assert all(g.shift.dtype == np.uint8 and g.shift.nbytes <= 1 << decontaminate.BITS for g in m.groups)
    text = "x y z " + " ".join(items[7][1].split()[20:40]) + " q " + " ".join(items[9][1].split()[:12])
    n, runs, found = m.scan(*packed([text]))
    assert (n.tolist(), runs, [[items[i][0] for i in f] for f in found]) == ([36], [[(3, 23)]], [["7"]])


def test_shared_table_entries_lose_nothing(monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS", 2)  # every block shares an entry with others
    items, rows = items_and_rows()
    m = decontaminate.Matcher([(str(i), t) for i, t in items])
    n, runs, found = m.scan(*packed([t or "" for _, t, *_ in rows]))
    got = {i: (sum(b - a for a, b in r), len({m.names[k] for k in f})) for (i, *_), r, f in zip(rows, runs, found, strict=True)}
    assert got == {i: v[1:3] for i, v in D.brute_decontaminate(rows, items).items()}


def test_language_profiles(spark):
    from pyspark.sql import functions as F
    rng = random.Random(1)
    voc = {"aa": ["the", "and", "thing", "of"], "bb": ["una", "que", "ñandú", "los"]}
    rows = [(i, " ".join(rng.choice(voc[g]) for _ in range(40)), g) for i in range(60) for g in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa"), (101, "12 ?!", "aa"), (102, "", "bb"), (103, "the " * 5000, None), (None, "que", "bb"), (104, "Ω", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))
    model = language.train(docs.where(~language.held_out()))
    assert sorted(model) == ["aa", "bb"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(got) == len(rows)
    for i, _, g in rows[:60]:
        assert got[i]["lang_pred"] == g and 0 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] == "aa"
    assert got[104]["lang_pred"] in ("aa", "bb")
    assert language.train(docs.limit(0)) == {} and language.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}


def test_profile_counts_and_ranks_match_brute_force():
    from collections import Counter
    texts = ["The cat é x", "", "12 3", "a", "Ñandú the the a-b", "zz " * 3000]
    doc, code, n = language._counts(*packed(texts))
    for i, t in enumerate(texts):
        want = Counter()
        import re
        for w in re.findall(rb"[a-z\x80-\xff]+", D.lower(t).encode()):
            p = b" " + w + b" "
            want.update(int.from_bytes(p[j:j + 1], "big") for j in range(1, len(p) - 1))
            want.update(int.from_bytes(p[j:j + 2], "big") for j in range(len(p) - 1))
            want.update(int.from_bytes(p[j:j + 3], "big") for j in range(len(p) - 2))
        assert dict(zip(code[doc == i].tolist(), n[doc == i].tolist(), strict=True)) == want
        d, c, r = language._ranked(doc, code, n, 10)
        assert c[d == i].tolist() == [g for g, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]]


def brute_grams(t):
    from collections import Counter
    out = Counter()
    for w in re.findall(rb"[a-z\x80-\xff]+", D.lower(t or "").encode()):
        p = b" " + w + b" "
        out.update(p[j:j + k] for k in (1, 2, 3) for j in range(len(p) - k + 1) if p[j:j + k] != b" ")
    return out


def brute_ranks(c, top):
    return {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], int.from_bytes(x[0], "big")))[:top])}


@pytest.mark.parametrize(("limit", "at_once"), [(2000, 32), (2000, 2), (4, 1)])
def test_training_distance_choice_and_score_match_brute_force(spark, monkeypatch, limit, at_once):
    from collections import Counter
    monkeypatch.setattr(language, "MAX_LANGUAGES", limit)
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    rng, top = random.Random(9), 12
    names = [f"l{i}" for i in range(9)] + ["twin a", "twin b"]  # the twins have equal profiles: the first wins
    voc = {x: [D.prose(random.Random(x[:4]), 1, 40) + rng.choice("abcé") for _ in range(6)] if "twin" not in x else ["qq", "qx", "qé"] for x in names}
    rows = []
    for i in range(150):
        x = names[i % 9] if i < 130 else names[9 + i % 2]
        words = voc[x] if i >= 130 else [rng.choice(voc[x]) for _ in range(rng.randrange(1, 30))]
        rows.append((i % 140, rng.choice([" ", "-", " 7 "]).join(words), x if i % 10 else None))  # some ids repeat
    rows += [(900, None, "l0"), (901, "", "l1"), (902, "12 ?", "l1"), (903, "zz", None), (903, "zz", None), (904, " ".join(voc["l3"]) * 400, None), (None, "qq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = {}
    for _, t, x in rows:
        if x is not None and t is not None:
            total.setdefault(x, Counter()).update(brute_grams(t))
    profiles = {x: brute_ranks(c, top) for x, c in total.items() if c}
    model = language.train(docs, top=top)
    assert isinstance(model, language.StoredProfiles) == (limit < 11)
    got = language.identify(docs, model, top=top).collect()
    want = []
    for i, t, _ in rows:
        own = brute_ranks(brute_grams(t), top)
        if not any(c.isalpha() for c in t or ""):
            want.append((str(i), "und", 0.0))
            continue
        far = {x: sum(abs(r - p[g]) if g in p else top for g, r in own.items()) for x, p in profiles.items()}
        x = min(far, key=lambda x: (far[x], x))
        want.append((str(i), x, round(1 - far[x] / (len(own) * top), 9)))
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(want)
    assert "twin a" in {w[1] for w in want} and "twin b" not in {w[1] for w in want}


def test_words_split_at_documents():
    s, e, first = X.words(*packed(["a b", "c", "", " d"]), X.SPACE)
    assert (s.tolist(), e.tolist(), first.tolist()) == ([0, 2, 3, 5], [1, 3, 4, 6], [0, 2, 3, 3, 4])


def test_a_slice_of_language_id_takes_little_memory():
    """Two workers and a JVM share an executor: a slice's n-grams stay under 100 MB however large a batch is."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(4_000)) for _ in range(130)]  # about 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    profile = {"xx": list(range(0x616161, 0x616161 + 300))}
    tracemalloc.start()
    for part in X.slices(batch, language.SLICE_BYTES):
        language.classify(*X.buffer(part.column("text")), [profile])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
