import hashlib
import io
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cohortlens.llm import bpe, chat, embeddings, licenses, token_files  # noqa: E402
from cohortlens.llm import text as X  # noqa: E402
from cohortlens.llm.lexicon import Lexicon, build  # noqa: E402
from cohortlens.llm.queries import _NOTICES, _PHRASES  # noqa: E402
from tests.llm import data as D  # noqa: E402

ATOMS = ["the", " ", "  ", "\n", "\t", "É", "ñ", " ", "　", "日本", "'s", "'re", "'story", "123", "!!", "<|endoftext|>", "<|startoftext|>", "word", "Word",
         "\x1c", "\x85", "😀", "a" * 40, " ", "é", "-", "…", "\r\n", "x1", "  <|endoftext|>", "<|endo", "́", "ª", "Ⅳ", "İ", "ΑΣ", "aaaa"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randrange(40))) for _ in range(n)]


def le(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))).encode() for _ in range(120)})
    table = build(words, [[i, i + 1] for i in range(len(words))])
    lex = Lexicon(table)
    probe = sorted({*words, *[w + b"a" for w in words], b"c", b""})
    lens = np.array([len(w) for w in probe])
    got = lex.find(np.frombuffer(b"".join(probe), np.uint8), np.cumsum(lens) - lens, lens)
    assert [probe[i] for i in np.flatnonzero(got >= 0)] == words
    assert got[got >= 0].tolist() == list(range(len(words)))
    # minimal: as many states as different sets of continuations
    tails = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(lex.final) == len(tails)
    assert Lexicon(build([], [])).find(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64)).tolist() == [-1]


def test_bpe_matches_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(odd_texts(400))] + [(1000 + r[0], r[1]) for r in D.documents(4, 24)] + [(None, "x"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.bpe_encode_decode(docs, path, words=300).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), le(ids), tok.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == sorted(want)
    assert bpe.bpe_encode_decode(docs.limit(0), path).count() == 0


def test_bpe_of_very_long_words_and_many_special_tokens_takes_time_in_proportion():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, v, lex, rng = Tokenizer.from_file(path), bpe.Vocabulary(path), Lexicon(build([], [])), random.Random(3)
    letters = "etaoinshrdlu" * 3 + "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=n)) for n in (64, 65, 66, 200, 3_000, 1_000_000)] + ["a" * 100_000, "ab" * 40_000, "é" * 500, "=" * 70_000, "  " * 999 + "x"]
    texts += ["<|endoftext|>" * (4_000_000 // 13), "<|endoftext|<|endoftext|>|>" * 300, "x<|endoftext|>"]
    began = time.time()
    ids, n = bpe.encode_slice(*X.buffer(pa.array(texts)), v, lex)
    took = time.time() - began
    upto = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[upto[i]:upto[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]
    assert took < 40


SIGNS = ["a", "B", "é", "É", "İ", "×", "÷", "1", "²", "'", "s", "ll", "t", "-", ",", "…", "“", "́", "̈", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "\x1c", "\x85",
         "Ж", "ж", "ß", "中", "ﬁ", "=", "̸", "9", "½", "Ŀ", "ŉ", "😀", "٣"]


def test_pieces_are_cut_where_the_tokenizer_cuts():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok, encode, rng = Tokenizer.from_str(spec), token_files.ChunkEncoder(spec), random.Random(12)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(14))) for _ in range(20_000)] + odd_texts(300, 9)
    ids, n = encode(*X.buffer(pa.array(texts)))
    upto = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[upto[i]:upto[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(token_files.pieces(*X.buffer(pa.array(["it, größe1 <|X", ""])))[1]) == 5


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i * 7 % 401, t) for i, t in enumerate(odd_texts(400, 5))] + [(None, "null first"), (3, "twice"), (3, "twice"), (5000, None), (5001, "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    folder = f"file://{tmp_path}/tokens"
    got = token_files.token_files(docs, path, 2, folder).collect()
    enc = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(enc(t)), zlib.crc32(le(enc(t)))) for i, t in rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    assert token_files.token_files(docs.limit(0), path, 2).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()


def test_reader_opens_only_the_frames_it_needs_and_checks_them():
    out = Sink()
    w = token_files.Writer(out, frame=50)
    for i in range(100):
        w.add(i, np.arange(i, dtype=np.uint32))
    w.close()
    r = token_files.Reader(Source(out.kept))
    assert [(d, x.tolist()) for d, x in r.documents({3, 70})] == [(3, list(range(3))), (70, list(range(70)))] and r.opened == 2
    assert sum(len(d) for d, _, _ in r.frames()) == 100
    import zstandard
    assert len(zstandard.ZstdDecompressor().decompress(out.kept[:r.offset[1]])) == r.seek[0][1]
    broken = bytearray(out.kept)
    broken[r.offset[5] + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(Source(bytes(broken))).frame(5)


def places_of_notices(t):
    """(label, share) of every place of a notice, and the number of matching blocks, by scanning all windows; the rule from its own table."""
    w, found, n = D.plain_words(t), [], 0
    step = max(place for _, _, place, *_ in _NOTICES)
    for text, label, place, least, needs in _NOTICES:
        words = set(text.split())
        n += sum(len(set(w[b * step:(b + 2) * step]) & words) >= least for b in range(max(1, -(-len(w) // step) - 1)))
        for s in range(len(w)):
            norm = "".join(f" {x} " for x in w[s:s + place + 1])
            if len(set(w[s:s + place]) & words) >= least and all(any(not (stop and re.match(stop, norm[m.end():])) for m in re.finditer(run, norm)) for run, stop in needs):
                found.append((label, len(set(w[s:s + place]) & words) / len(words)))
    return found, n


def brute_licenses(t):
    w = D.plain_words(t)
    at = [(s, label) for p, label, _ in _PHRASES for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
    found, n = places_of_notices(t)
    base = {x for _, x in at}
    return (len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})),
            1.0 if at else max((x for _, x in found), default=0.0), n)


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(6)
    notices = [t for t, _ in licenses.TEMPLATES] + ["MIT  License, mit-license; MIT license", "cc by", "Apache\nLicense"]
    rows = D.documents(6, 24)
    for i in range(80):
        w = rng.choice(notices).split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["the", "zebra", "license"])
        t = " ".join(w)
        rows.append((900 + i, f"{D.prose(rng, 8)}{rng.choice(' \n')}{t.upper() if i % 2 else t}{rng.choice(' \n')}{D.prose(rng, 5)} {t if i % 5 == 0 else ''}", None, None, None))
    # Rows of one id, and of none, keep what is theirs; so do texts at the very end of a block.
    rows += [(None, "cc by cc by", None, None, None), (None, "plain words", None, None, None), (1, "Released under the MIT License", None, None, None), (1, "nothing here", None, None, None)]
    rows += [(3000 + i, " ".join(["x"] * i + ["licensed under cc by 4 0 nc"]), None, None, None) for i in range(40, 60)]
    docs = spark.createDataFrame(rows, D.SCHEMA).withColumn("words", F.lit("clash")).withColumn("norm", F.lit(1))
    got = licenses.license_scan(docs).collect()
    assert sorted(str((r["doc_id"], *tuple(r)[1:])) for r in got) == sorted(str((i, *brute_licenses(t))) for i, t, *_ in rows)
    assert licenses.license_scan(docs.limit(0)).count() == 0
    plan = licenses.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_labels_need_the_words_that_separate_them(spark):
    want = {
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC 3.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by",
        "Licensed under CC BY-ND 4.0.": "cc-by",
        "Licensed under CC BY 3.0": "cc-by",
        "Licensed under CC BY 4.0, figures licensed under CC BY-NC 4.0.": "cc-by,cc-by-4.0,cc-by-nc",
        "Released under the BSD License.": "",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 2.": "gpl",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Zeit mit Licensed under the Apache License, Version 2.0. Haus mit Garten": "apache,apache-2.0",
        "Licensed under the Apache License 2.0": "apache,apache-2.0",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {list(want)[r["doc_id"]]: r["labels"] for r in licenses.license_scan(docs).collect()} == want
    assert {r["doc_id"]: r["score"] for r in licenses.license_scan(docs).collect()}[list(want).index("Released under the BSD License.")] == 0


def window_labels(t):
    return {label for label, _ in places_of_notices(t)[0]}


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    rng = random.Random(8)
    rows, want = [], []
    for text, label in licenses.TEMPLATES:
        for width in (25, 80):
            for before in (0, 7, 20, 33, 500):
                for mark in ("", " * "):
                    rows.append(D.prose(rng, before) + "\n" + "\n".join(mark + x for x in textwrap.wrap(text, width)) + "\n" + D.prose(rng, 30))
                    want.append({label})
    for text, _ in licenses.TEMPLATES:  # one long line, 60 words between any two of the notice
        rows.append(" ".join(f"{D.prose(rng, 60)} {w}" for w in text.split()))
        want.append(set())
    for _ in range(40):  # pieces of notices
        rows.append(" ".join(rng.choice([D.prose(rng, 9), " ".join(rng.choice(licenses.TEMPLATES)[0].split()[rng.randrange(3):])]) for _ in range(9)))
        want.append(window_labels(rows[-1]))
    assert [window_labels(t) for t in rows] == want
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {i: set() for i in range(len(rows))}
    for r in licenses.license_scan(docs).collect():
        got[r["doc_id"]] = set(r["labels"].split(",")) - {"", *[x for _, x in licenses.PHRASES if x not in window_labels(rows[r["doc_id"]])]}
    assert list(got.values()) == want


def test_license_places_in_very_long_texts(spark):
    long = "cc by " * 100_000 + "released under the mit license " * 50_000
    began = time.time()
    got = licenses.license_scan(spark.createDataFrame([(1, long), (2, "x")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["n_base"], got[0]["last_word"], got[0]["labels"]) == (150_000, 200_000 + 5 * 49_999 + 3, "cc-by,mit") and got[0]["n_matches"] > 8_000
    assert time.time() - began < 120


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def formatted(rows):
    m = chat.conversation_messages(rows)
    return chat.format_paths(chat.chosen_paths(m), m)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    signs = [*chat.CONTROL, "~", "~0", "~1", "~2", "<", "[", "]", "\n", "é", "😀", "ok "]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 20)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "odd]r[~le\n"]), None if rng.random() < .1 else "".join(rng.choice(signs) for _ in range(rng.randrange(8)))))
    rows += [(30, 0, "user", "x"), (30, 0, "user", "x"), (30, 0, "assistant", "y"), (None, 0, "user", "n"), (None, None, "assistant", "m")]
    frame = conversations(spark, rows).withColumn("node", F.lit("clash")).withColumn("at", F.lit(1))
    got = formatted(frame).select("tree", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda q: (str(q[0]), q[1] is not None, q[1] or 0, q[2] is not None, q[2] or "", q[3] is not None, q[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {g["tree"]: [tuple(t) for t in g["turns"]] for g in got} == want
    for g in got:
        assert g["formatted"].count("</s>") == 1 and g["formatted"].count("[/TURN]") == len(want[g["tree"]]) and "[INST]" not in g["formatted"]
        loss = []
        for s in g["loss"]:
            x = g["formatted"][s["start"]:s["start"] + s["length"]]
            loss.append(x.replace("~3", "]").replace("~2", "[").replace("~1", "<").replace("~0", "~"))
        assert loss == [x for r, x in want[g["tree"]] if r == "assistant"]
    assert formatted(frame.limit(0)).count() == 0


def test_branches_are_ranked_by_score(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("u", 6, 99, None), ("u", 7, None, 1.0), ("v", 8, None, 2.0)]
    rows += [("w", 100 + i, 99 + i if i else None, 1.0) for i in range(40)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.chosen_paths(m, top=2).collect():
        got.setdefault((r["tree"], r["path"]), []).append((r["at"], r["node"]))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("u", 1): [7], ("u", 2): [6], ("v", 1): [8], ("w", 1): list(range(100, 140))}
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, parent long")).count()


def test_a_conversation_of_very_many_turns(spark):
    n = 5_000
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.lit("é~"), F.col("id").cast("string")).alias("text"))
    m = chat.conversation_messages(rows)
    r = chat.format_paths(chat.chosen_paths(m), m).select("formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert len(r) == 1 and [t["text"] for t in r[0]["turns"]] == [f"é~{i}" for i in range(n)]
    assert [r[0]["formatted"][x["start"]:x["start"] + x["length"]] for x in r[0]["loss"]] == [f"é~0{i}" for i in range(1, n, 2)]


@pytest.mark.parametrize("tile", [512, 7])
def test_embedding_links_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(6, 19))
    for i in range(150):
        v = base[i % 6] + rng.normal(size=19) * rng.choice([0.01, .15, .25, 1])
        rows.append((i, v.astype(np.float32).tolist(), [0, 1, None][i % 3] if i < 100 else 1))
    rows += [(200 + i, rows[4][1], rows[4][2]) for i in range(20)]
    rows += [(300 + i, [x * (i + 2) for x in rows[7][1]], rows[7][2]) for i in range(15)]
    rows += [(400, None, 0), (401, [0.0] * 19, 0), (402, [float("nan")] * 19, 0), (403, [None, *[1.0] * 18], 0), (404, [], 0), (405, [1.0, 2.0], 0), (406, [float("inf")] * 19, 1), (407, [2.0, 4.0], 0), (408, [1e30] * 19, 0), (409, [1e30] * 19, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("box", F.lit(1))
    good = {i: np.array(v, np.float32).astype(float) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {i: g for i, _, g in rows}

    def linked(a, b):
        if a not in good or b not in good or label[a] != label[b] or len(good[a]) != len(good[b]):
            return False
        x, y = good[a], good[b]
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= .93

    ids = [r[0] for r in rows]
    want = {i: (sum(linked(i, j) for j in ids if j != i), c) for i, c in D.classes(ids, linked).items()}
    got = embeddings.embedding_near_dedup(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.embedding_near_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("rotated", "leading", "partitions"), [(2048, 24, 40), (8, 5, 3), (8, 24, 1)])
def test_embedding_axes_of_long_vectors_and_many_partitions(spark, monkeypatch, rotated, leading, partitions):
    monkeypatch.setattr(embeddings, "ROTATED", rotated)
    monkeypatch.setattr(embeddings, "LEADING", leading)
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "PARTS", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9, 30)) * np.linspace(3, .1, 30)
    x = base[rng.integers(0, 9, 240)] + rng.normal(size=(240, 30)) * rng.choice([.02, .3], (240, 1))
    rows = [(i if i % 50 else None, v.tolist(), 1) for i, v in enumerate(x)] + [(7, x[3].tolist(), 1)] * 2
    u = np.array([v for _, v, _ in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= .93
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(partitions)
    got = embeddings.embedding_near_dedup(df).collect()
    comp = D.classes(range(len(rows)), lambda a, b: bool(near[a, b]))
    least = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    want = [(str(rows[k][0]), int(near[k].sum()) - 1, str(least.get(c))) for k, c in comp.items()]
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted(want)


def test_moments_are_added_over_levels_of_partitions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 5)), rng.normal(size=(40, 3))
    rows = [(5, v.tolist()) for v in x] + [(3, v.tolist()) for v in y] + [(2, [1.0, 0.0])]
    nodes = spark.createDataFrame(rows, "dim int, embedding array<double>").repartition(37)
    got = embeddings._added(nodes, {5: 5, 3: 3}, lambda d, u: u.T @ u)
    for d, v in ((5, x), (3, y)):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        assert np.allclose(got[d], u.T @ u)
    assert embeddings._added(nodes.limit(0), {5: 5}, lambda d, u: u.T @ u)[5].any() == False  # noqa: E712


def test_pairs_of_tiles_grow_with_the_rows_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 32)
    rng, seen = np.random.default_rng(9), {}
    for n in (600, 2400):
        centres = rng.normal(size=(n // 30, 12))
        x = centres[np.arange(n) % (n // 30)] + rng.normal(size=(n, 12)) * .02
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
        p = u @ axes
        rows = [(i, 1, 12, v[:embeddings.BOX].tolist(), float(np.sqrt(max(0, 1 - (v[:embeddings.BOX] ** 2).sum())))) for i, v in enumerate(p)]
        placed = spark.createDataFrame(rows, "node long, label int, dim int, box array<double>, rest double")
        tiled, pairs = embeddings._tiles(placed, .93)
        tile = {r["node"]: r["tile"] for r in tiled.collect()}
        found = {(r["x"], r["y"]) for r in pairs.collect()}
        seen[n] = len(found)
        assert max(np.bincount(np.unique(list(tile.values()), return_inverse=True)[1])) <= 32
        i, j = np.nonzero(u @ u.T >= .93)
        assert all((tile[a], tile[b]) in found or (tile[b], tile[a]) in found for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert seen[2400] < 8 * seen[600] and seen[2400] < 2400 / 16 * 2400 / 16 / 4


@pytest.mark.parametrize("lines", [512, 7])
def test_pruned_comparison_is_exact(monkeypatch, lines):
    monkeypatch.setattr(embeddings, "LINES", lines)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 24))
    x[40:] = x[:40] + rng.normal(size=(40, 24)) * .25
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = embeddings.close_pairs(x, x, axes, .93, True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(80) for b in range(a + 1, 80) if u[a] @ u[b] >= .93}
