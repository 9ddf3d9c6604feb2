import random

import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402
from cohortlens.llm import queries  # noqa: E402
from tests.llm import data as D  # noqa: E402


def fixture():
    rng = random.Random(77)
    rows = D.documents(11, 48)
    items = [(i, D.prose(rng, 30)) for i in range(4)]
    rows += [(700 + i, f"{D.prose(rng, 20)} {t} {D.prose(rng, 20)}", "en", "s", 1) for i, t in items]
    rows += [(800, rows[3][1], "en", "s", 7), (801, "Ωmega", None, None, None)]
    return rows, items


def expected(rows, items):
    """The stages by brute force: {doc_id: text}."""
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = {r[0]: D.fingerprint(r[1]) for r in kept}
    comp = D.classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = sorted((r for r in kept if comp[r[0]] == r[0]), key=lambda r: r[0])
    seen, texts = set(), {}
    for i, t, *_ in kept:
        w, gone = D.spaced_words(t), set()
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        texts[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    bad = D.brute_decontaminate(list(texts.items()), items)
    return {i: t for i, t in texts.items() if not bad[i][4]}


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, D.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    want = expected(rows, items)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: r["decoded"] for i, r in got.items()} == want
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    assert 701 not in got and 801 in got and len(got) < len(rows)


def test_stages_keep_columns_and_take_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, "one", None, None, None), (None, "one", None, None, None), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "two words", None, None, None), (6, None, None, None, None), (7, "", "xx", "s", 0)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, D.SCHEMA)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        if rows:
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(5, "one"), (5, "two words")]


def test_queries_are_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe"]
