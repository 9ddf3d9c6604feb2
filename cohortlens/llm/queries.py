"""The queries of the corpus operators: each applies its operator to the whole
table and derives the contract's digest columns from the operator's outputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 1) = 0
    AND coalesce(len(list_filter(embedding, lambda x: x <> 0)), 0) > 0 AS ok
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.ok AND b.ok AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.u = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.u = v.vec_id""")
def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.embeddings import embedding_near_dedup
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm import language
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    return (language.identify(docs, model).withColumn("held_out", language.held_out())
            .select("doc_id", "held_out", "lang_pred", "score"))


_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op3_decontamination", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw))),
hit AS MATERIALIZED (SELECT dw.doc_id, dw.m, dw.s, bw.item_id FROM dw JOIN bw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.decontaminate import benchmark_hits
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_substring_dedup", """
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.substrings import substring_dedup
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_suffix_dedup", """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM (
  SELECT doc_id, s, sum(CASE WHEN s <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
  FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000000) AS p FROM twice)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2),
    lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) + 1, 2 * ((CASE WHEN i > len(a) THEN length(h) // 2 ELSE a[i] END) - (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)))), '') END AS k
  FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(k)) AS kept_sha256,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(k, '[0-7].|C[2-9A-F][89AB].|D.[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|..'),
    lambda c: len(c) > 2 OR c < '80'), ''))) AS text FROM kept""")
def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.suffixes import suffix_dedup
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


@query("op10_simhash_near_dedup")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.simhash import simhash_near_dedup
    out = simhash_near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op6_token_files")
def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.token_files import token_files
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


@query("op9_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.bpe import bpe_encode_decode
    out = bpe_encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# The rule of op7, restated plainly: of each notice its label, the most words of a place, and the least different
# words of it there; then what must stand in the place (or behind its last word), and what must not follow that.
_NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", 15, 10,
     [(" (this|work|is|licensed|under|the|gnu|general|public|license|version)  3 ", "")]),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 28, 16, []),
    ("licensed under the apache license version 2 0", "apache-2.0", 10, 7, [(" (licensed|under|the)  apache | apache  (license|version|2|0) ", ""), (" 2  0 ", "")]),
    ("released under the mit license", "mit", 7, 4, [(" (released|under|the)  mit | mit  license ", "")]),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 24, 16, []),
    ("licensed under cc by 4 0", "cc-by-4.0", 8, 5, [(" cc  by  4  0 ", " (nc|sa) ")]),
    ("licensed under cc by nc 4 0", "cc-by-nc", 9, 6, [(" cc  by  nc ", " sa ")]),
    ("licensed under cc by sa 4 0", "cc-by-sa", 9, 6, [(" cc  by  sa ", " nc ")]),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 17, 11, []),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", 21, 13, [(" 2  0 ", "")]),
]
_PHRASES = [("gnu general public license", "gpl", 4), ("apache license", "apache", 2), ("cc by", "cc-by", 2), ("mit license", "mit", 2)]


def _license_sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {m})" for p, label, m in _PHRASES)
    notices = ", ".join(f"({i}, list_distinct(string_split('{t}', ' ')), '{label}', {place}, {least})" for i, (t, label, place, least, _) in enumerate(_NOTICES))
    stands = "true"
    for i, (*_, needs) in enumerate(_NOTICES):
        for run, stop in needs:
            # What may not follow is taken out together with the run before the run is looked for.
            norm = f"regexp_replace(norm, '({run})({stop})', '#', 'g')" if stop else "norm"
            stands += f" AND (i <> {i} OR regexp_matches({norm}, '{run}'))"
    step = max(place for _, _, place, *_ in _NOTICES)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_PLAIN} AS w FROM documents),
p(phrase, label, m) AS (VALUES {phrases}),
t(i, words, label, place, least) AS (VALUES {notices}),
place AS (SELECT doc_id, s - 1 AS pos, label FROM (SELECT doc_id, w, label, phrase, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, p) WHERE array_to_string(w[s:s + m - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM place GROUP BY doc_id),
block AS (SELECT doc_id, list_distinct(w[b * {step} + 1:(b + 2) * {step}]) AS bw FROM (SELECT doc_id, w, unnest(range(0, greatest(1, (len(w) + {step - 1}) // {step} - 1))) AS b FROM d)),
hit AS MATERIALIZED (SELECT doc_id, i, count(*) AS n FROM block, t WHERE len(list_intersect(bw, words)) >= least GROUP BY doc_id, i),
win AS (SELECT doc_id, i, label, words, least, w[s:s + place - 1] AS x, ' ' || array_to_string(w[s:s + place], '  ') || ' ' AS norm
  FROM (SELECT doc_id, i, label, words, least, place, w, unnest(range(1, len(w) + 1)) AS s FROM hit JOIN t USING (i) JOIN d USING (doc_id))),
held AS (SELECT doc_id, label, len(list_intersect(list_distinct(x), words)) / len(words) AS share FROM win WHERE len(list_intersect(list_distinct(x), words)) >= least AND ({stands})),
more AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM held GROUP BY doc_id),
n AS (SELECT doc_id, sum(n)::BIGINT AS n_matches FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_matches, 0) AS n_matches
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op7_license_scan", _license_sql())
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.licenses import license_scan
    return license_scan(table(spark, sf_dir, "documents"))


def _chat_sql() -> str:
    from cohortlens.llm import chat
    text = "replace(text, '~', '~0')"
    for c in chat.CONTROL:
        text = f"replace({text}, '{c}', '{chat._SIGN[c[0]] + c[1:]}')"
    role = "replace(replace(" + text.replace("(text,", "(role,", 1) + ", ']', '~3'), '[', '~2')"
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
  (7 + sum(16 + length({role}) + length({text})))::BIGINT AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g"""


@query("op8_chat_formatting", _chat_sql())
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm import chat
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = chat.conversation_messages(rows.union(extra))
    out = chat.format_paths(chat.chosen_paths(messages), messages)
    turns = chat.read_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    out = out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), "formatted")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                      F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) is divisible by 10, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.select("doc_id", "text", "w", F.size("w").alias("n"), F.expr("h div 10").alias("g"))
    rows = rows.select("doc_id", "text", "w", "n", "g", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")).alias("a"))
    rows = rows.withColumn("p", (1 + F.expr("(n - a) div (3 + g % 8)")).cast("int"))
    again = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(again), F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.periodic import periodic_runs
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("m"), listed.alias("listed"), "kept_text")
    return found.select("doc_id", "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
                        F.expr("1000 * m.length div -m.period").alias("exponent_milli"),
                        F.sha2(F.when(F.col("n_runs") > 0, F.concat("listed", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
                        F.sha2("kept_text", 256).alias("collapsed_sha256"))


@query("op12_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""")
def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.naming import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


def _manifest_sql(levels: int = 5) -> str:
    """Trees of at most 16 ** levels leaves per source, and of as many sources; each level joins a node's run with itself."""
    def part(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    text = "text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf, other = (f"sha256({' || '.join(part(c) for c in ['doc_id', 'source', 'lang', 'n_chars', t])})" for t in text)
    crc = ("list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)")
    sql = [f"d AS MATERIALIZED (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {other} ELSE {leaf} END AS altered FROM documents)"]
    sql.append("s0 AS MATERIALIZED (SELECT source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, "
               "count(*) OVER (PARTITION BY source) AS size, leaf AS h, doc_id FROM d)")

    def climb(x):
        for k in range(1, levels + 1):
            sql.append(f"{x}{k} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, (max(size) + 15) // 16 AS size, CASE WHEN max(size) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {x}{k - 1} GROUP BY tree, pos // 16)")
        for k in range(levels):
            sql.append(f"{x}p{k} AS MATERIALIZED (SELECT a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, "
                       f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, max(a.size) > 1 AS step FROM {x}{k} a JOIN {x}{k} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 GROUP BY a.tree, a.pos)")
    climb("s")
    sql.append(f"t0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS size, h FROM s{levels})")
    climb("t")
    sql.append(f"f0 AS (SELECT d.*, s0.tree, s0.pos, altered AS f, '' AS p FROM d JOIN s0 USING (doc_id))")
    n = 0
    for x, tree, pos in (("s", "tree", "pos"), ("t", "0", "tree")):
        for k in range(levels):
            at = f"{pos} // {16 ** k}"
            sql.append(f"f{n + 1} AS (SELECT f.* REPLACE (CASE WHEN q.step THEN sha256(q.l || f.f || q.r) ELSE f.f END AS f, f.p || q.l || q.r AS p) FROM f{n} f JOIN {x}p{k} q ON q.tree = {('f.' + tree) if tree != '0' else 0} AND q.pos = f.{at})")
            n += 1
    return ("WITH " + ",\n".join(sql) + f"\nSELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.p) AS proof_sha256, f.f AS folded_root, f.f = t.h AS verified "
            f"FROM f{n} f JOIN s{levels} s ON s.tree = f.tree CROSS JOIN t{levels} t")


@query("op13_merkle_manifest", _manifest_sql())
def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm import manifest as M
    from cohortlens.llm.naming import fold
    docs = table(spark, sf_dir, "documents")
    record = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = M.record_hash(*record, F.when(docs["text"].isNotNull(), fold(docs["text"])))
    leaves = docs.select("doc_id", "source", M.record_hash(*record, docs["text"]).alias("leaf"), F.when(chosen, altered).alias("altered"))
    out = M.merkle_manifest(leaves, "source", ["doc_id"], ["doc_id", "altered"])
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(M.proof(F.col("path")), 256).alias("proof_sha256"),
                      M.folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
