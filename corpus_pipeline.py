"""The training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents:

1. language ID: rows rejected as ``und`` (null texts, texts without a letter) go.
2. SimHash near-dedup: of each component the row with the smallest doc_id stays.
3. substring dedup: texts lose words repeated from earlier; n_chars follows.
4. benchmark decontamination: contaminated rows go.
5. BPE: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import language
from cohortlens.llm.bpe import bpe_encode_decode
from cohortlens.llm.decontaminate import benchmark_hits
from cohortlens.llm.queries import table, tokenizer_path
from cohortlens.llm.scratch import shared_path, ship
from cohortlens.llm.simhash import representatives
from cohortlens.llm.substrings import substring_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; a null text or one without a letter is rejected. Where no
    labelled text is there to learn from, only those are, and every other row stays."""
    ship(spark)
    model = language.train(docs.where(~language.held_out()))
    if not model:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(docs, model, carry=docs.columns)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints: the one with the smallest doc_id."""
    ship(spark)
    return representatives(docs, shingle=3)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without words that a window repeats from earlier. Texts that lose nothing stay
    as they were; the others are their kept words joined by a space."""
    ship(spark)
    out = substring_dedup(docs, carry=docs.columns)
    cut = F.col("n_removed") > 0
    return out.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(cut, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by a benchmark item."""
    ship(spark)
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return hits.where("not contaminated").select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the text decoded from them."""
    ship(spark)
    return bpe_encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("bpe", bpe),
]
#: No SQL: rank-order profiles, XXH64 fingerprints and BPE have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
