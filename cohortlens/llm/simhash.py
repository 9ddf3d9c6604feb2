"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that
differ in at most two bits, one segment differs in at most one bit, so the
pair shares one of that segment's one-wildcard variants: the segment with
bit j masked, for each j. Variants are joined by equality and the candidate
pairs verified by their bit distance. Equal fingerprints are one node from
the start, so copies never meet in a join.

A variant shared by more than ``HOT`` fingerprints is not paired up. Its
fingerprints get finer keys instead, in which all members of a key are links
by construction: the hot segment kept (or without the wildcard bit) and two
(or one) bits of the other segment masked. Two members of the variant are
linked exactly when they share such a key, and joining each member with the
smallest one of its key connects them in linear space.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.anchors import LEAST
from cohortlens.llm.components import components
from cohortlens.llm.scratch import keep

SEED = 42
#: A variant with more fingerprints than this gets finer keys in place of pairs.
HOT = 48


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprint of each document: bit set when set in over half of its shingles' hashes."""
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offsets, X.SPACE)
    out, s, e = X.spaced(data, starts, ends)
    n = np.diff(first)
    k = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    of = X.ragged(first[:-1], k)
    last = of + np.repeat(np.minimum(n, shingle), k) - 1
    flat, h = out.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(flat[a:b], SEED) for a, b in zip(s[of].tolist(), e[last].tolist(), strict=True)), np.uint64, len(of))
    result = np.zeros(len(n), np.uint64)
    if len(hashes):
        # One byte per bit; eight bytes are added as one integer, which 255 rows cannot overflow.
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        blocks = -(-k // 255)
        of_doc = np.repeat(np.arange(len(k)), blocks)
        at = X.ragged(np.zeros(len(k), np.int64), blocks) * 255 + (np.cumsum(k) - k)[of_doc]
        part = np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.int32)
        full = np.flatnonzero(k)
        ones = np.add.reduceat(part, (np.cumsum(blocks) - blocks)[full], axis=0)
        result[full] = np.packbits(2 * ones > k[full][:, None], axis=1).view(">u8").ravel()
    return result


def with_fingerprint(docs: DataFrame, shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id) and fp (long) of every row; null or blank texts have fp zero."""
    return X.map_docs(docs, [("fp", "bigint")], lambda d, o: [fingerprints(d, o, shingle).view(np.int64)], carry)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` at two or fewer differing bits.

    Every edge is a link, and any two linked fingerprints are connected by edges.
    """
    half = F.when(F.col("w") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    mask = F.bitwise_not(F.expr("shiftleft(1L, cast(w % 32 as int))"))
    variants = (nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w"))
                .select("fp", F.shiftleft(F.col("w").cast("long"), 32).bitwiseOR(half.bitwiseAND(mask)).alias("key")))
    shared = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = keep(variants.join(shared, "key"))
    cold = hits.where(F.col("n") <= HOT)
    pairs = (cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b"))
    # Finer keys of the hot variants: the bits masked, as one long, and the rest.
    hot = hits.where(F.col("n") > HOT).select("fp", F.shiftright("key", 32).alias("w"))
    low = [sum(1 << b for b in c) for c in combinations(range(32), 2)]
    two = F.array(*[F.lit(m).cast("long") for m in low])
    here = F.col("w") < 32  # the hot segment is the upper half
    both = hot.select("fp", here.alias("up")).distinct().select(
        "fp", F.explode(F.transform(two, lambda m: F.when(F.col("up"), m).otherwise(F.shiftleft(m, 32)))).alias("m"))
    bit = F.when(here, F.expr("shiftleft(1L, cast(32 + w as int))")).otherwise(F.expr("shiftleft(1L, cast(w - 32 as int))"))
    each = hot.select("fp", "w", bit.alias("bit")).select(
        "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("bit").bitwiseOR(
            F.when(F.col("w") < 32, F.call_function("shiftleft", F.lit(1).cast("long"), i))
            .otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i + 32))))).alias("m"))
    finer = both.union(each).select("fp", "m", F.col("fp").bitwiseAND(F.bitwise_not("m")).alias("rest"))
    star = finer.groupBy("m", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = finer.join(star.select("m", "rest", "a"), ["m", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, root): the component of every fingerprint."""
    # Each row grows 64-fold next, so they are dealt to as many tasks as shuffles have, however few bytes they are.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = keep(prints.select("fp").distinct().repartition(tasks, "fp"))
    comp = components(links(nodes))
    return keep(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def simhash_near_dedup(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Components of documents whose fingerprints differ in two or fewer bits.

    One row per input row: doc_id, fp (long), component_id = smallest doc_id
    reachable by links. Null or blank texts have fingerprint zero and are
    linked like any other. Rows that repeat a doc_id keep their rows. Rows
    with a null doc_id keep a row and take the smallest non-null id of their
    component (null when there is none).
    """
    prints = keep(with_fingerprint(docs, shingle))
    roots = _classes(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = keep(roots.join(least, "fp"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = keep(known.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id.

    Of different rows that share it, the least by a hash of the row stays, of
    equal rows one. A null doc_id stays only where its component has no other.
    """
    named = docs.withColumn("row__", F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]))
    prints = keep(with_fingerprint(named, shingle, ["doc_id", "row__"]))
    rows = prints.join(_classes(prints), "fp")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row__")).alias("f"))
    first = keep(first.select(F.coalesce(F.col("f.doc_id").cast("bigint"), F.lit(LEAST)).alias("d__"), F.col("f.row__").alias("r__")))
    twice = prints.groupBy("doc_id", "row__").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    named = named.withColumn("d__", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST))).withColumnRenamed("row__", "r__")
    kept = named.join(first, ["d__", "r__"], "left_semi")
    if twice:
        kept = kept.dropDuplicates(["d__", "r__"])
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])
