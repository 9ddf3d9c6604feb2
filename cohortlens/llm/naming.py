"""Exact duplicates by deterministic block naming; DataFrame functions only.

Normalised texts are cut into blocks of ``BLOCK`` bytes. The different blocks
are sorted and numbered: equal blocks, and no others, get the same name. Then
neighbouring names are paired and the different pairs sorted and numbered in
their turn, until every document is one name. Documents of as many blocks are
paired alike, so (number of blocks, name) is equal exactly where texts are.

Blocks are shipped once, to be named, after each task has merged its equal
ones. A document finds its names by a 128-bit digest of each block; whether
two different blocks share a digest is counted on the names, and where any do,
blocks find theirs by their bytes. So no identity rests on a hash. Every table
between two steps is written to the shared folder, and names come from sorted
partitions, so that a task that is run again gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import stored

#: Bytes of a block.
BLOCK = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the missing right name of a last, odd one.
_NONE = -(1 << 63)


def fold(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else, null as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _digest(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def _name(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The different rows, sorted within their partitions and numbered."""
    return rows.select(*columns).distinct().sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def _pieces(docs: DataFrame, block: int) -> DataFrame:
    data = docs.select("doc_id", fold(F.col("text")).cast("binary").alias("data"))
    size = F.octet_length("data")
    n = F.greatest(F.lit(1), F.ceil(size / block).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("data"), i * block + 1, F.lit(block)))
    blocks = F.when(size <= block, F.array("data")).otherwise(cut)
    # Key and count are columns below the explode: beside it the key would number blocks, and the count keep the array.
    return data.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.unhex(F.sha2("data", 256)).alias("sha"), n.alias("n_blocks"), blocks.alias("blocks"))


def _block_names(docs: DataFrame, block: int, digest) -> DataFrame:
    """(key, doc_id, sha, n_blocks, pos, name): every block of every row with its name."""
    pieces = _pieces(docs, block)
    d1, d2 = digest(F.col("block"))
    names = stored(_name(pieces.select(F.explode_outer("blocks").alias("block")), ["block"]).select(d1.alias("d1"), d2.alias("d2"), "name"), "block-names")
    shared = names.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    clash = bool(shared.limit(1).count())
    rows = (pieces.select("key", "doc_id", "sha", "n_blocks", F.posexplode_outer("blocks").alias("pos", "block"))
            .withColumn("d1", d1).withColumn("d2", d2))
    out = ["key", "doc_id", "sha", "n_blocks", "pos", "name"]
    if not clash:
        return rows.drop("block").join(names, ["d1", "d2"]).select(*out)
    # Different blocks share a digest: theirs are named again, apart from the other names, and found by their bytes.
    rows, shared = stored(rows, "block-rows"), stored(shared, "block-clashes")
    unsure = rows.join(shared, ["d1", "d2"], "left_semi")
    again = stored(_name(unsure, ["block"]).select("block", (-1 - F.col("name")).alias("name")), "block-names")
    sure = rows.join(shared, ["d1", "d2"], "left_anti").drop("block").join(names, ["d1", "d2"])
    return sure.select(*out).union(unsure.join(again, "block").select(*out))


def identities(docs: DataFrame, block: int = BLOCK, digest=_digest) -> DataFrame:
    """One name for every row of ``docs``: key, doc_id, sha, n_blocks, name.

    (n_blocks, name) is equal exactly for equal normalised texts; key numbers the rows, and sha is the binary
    SHA-256 of the normalised text, carried along.
    """
    now = stored(_block_names(docs, block, digest).withColumn("n", F.col("n_blocks")), "names")
    done = [now.where("n = 1")]
    most = now.agg(F.max("n")).first()[0] or 1
    while most > 1:
        row = ["key", "doc_id", "sha", "n_blocks"]
        half = F.expr("pos div 2").cast("int").alias("pos")
        pairs = (now.where("n > 1").groupBy(*row, F.expr("(n + 1) div 2").cast("int").alias("n"), half)
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(_NONE)).alias("b")))
        pairs = stored(pairs, "pairs")
        names = stored(_name(pairs, ["a", "b"]), "pair-names")
        now = stored(pairs.join(names, ["a", "b"]).select(*row, "pos", "name", "n"), "names")
        done.append(now.where("n = 1"))
        most = (most + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("key", "doc_id", "sha", "n_blocks", "name")


def exact_dedup(docs: DataFrame, block: int = BLOCK, digest=_digest) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z; the row with the largest doc_id stays.

    One row per input row: doc_id, keep_id (doc_id of the row that stays),
    group_size, kept, text_sha256 (of the normalised text). A null text
    counts as empty. A null doc_id stays only where its group has no other, and
    of rows that share the largest id one stays. ``docs`` may have further
    columns of any name; an empty table gives no row.
    """
    ids = stored(identities(docs.select("doc_id", "text"), block, digest), "identities")
    groups = ids.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "key")).alias("stays"), F.count("*").alias("group_size"))
    # Written before the join, which then is one of two plain tables: a large group's rows can be dealt to several tasks.
    groups = stored(groups.where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    return ids.join(groups, ["n_blocks", "name"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("key") == F.col("stays.key"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
