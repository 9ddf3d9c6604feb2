"""Benchmark decontamination by Wu-Manber search over word windows.

The patterns are the windows of the benchmark items, as sequences of word
numbers. For each pattern length a table gives, for every block of two
words, how far a scan may move on when it sees that block: blocks that no
pattern holds allow a move over a whole window. Only where the table says
zero do the hashes of the last words select test patterns, which are then
compared word by word. Scans run in lock step over many stretches of text.

A benchmark of at most ``BLOCK_BYTES`` of text travels to the tasks as one
broadcast. Of a larger one no text comes to the driver: Spark writes its items
to the shared folder in blocks, tasks build a block's tables from its file, and
the documents are scanned once for every ``SCAN_BLOCKS`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.scratch import filesystem, shared_path

WINDOW = 13
#: Benchmark text in one broadcast; at most about so much in a stored block.
BLOCK_BYTES = 16 << 20
#: A shift table has 2 ** BITS entries of a byte at most.
BITS = 24
#: Stored blocks that one scan of the documents looks for.
SCAN_BLOCKS = 4
#: Words in one stretch of the lock-step scan.
STRETCH = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    data, offsets = X.buffer(pa.array(texts, pa.large_string()))
    data = X.LOWER[data]
    starts, ends, first = X.words(data, offsets, X.NON_WORD)
    return X.word_array(data, starts, ends).to_pylist(), first


class Group:
    """Shift table, suffix buckets and patterns of one pattern length ``m``.

    Patterns are places in the items' word numbers (``tokens``, kept once by the matcher): a place, two hashes' worth of
    order and the owners make some 30 bytes a window. A shift is a byte, and the table has at most 2 ** ``BITS`` of
    them: where blocks share an entry the smallest shift stands, which costs a look and no occurrence.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, owner: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        whole = np.zeros(len(starts), np.uint64)
        for i in range(m):
            whole = (whole ^ (tokens[starts + i].astype(np.uint64) + np.uint64(1))) * _MIX
            whole ^= whole >> np.uint64(29)
        order = np.argsort(whole, kind="stable")
        starts, owner, whole = starts[order], owner[order], whole[order]
        # Equal windows become one pattern; the hash only brings them together.
        same = whole[1:] == whole[:-1]
        for i in range(m):
            same &= tokens[starts[1:] + i] == tokens[starts[:-1] + i]
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        self.items = owner.astype(np.int32)  # items of pattern p: items[at[p]:at[p + 1]]
        self.at = np.append(begin, len(starts)).astype(np.int32)
        uniq = starts[begin]
        blocks = len(np.unique(self._mixed([tokens[uniq + self.block - 1 - i] for i in range(self.block)]))) if m > self.block else len(uniq)
        bits = min(BITS, max(12, math.ceil(math.log2(8 * blocks + 8 * self.m + 1))))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(255, self.m - self.block + 1), np.uint8)
        for j in range(self.block - 1, m):  # the later block moves less, and overwrites
            self.shift[self._hash([tokens[uniq + j - i] for i in range(self.block)])] = min(255, m - 1 - j)
        suffix = self._suffix(tokens, uniq + m - 1)
        order = np.argsort(suffix, kind="stable")
        self.starts, self.suffix = uniq[order].astype(np.int32), suffix[order]
        self.rank = order.astype(np.int32)  # bucket position -> pattern

    def _mixed(self, words: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(words[0]), np.uint64)
        for w in words:
            h = (h + w.astype(np.uint64) + np.uint64(1)) * _MIX
        return h

    def _hash(self, words: list[np.ndarray]) -> np.ndarray:
        return (self._mixed(words) >> self.drop).astype(np.int64)

    def _suffix(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = np.zeros(len(last), np.uint64)
        for i in range(min(4, self.m)):
            h = (h ^ (ids[last - i].astype(np.uint64) + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def find(self, tokens: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence inside a document."""
        ends = np.maximum(np.diff(first) - self.m + 1, 0)  # places where a window may end, per document
        lanes = -(-ends // STRETCH)
        doc = np.repeat(np.arange(len(ends)), lanes)
        pos = X.ragged(np.zeros(len(ends), np.int64), lanes) * STRETCH + first[:-1][doc] + self.m - 1
        stop = np.minimum(pos + STRETCH, first[1:][doc])
        found = []
        while len(pos):
            move = self.shift[self._hash([ids[pos - i] for i in range(self.block)])]
            if not move.all():
                found.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        h = self._suffix(ids, at)
        lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends_out, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(at), 65536):
            k = X.ragged(lo[a:a + 65536], n[a:a + 65536])
            e = np.repeat(at[a:a + 65536], n[a:a + 65536])
            ok = np.ones(len(e), bool)
            for i in range(self.m):
                ok[ok] = ids[e[ok] - i] == tokens[self.starts[k[ok]] + self.m - 1 - i]
            ends_out.append(e[ok])
            which.append(self.rank[k[ok]])
        return np.concatenate(ends_out), np.concatenate(which)


class Matcher:
    """All windows of some benchmark items."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        words, first = _tokens([t for _, t in items])
        self.names = [i for i, _ in items]
        self.vocabulary = pa.array(sorted(set(words)), pa.large_binary())
        ids = pc.index_in(pa.array(words, pa.large_binary()), value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32) + 1 if words else np.zeros(0, np.int32)
        self.tokens, self.groups = ids, []
        size = np.diff(first)
        length = np.minimum(size, window)
        for m in np.unique(length[length > 0]).tolist():
            item = np.flatnonzero(length == m)
            n = size[item] - m + 1
            self.groups.append(Group(ids, X.ragged(first[:-1][item], n), np.repeat(item, n), m))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
        """Per document: number of words, hit runs (start, end), item indices."""
        data = X.LOWER[data]
        starts, ends, first = X.words(data, offsets, X.NON_WORD)
        n = len(first) - 1
        runs, items = [[] for _ in range(n)], [[] for _ in range(n)]
        if self.groups and len(starts):
            ids = pc.fill_null(pc.index_in(X.word_array(data, starts, ends), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
            step, pair = np.zeros(len(starts) + 1, np.int32), []
            for g in self.groups:
                last, p = g.find(self.tokens, ids, first)
                if len(last):
                    np.add.at(step, last - g.m + 1, 1)
                    np.add.at(step, last + 1, -1)
                    k = g.at[p + 1] - g.at[p]
                    d = np.searchsorted(first, np.repeat(last, k), "right") - 1
                    pair.append(np.unique(np.stack([d, g.items[X.ragged(g.at[p], k)]]), axis=1))
            if pair:
                for d, i in np.unique(np.concatenate(pair, axis=1), axis=1).T.tolist():
                    items[d].append(i)
                hit = np.cumsum(step)[:-1] > 0
                edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for s, e in zip(a.tolist(), b.tolist(), strict=True):  # a run may go on in the next document
                    while s < e:
                        d = int(np.searchsorted(first, s, "right")) - 1
                        to = min(e, int(first[d + 1]))
                        runs[d].append((s - int(first[d]), to - int(first[d])))
                        s = to
        return np.diff(first), runs, items


def _blocks(benchmark: DataFrame) -> list[list[tuple] | str]:
    """The items (id as a string, text) as one list, or, beyond BLOCK_BYTES of text, the folders of the blocks that hold them."""
    items = benchmark.where("octet_length(text) > 0").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 2 * math.ceil(total / BLOCK_BYTES)
    if n <= 2:
        return [[tuple(r) for r in items.collect()]]
    path = shared_path(items.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
    items.distinct().select("*", block).repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={r[0]}" for r in items.sparkSession.read.parquet(path).select("block").distinct().sort("block").collect()]


_loaded: dict[tuple, Matcher] = {}


def _stored(paths: list[str], window: int) -> list[Matcher]:
    """The matchers of stored blocks; a task's Python process holds those of the last scan only."""
    for old in [k for k in _loaded if k[0] not in paths or k[1] != window]:
        del _loaded[old]
    for path in paths:
        if (path, window) not in _loaded:
            where, at = filesystem(path)
            rows = pq.read_table(at, filesystem=where, columns=["item_id", "text"], partitioning=None)
            _loaded[path, window] = Matcher(list(zip(*(rows[c].to_pylist() for c in ("item_id", "text")), strict=True)), window)
    return [_loaded[path, window] for path in paths]


_HITS = "array<struct<start:bigint,end:bigint>>"


def _scan(docs: DataFrame, items: list[tuple] | None, paths: list[str], window: int, carry: list[str] | None) -> DataFrame:
    """Hits of ``items``, which travel to the tasks, or of the blocks stored at ``paths``."""
    shared = None if items is None else docs.sparkSession.sparkContext.broadcast(Matcher(items, window))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(data, offsets):
        n, runs, found = None, None, None
        for m in _stored(paths, window) if shared is None else [shared.value]:
            n, more, which = m.scan(data, offsets)
            names = [{m.names[i] for i in f if m.names[i] is not None} for f in which]
            runs = more if runs is None else [a + b for a, b in zip(runs, more, strict=True)]
            found = names if found is None else [a | b for a, b in zip(found, names, strict=True)]
        return [n, pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], span), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]

    return X.map_docs(docs, [("n_words", "bigint"), ("hits", _HITS), ("items", "array<string>")], run, carry)


def n_hit() -> Column:
    """Number of words in the runs of ``hits``, which may overlap."""
    return F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1))))).cast("bigint")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    Words are lower-cased (A-Z). One row per input row: the ``carry`` columns
    (doc_id), n_words, hits (runs of hit words, numbered from 0), items (ids of
    the items found, as strings, sorted as strings), n_hit and contaminated (n_hit > 0 and
    20 * n_hit >= n_words). An item shorter than a window is one window; items
    without words, and null texts, match nothing. Items with a null id hit
    words but are not listed; rows that repeat an item count once.
    """
    blocks = _blocks(benchmark)
    stored = isinstance(blocks[0], str)
    scans = [blocks[i:i + SCAN_BLOCKS] for i in range(0, len(blocks), SCAN_BLOCKS)]
    if not stored:
        out = _scan(docs, blocks[0], [], window, carry)
    elif len(scans) == 1:
        out = _scan(docs, None, scans[0], window, carry)
    else:
        key = F.md5(F.coalesce("text", F.lit("")))
        keyed = docs.withColumn("text_key__", key)
        parts = [_scan(keyed, None, some, window, ["doc_id", "text_key__"]).where(F.size("hits") > 0) for some in scans]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.union(p)
        hits = (hits.distinct().groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id__"), "text_key__")
                .agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")))
        base = _scan(keyed, [], [], window, [*(carry or ["doc_id"]), *(["doc_id"] if carry and "doc_id" not in carry else []), "text_key__"]).drop("hits", "items")
        base = base.withColumn("id__", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
        out = (base.join(hits, ["id__", "text_key__"], "left").drop("id__", "text_key__")
               .withColumn("hits", F.coalesce("hits", F.array().cast(_HITS))).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
    return (out.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", n_hit())
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
