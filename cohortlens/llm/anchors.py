"""Repeated windows of a corpus, found in shards that content itself chooses.

Every window of W tokens has an anchor: of its k-grams the one with the least
hash, the leftmost on ties. Equal windows have equal anchors, so windows that
could be equal meet in one shard, however the documents are dealt. Consecutive
windows with the same anchor place form one piece, sent as a whole.

* Anchors that occur once end there, as most do; that needs no text.
* Equal pieces become one class before any text moves: only its first
  occurrence is carried on, the others follow from the class.
* Anchors with several different pieces go to the shards, where an index of
  the pieces (FM-index or suffix array, given by the caller) compares them.
* An anchor with more than ``HOT`` different pieces (a passage in very many
  contexts) is not put into one shard. Its pieces are cut up by longer k-grams,
  level by level, up to whole windows: those in unlike contexts part, those
  alike become one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import text as X
from cohortlens.llm.scratch import keep

#: Different pieces that one anchor may send to a shard.
HOT = 100
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_N = 10  # bits of a piece's number of windows
#: Tokens whose pieces are made at once (some 130 bytes a token), and tokens of pieces written at once (some 20 bytes a token;
#: pieces overlap, so that a text's are several times the text).
_MADE, _SENT = 1 << 18, 1 << 19
LEAST = -(1 << 63)  # stands for a null doc_id

Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def pieces(tokens: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(start, number of windows, anchor, piece hash) of all pieces; starts count from the first token."""
    n, w = len(tokens), window - k + 1
    counts = np.maximum(np.diff(first) - window + 1, 0)
    win = X.ragged(first[:-1], counts)
    if not len(win):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    size = 1 << (n + 1).bit_length()
    up, down = _powers(_BASE, size), _powers(_INVERSE, size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(tokens.astype(np.uint64) + np.uint64(_BASE)) * up[:n], out=sums[1:])
    grams = _mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
    # Least k-gram of each window from running minima inside blocks of w, both ways.
    blocks = -(-len(grams) // w) + 1
    key = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:len(grams)] = grams
    key = ((key >> np.uint64(_N)) << np.uint64(_N)).reshape(blocks, w) | np.arange(w, dtype=np.uint64)
    left = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()[win]
    right = np.minimum.accumulate(key, axis=1).ravel()[win + w - 1]
    use_left = (left >> np.uint64(_N)) <= (right >> np.uint64(_N))
    at = np.where(use_left, win // w * w + (left & np.uint64((1 << _N) - 1)).astype(np.int64),
                  (win + w - 1) // w * w + (right & np.uint64((1 << _N) - 1)).astype(np.int64))
    new = np.ones(len(win), bool)
    new[1:] = (at[1:] != at[:-1]) | (win[1:] != win[:-1] + 1)
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    run = np.flatnonzero(new)
    start, length = win[run], np.diff(np.concatenate([run, [len(win)]]))
    piece = _mix((sums[start + length - 1 + window] - sums[start]) * down[start] + length.astype(np.uint64))
    return start, length, grams[at[run]], piece


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with d and h, which name and order documents: the doc_id (a null comes first) and, only
    where ids repeat, a hash of the text. Rows alike in both are equals: neither is the earlier."""
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST))
    again = bool(docs.groupBy(d.alias("d")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    return docs.withColumn("d", d).withColumn("h", F.xxhash64("text") if again else F.lit(0).cast("bigint"))


_PLACE = ["d", "h", "at"]
_OCC = "d bigint, h bigint, at bigint, anchor bigint, piece bigint"


def _columns(d, h, start, n, anchor, piece) -> list[pa.Array]:
    return [pa.array(d), pa.array(h), pa.array((start << _N) | n), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64))]


def _occurrences(docs: DataFrame, tokens: Tokens, window: int, k: int, dtype: np.dtype) -> DataFrame:
    limit, names = _MADE * dtype.itemsize, [*_PLACE, "anchor", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, limit):
                t, first = tokens(*X.buffer(part.column("text")))
                start, n, anchor, piece = pieces(t, first, window, k)
                doc = np.searchsorted(first, start, "right") - 1
                d, h = part.column("d").to_numpy()[doc], part.column("h").to_numpy()[doc]
                yield pa.RecordBatch.from_arrays(_columns(d, h, start - first[doc], n, anchor, piece), names)

    return docs.select("d", "h", "text").mapInArrow(run, _OCC)


def _binary(t: np.ndarray, a: np.ndarray, lens: np.ndarray) -> pa.Array:
    off = np.zeros(len(a) + 1, np.int64)
    np.cumsum(lens * t.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(t[X.ragged(a, lens)].tobytes())]).cast(pa.binary())


def _portions(lens: np.ndarray) -> Iterator[slice]:
    """Runs of pieces with some ``_SENT`` tokens (one piece at least)."""
    group = (np.cumsum(lens) - lens) // _SENT
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lens)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _extract(docs: DataFrame, wanted: DataFrame, tokens: Tokens, window: int) -> DataFrame:
    """``wanted`` (d, h, at, anchor, c) with the tokens of each piece."""
    lists = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("at", "anchor", "c")).alias("wanted"))
    rows = docs.select("d", "h", "text").join(lists, ["d", "h"]).select("d", "h", "wanted", "text")
    names = [*_PLACE, "anchor", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch):
                t, first = tokens(*X.buffer(part.column("text")))
                lists = part.column("wanted")
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                at = flat.field("at").to_numpy()
                a, lens = (at >> _N) + first[doc], (at & ((1 << _N) - 1)) + window - 1
                rows = pa.RecordBatch.from_arrays([pa.array(part.column("d").to_numpy()[doc]), pa.array(part.column("h").to_numpy()[doc]), *[flat.field(c) for c in ("at", "anchor", "c")]], names)
                for some in _portions(lens):
                    yield pa.RecordBatch.from_arrays([*rows.slice(some.start, some.stop - some.start).columns, _binary(t, a[some], lens[some])], [*names, "tokens"])

    return rows.mapInArrow(run, "d bigint, h bigint, at bigint, anchor bigint, c bigint, tokens binary")


def _cut(hot: DataFrame, dtype: np.dtype, window: int, k: int) -> DataFrame:
    """The pieces of ``hot`` cut up by k-grams of a greater length."""
    names = [*_PLACE, "anchor", "piece", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, _MADE * dtype.itemsize, "tokens"):
                data, off = X.buffer(part.column("tokens"))
                t, first = np.frombuffer(data.tobytes(), dtype), off // dtype.itemsize
                start, n, anchor, piece = pieces(t, first, window, k)
                doc = np.searchsorted(first, start, "right") - 1
                base = part.column("at").to_numpy()[doc] >> _N
                d, h = part.column("d").to_numpy()[doc], part.column("h").to_numpy()[doc]
                columns, lens = _columns(d, h, base + start - first[doc], n, anchor, piece), n + window - 1
                for some in _portions(lens):
                    yield pa.RecordBatch.from_arrays([*[c[some] for c in columns], _binary(t, start[some], lens[some])], names)

    return hot.select(*_PLACE, "tokens").mapInArrow(run, _OCC + ", tokens binary")


def _indexed(cold: DataFrame, dtype: np.dtype, window: int, size: int, repeated) -> DataFrame:
    """Windows of ``cold`` pieces that ``repeated(tokens, first, d, h, start)`` marks, as (d, h, at).

    Tasks hold whole anchors in order and index them ``size`` tokens at a time.
    """
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, off = X.buffer(table.column("tokens"))
        t, first = np.frombuffer(data.tobytes(), dtype), off // dtype.itemsize
        d, h, start = (table.column("d").to_numpy(), table.column("h").to_numpy(), table.column("at").to_numpy() >> _N)
        mark = repeated(t, first, d, h, start)  # by token, at the start of a window
        edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(first, a, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(d[doc]), pa.array(h[doc]), pa.array(((start[doc] + a - first[doc]) << _N) | (b - a))], _PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room, last = size, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            lens = np.diff(X.buffer(batch.column("tokens"))[1]) // dtype.itemsize
            done = np.cumsum(lens)
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            new[0] = anchor[0] != last if len(anchor) else True
            from_row, spent = 0, 0
            for r in np.flatnonzero(new).tolist():
                if (done[r - 1] if r else 0) - spent >= room:
                    if r > from_row:
                        held.append(batch.slice(from_row, r - from_row))
                    if held:
                        yield shard(held)
                    held, room, spent, from_row = [], size, (done[r - 1] if r else 0), r
            if len(anchor):
                held.append(batch.slice(from_row))
                room, last = room - int(done[-1] - spent), anchor[-1]
        if held:
            yield shard(held)

    rows = cold.select(*_PLACE, "anchor", "tokens").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "d bigint, h bigint, at bigint")


def repeated_windows(docs: DataFrame, tokens: Tokens, dtype, window: int, levels: list[int], repeated, size: int, every: bool, held: bool = False) -> DataFrame:
    """(d, h, at): runs of windows that occur elsewhere (``every``) or also earlier (not ``every``).

    The first pieces are needed twice: written once (``held``), or made again from the texts, which takes less disk.

    ``docs`` has d, h and text; ``levels`` are growing k-gram lengths, the last
    the window itself; ``at`` holds the first window's place and the number of windows.
    """
    dtype = np.dtype(dtype)
    occ, out = _occurrences(docs, tokens, window, levels[0], dtype), None
    # Tables that a hot anchor's rows are joined from are kept in the tasks' own partitions: packed into few files, they would
    # leave adaptive execution few map outputs to split them by.
    occ = keep(occ) if held else occ
    for level, k in enumerate(levels):
        inner = level > 0
        # Kept, as adaptive execution splits a hot anchor only where both sides of the join are plain shuffles.
        shared = keep(occ.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
        occ = keep(occ.join(shared, "anchor"))
        place = F.struct(*_PLACE, *(["tokens"] if inner else []))
        classes = keep(occ.groupBy("anchor", "piece").agg(F.min(place).alias("f"), F.count("*").alias("n")))
        several = keep(classes.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"))
        first = classes.join(several, "anchor").select("f.*", "anchor", "c")
        copies = occ.select(*_PLACE, "anchor", "piece").join(classes.where("n > 1").select("anchor", "piece", *[F.col(f"f.{c}").alias(f"f_{c}") for c in _PLACE]), ["anchor", "piece"])
        if not every:
            copies = copies.where("d <> f_d or h <> f_h or at <> f_at")
        table = keep(first if inner else _extract(docs, first, tokens, window))
        found = copies.select(*_PLACE).union(_indexed(table.where(F.col("c") <= HOT), dtype, window, size, repeated))
        out = found if out is None else out.union(found)
        hot = table.where(F.col("c") > HOT)
        if level + 1 == len(levels) or not hot.limit(1).count():
            return out
        occ = keep(_cut(hot, dtype, window, levels[level + 1]))


def with_runs(docs: DataFrame, runs: DataFrame, fields: list[tuple[str, str]], fn, window: int, tokens_of, carry: list[str], limit: int = X.SLICE_BYTES) -> DataFrame:
    """Columns from each document and its repeated windows.

    ``fn(data, offsets, first, cover, aux)`` gets the slice's bytes and, for the tokens numbered
    by ``tokens_of(data, offsets) -> (first, aux)``, whether a repeated window covers each. A slice has some ``limit`` bytes.
    """
    names = [n for n, _ in fields]
    carry = [c for c in carry if c not in names]
    kinds = dict(docs.dtypes)
    lists = runs.groupBy("d", "h").agg(F.collect_list("at").alias("runs__"))
    rows = docs.select("d", "h", *[docs[f"`{c}`"].alias(f"c{i}__") for i, c in enumerate(carry)], docs["text"].alias("text__")).join(lists, ["d", "h"], "left")
    rows = rows.select(*[f"c{i}__" for i in range(len(carry))], "runs__", "text__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, limit, "text__"):
                data, offsets = X.buffer(part.column("text__"))
                first, aux = tokens_of(data, offsets)
                lists = part.column("runs__")
                lens = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                doc, at = np.repeat(np.arange(part.num_rows), lens), lists.flatten().to_numpy()
                a = (at >> _N) + first[doc]
                step = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, a + (at & ((1 << _N) - 1)) + window - 1, -1)
                got = fn(data, offsets, first, np.cumsum(step)[:-1] > 0, aux)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(carry))] + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in got], carry + names)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"`{n}` {t}" for n, t in fields])
    return rows.mapInArrow(run, schema)
