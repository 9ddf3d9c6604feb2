"""Periodic runs of words, found by multi-scale minimizers.

A run is a maximal stretch of words of one document with smallest period q that
is at least max(6, 4 q) words long. Periods up to ``SHORT`` are found by
comparing every word with the one q places on. Longer ones go by scale: for
the periods of (w/2, w] every place gets a hash of the w words from it, and of
each window of w/2 places the smallest hash stays, its minimizer. Two windows
one period apart inside a run hold equal words, hence equal minimizers; as w
words cover a whole period, none between them equals both. So neighbours among
equal minimizers, at a distance of (w/2, w], seed every run; seeds of one
distance in a row are one candidate, which is extended word by word, on word
ids and not on hashes, as far as the period holds. Hashes thus only choose
where to look.

Each scale costs a fixed number of passes over the documents long enough for
it, so a document of n words costs O(n log n), and work and memory of a task
are in proportion to the slice of documents it holds (one document at least).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm import text as X

#: Longest period found by comparing at every distance.
SHORT = 8
#: Most words compared at once for one candidate.
CHUNK = 1 << 14
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(pick, x: np.ndarray, size: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` values in a row, size a power of two."""
    step = 1
    while step < size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def _minimizers(h: np.ndarray, size: int) -> np.ndarray:
    """Places that hold the smallest hash of some window of ``size`` places."""
    if len(h) < size:
        return np.zeros(0, np.int64)
    edge = np.zeros(size - 1, np.uint64)
    least = np.concatenate([edge, _windows(np.minimum, h, size), edge])
    return np.flatnonzero(h == _windows(np.maximum, least, size))


def _reach(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, way: int) -> np.ndarray:
    """How many places in a row from ``at``, in direction ``way``, equal the word ``lag`` places on."""
    count = np.zeros(len(at), np.int64)
    live, chunk = np.arange(len(at)), 16
    while len(live):
        some = max(1, (1 << 20) // chunk)
        still = []
        for k in range(0, len(live), some):
            who = live[k:k + some]
            place = at[who, None] + way * (count[who, None] + np.arange(chunk))
            other = place + lag[who, None]
            inside = (place >= 0) & (other < len(ids))
            same = inside & (ids[np.where(inside, place, 0)] == ids[np.where(inside, other, 0)])
            whole = same.all(axis=1)
            count[who] += np.where(whole, chunk, same.argmin(axis=1))
            still.append(who[whole])
        live, chunk = np.concatenate(still), min(2 * chunk, CHUNK)
    return count


def _short(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found = []
    for q in range(1, SHORT + 1):
        same = np.flatnonzero(ids[:-q] == ids[q:])
        if not len(same):
            continue
        cut = np.flatnonzero(np.diff(same) != 1)
        first, last = np.append(0, cut + 1), np.append(cut, len(same) - 1)
        start, length = same[first], same[last] - same[first] + 1 + q
        long = length >= max(6, 4 * q)
        found.append((start[long], length[long], np.full(int(long.sum()), q)))
    return found


def _scale(ids: np.ndarray, h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with a period of (w/2, w] that the minimizers of hashes ``h`` of w words seed."""
    at = _minimizers(h, w // 2)
    order = at[np.argsort(h[at], kind="stable")]
    lag = np.diff(order)
    pair = np.flatnonzero((lag > w // 2) & (lag <= w) & (h[order[:-1]] == h[order[1:]]))
    at, lag = order[pair], lag[pair]
    sort = np.lexsort((at, lag))
    at, lag = at[sort], lag[sort]
    if not len(at):
        return at, at, lag
    # Seeds of one distance no more than w places apart hold one stretch; a run's covers 3 q - w at least.
    cut = np.flatnonzero((np.diff(lag) != 0) | (np.diff(at) > w)) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    likely = at[last] + w - at[first] >= 3 * lag[first] - w
    at, lag = at[first[likely]], lag[first[likely]]
    back = _reach(ids, at - 1, lag, -1)
    length = back + _reach(ids, at, lag, 1) + lag
    long = length >= 4 * lag
    return (at - back)[long], length[long], lag[long]


def word_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of some documents: (document, start in it, length, period), by document, start and period.

    ``ids`` are the words as integers of zero or more, ``first`` the index of each document's first word, with
    one more entry for the end.
    """
    n = np.diff(first)
    docs = len(n)
    # One id of its own behind each document; a stretch across it is shorter than its period.
    ids = np.insert(ids.astype(np.int64), first[1:], -1 - np.arange(docs))
    begin = first[:-1] + np.arange(docs)
    found = [tuple(a) for a in _short(ids)]
    place = np.arange(len(ids))
    size, h, w = n, _mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), 1
    with np.errstate(over="ignore"):
        while len(size) and size.max() >= 4 * (max(SHORT, w) + 1):
            tail = _mix(np.arange(len(h) - w, len(h), dtype=np.uint64) + np.uint64(w << 40))
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + np.append(h[w:], tail[-w:] if w <= len(h) else tail)[:len(h)])
            w *= 2
            if w <= SHORT:
                continue
            enough = size >= 2 * w + 4
            if not enough.all():
                stay = np.repeat(enough, size + 1)
                ids, h, place, size = ids[stay], h[stay], place[stay], size[enough]
            if len(size):
                start, length, period = _scale(ids, h, w)
                found.append((place[start], length, period))
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    # A multiple of the smallest period finds the same stretch.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[new], length[new], period[new]
    doc = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((period, start))
    return doc[order], (start - begin[doc])[order], length[order], period[order]


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray) -> pa.Array:
    """Each document's ``n`` words joined by one space."""
    out, s, e = X.spaced(data, starts, ends)
    upto = np.concatenate([[0], np.cumsum(n)])
    some = n > 0
    real = np.ones(len(out), bool)
    real[e[upto[1:][some] - 1]] = False
    size = np.zeros(len(n), np.int64)
    size[some] = e[upto[1:][some] - 1] - s[upto[:-1][some]]
    at = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(at), pa.py_buffer(out[real])]).cast(pa.string())


def periodic_runs(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Runs of every document and its text without their repetitions.

    One row per input row: the ``carry`` columns (doc_id alone by default;
    without names that clash), n_words, runs (array of start, length, period, by
    start, then period; words count from 0) and kept_text, the words, joined by
    one space, that no run holds behind its first period. Words are
    ``[^\\x20\\x09-\\x0D]+`` as they stand; a null, empty or blank text has no
    word, no run and an empty kept_text. Runs may overlap and start at one
    word; the smallest period of a stretch is reported, never its multiples.
    Rows that repeat an id, or have none, are documents of their own, and an
    empty table gives none.
    """
    def run(data, offsets):
        starts, ends, first = X.words(data, offsets, X.SPACE)
        ids = X.word_array(data, starts, ends).dictionary_encode().indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
        doc, start, length, period = word_runs(ids, first)
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, first[doc] + start + period, 1)
        np.add.at(edge, first[doc] + start + length, -1)
        keep = np.cumsum(edge[:-1]) == 0
        upto = np.concatenate([[0], np.cumsum(keep)])
        runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(first))), pa.int32()), runs)
        return [np.diff(first), lists, _texts(data, starts[keep], ends[keep], np.diff(upto[first]))]

    return X.map_docs(docs, [("n_words", "bigint"), ("runs", _RUNS), ("kept_text", "string")], run, carry)
