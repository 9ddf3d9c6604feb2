"""Suffix-array dedup over bytes.

Bytes that lie in a 400-byte string which also starts anywhere else are
removed. Strings are brought together by content (see ``anchors``); each
shard of pieces gets a suffix array by induced sorting and the permuted
common prefixes of its neighbours: a string is repeated when either
neighbour shares 400 bytes or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.anchors import identified, repeated_windows, with_runs
from cohortlens.llm.sais import permuted_lcp, suffix_array

WINDOW = 400
#: Bytes in one suffix array.
SHARD = 1 << 20
#: Bytes of text whose removed runs are laid out at once (some 50 bytes a byte).
SLICE = 1 << 20
_LEVELS = [200, 304, 376, 394, 400]


def repeated_strings(tokens: np.ndarray, first: np.ndarray, d=None, h=None, start=None, window: int = WINDOW) -> np.ndarray:
    """Marks the bytes where a string of ``window`` bytes begins that occurs again in the shard."""
    k = np.arange(len(first) - 1)
    t = np.ones(len(tokens) + len(k) + 1, np.int64)  # 1 ends a piece, 0 the text
    at = np.arange(len(tokens)) + np.repeat(k, np.diff(first))
    t[at], t[-1] = tokens.astype(np.int64) + 2, 0
    sa = suffix_array(t, 258)
    lcp = permuted_lcp(t, sa, first + np.arange(len(first)), window, 1)[sa] >= window
    out = np.zeros(len(t), bool)
    out[sa] = lcp | np.concatenate([lcp[1:], [False]])
    return out[at]


def suffix_dedup(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Remove bytes covered by a 400-byte string that also starts anywhere else.

    Texts are UTF-8 bytes (null: empty). One row per input row: the ``carry``
    columns (doc_id), n_bytes, n_removed, n_spans (maximal removed runs),
    kept (binary), kept_sha256, kept_text (kept as text, without the bytes of characters that a
    removed run cuts). All occurrences are removed, the first included;
    rows that repeat a document count as documents of their own.
    """
    docs = identified(docs)
    runs = repeated_windows(docs, lambda data, offsets: (data, offsets), np.uint8, WINDOW, _LEVELS, repeated_strings, SHARD, every=True, held=True)

    def fn(data, offsets, first, cover, _):
        keep = np.flatnonzero(~cover)
        flat, upto = data[keep].tobytes(), np.searchsorted(keep, offsets)
        kept = [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        begins = cover.copy()
        begins[1:] &= ~cover[:-1]
        edge = offsets[:-1][offsets[:-1] < len(cover)]
        begins[edge] = cover[edge]
        total = np.concatenate([[0], np.cumsum(begins)])
        n = np.diff(offsets)
        return [n, n - np.diff(upto), total[offsets[1:]] - total[offsets[:-1]], pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())]

    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept", "binary"), ("kept_sha256", "string"), ("kept_text", "string")]
    return with_runs(docs, runs, fields, fn, WINDOW, lambda data, offsets: (offsets, None), carry or ["doc_id"], SLICE)
