"""Array helpers shared by the corpus operators.

Texts arrive as Arrow string columns; inside a task they are handled as one
byte buffer with document offsets, so that splitting, hashing and gathering
are NumPy passes and not per-word Python. Batches are cut into slices of a
few megabytes, which bounds a worker's memory however long the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def _table(seps: list[range]) -> np.ndarray:
    t = np.zeros(256, bool)
    for r in seps:
        t[list(r)] = True
    return t


#: Separators of words [^\x20\x09-\x0D]+.
SPACE = _table([range(0x20, 0x21), range(0x09, 0x0E)])
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (on lower-cased bytes).
NON_WORD = _table([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size, dtype=np.int64) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, big = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if big else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def ints(column: pa.Array) -> list:
    return column.to_pylist()


def words(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray):
    """Words of every document.

    Returns (starts, ends, first): byte positions of each word and, for each
    document, the index of its first word (one more entry than documents).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = ~is_sep[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = w[cut]
    end = w.copy()
    end[:-1] &= ~w[1:]
    end[cut - 1] = w[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1 for all i, concatenated."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return out + np.arange(total)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array."""
    lens = ends - starts
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(data[ragged(starts, lens)])])


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words joined by one space each: (bytes, start of each word, end of each word)."""
    lens = ends - starts
    out = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    s = np.cumsum(lens + 1) - (lens + 1)
    out[ragged(s, lens)] = data[ragged(starts, lens)]
    return out, s, s + lens


def map_docs(docs, fields: list[tuple[str, str]], fn, carry: list[str] | None = None, limit: int = SLICE_BYTES):
    """Add columns computed from whole texts, slice by slice, without a shuffle.

    ``fn(data, offsets)`` gets the UTF-8 bytes and offsets of some documents and
    returns one Arrow array (or NumPy array) per field. The result has the
    ``carry`` columns (doc_id alone by default) that no field name clashes
    with, then the fields.
    """
    names = [n for n, _ in fields]
    carry = [c for c in (carry or ["doc_id"]) if c not in names]
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit, "text__"):
                got = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(*buffer(part.column(part.num_columns - 1)))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(carry))] + got, carry + names)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"`{n}` {t}" for n, t in fields])
    return docs.select(*[docs[f"`{c}`"] for c in carry], docs["text"].alias("text__")).mapInArrow(run, schema)
