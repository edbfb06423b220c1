"""Whole batches of texts as byte arrays: words, hashes and shingles without a Python loop over words.

Texts come as Arrow string arrays; their bytes lie side by side in one buffer, so one numpy expression works on all
texts of a batch. Batches are cut into pieces of about PIECE bytes, at document borders, to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2_000_000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

#: Bytes 0x20 and 0x09-0x0D part words; A-Z fold to a-z; other bytes stay.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """bytes of all texts, and n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(from row, to row) of pieces of about so many bytes; a longer text is a piece of its own."""
    _, at = string_bytes(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, to
        row = to


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "power" not in _tables or len(_tables["power"]) < n:
        n = max(n + n // 4, 1 << 19)
        for name, base in (("power", _BASE), ("inverse", _INVERSE)):
            table = np.full(n, base, U)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["power"], _tables["inverse"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: differences of one running polynomial, moved to the origin, then mixed."""
    power, inverse = _powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, U)
    np.cumsum((body.astype(U) + U(1)) * power[: len(body)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(body: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of all words, and the n + 1 places where each text's words begin in them."""
    inside = ~apart[body]
    before = np.empty(len(body) + 1, bool)
    before[0] = False
    before[1:] = inside
    cut = at[:-1]
    before[cut] = False  # the byte before a text belongs to another one
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(body) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    after[at[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_array(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The words, folded to lower case, as an Arrow array."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    cover = np.zeros(len(body) + 1, np.int8)
    cover[starts] += 1
    cover[ends] -= 1
    data = FOLD[body[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shingles(body: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words, folded to lower case, and n + 1 places where each text's begin.

    A text of fewer words has its whole sequence as one; one without words has none. Repeats stay.
    """
    body = FOLD[body]
    starts, ends, first = words(body, at)
    hashes = span_hashes(body, starts, ends)
    count = np.diff(first)
    width = np.minimum(count, n)
    number = np.where(count > 0, count - width + 1, 0)
    begin = np.concatenate([[0], np.cumsum(number)])
    # the place of a shingle's first word: its own number, moved by its text's
    lead = np.repeat(first[:-1] - begin[:-1], number) + np.arange(begin[-1])
    out = np.zeros(begin[-1], U)
    wide = np.repeat(width, number)
    for k in range(n):
        there = wide > k
        out[there] = mixed(out[there] * U(0x9DDFEA08EB382D69) + hashes[lead[there] + k] + U(k + 1)) if not there.all() else mixed(out * U(0x9DDFEA08EB382D69) + hashes[lead + k] + U(k + 1))
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    out = [np.unique(values[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else values[:0], np.concatenate([[0], np.cumsum(sizes)])


def list_array(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, kind))
