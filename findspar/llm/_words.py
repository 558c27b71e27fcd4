"""Vectorised text kernels that the operators of this subpackage share.

Texts arrive as Arrow string columns.  All kernels work on the UTF-8 bytes of a
run of rows at once (numpy, no Python loop over words), and `slices` bounds how
many bytes are held in temporaries, whatever the size of the Arrow batch.
A null text has the same words as an empty one: none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer row is handled alone.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: [^\x20\x09-\x0D]
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h ^= h >> np.uint64(33)
    h *= _MIX2
    h ^= h >> np.uint64(33)
    return h


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers.update(p=np.multiply.accumulate(up), q=np.multiply.accumulate(down))
    return _powers["p"], _powers["q"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `limit` bytes, or one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry at the end).

    `kind` says which (lower-cased) bytes belong to words.  Words never reach over a row's end.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def words(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, index of each row's first word) by runs of rows; A-Z counts as a-z."""
    for at, end, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, kind)
        yield at, end, hashes(data, starts, ends), first


def shingles(hashed: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, in order, and the index of each row's first run.

    A row of fewer than n words, but not none, has its whole sequence as its only run.
    """
    m = len(hashed)
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    if not m:
        return np.zeros(0, np.uint64), begin
    rolled = np.zeros(m, np.uint64)
    for i in range(n):
        rolled[: m - i] += hashed[i:] * _power_table(n + 1)[0][i + 1] if m > i else 0
    at = np.repeat(first[:-1] - begin[:-1], sizes) + np.arange(begin[-1])
    out = mix64(rolled[at])
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        own = hashed[first[row] : first[row + 1]]
        out[begin[row]] = mix64(np.array([(own * _power_table(n + 1)[0][1 : len(own) + 1]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, begin


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` over rows whose items start at `first` (empty rows: 0)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
