"""Vectorised text kernels over Arrow string buffers.

Texts are handled as one byte buffer with document offsets. A word or line is hashed from prefix sums of
table[byte] * P**position (modulo 2**64, P odd, so a power can be divided out), which costs a few numpy
passes over the bytes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import operator_cache

U64 = np.uint64
SLICE_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_ODD) + U64(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Word bytes after lower-casing A-Z: digits, a-z, everything outside ASCII (A-Z count as their lower case).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True
RAW_TABLE = _table(1)
LOWER_TABLE = RAW_TABLE[LOWER]

_powers: dict[str, np.ndarray] = operator_cache({})


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _ODD), ("q", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, n)
        lo, hi = int(offsets[start]), int(offsets[end])
        yield start, end, data[lo:hi], offsets[start : end + 1] - lo
        start = end


def spans(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross document offsets."""
    n = len(kept)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = kept[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = kept[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; the empty span has the hash of length 0."""
    n = len(data)
    p, q = _power_tables(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(table[data] * p[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, table: np.ndarray = LOWER_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word; offsets of documents in the words)."""
    starts, ends = spans(kind[data], offsets)
    return span_hashes(data, starts, ends, table), starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    factor = 1
    for j in range(k):
        factor = factor * _ODD % (1 << 64)
        out += h[j : j + n] * U64(factor)
    return mix(out + U64(k))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end without its newline; offsets of documents in the lines). An empty document has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    # a line that starts at a document's start sorts before none other: a newline ends inside its own document
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    firsts = np.searchsorted(owner, np.arange(len(offsets)))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[firsts[1:] - 1] = offsets[1:]
    return starts, ends, firsts


def strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without ASCII white space at both ends; a blank span becomes empty at its start."""
    solid = np.flatnonzero(NOT_SPACE[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    full = b > a
    padded = np.append(solid, 0)
    return np.where(full, padded[np.minimum(a, len(solid))], starts), np.where(full, padded[np.maximum(b - 1, 0)] + 1, starts)


def text_hashes(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, as words() gives them."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in slices(pa.array(texts, pa.large_string())):
        h, _, _, at = words(data, offsets)
        out += [h[at[i] : at[i + 1]] for i in range(b - a)]
    return out


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], also for empty runs."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]
