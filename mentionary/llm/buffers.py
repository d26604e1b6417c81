"""Columnar byte views over Arrow string columns, for vectorised text passes.

Everything here works on one flat ``uint8`` array with row offsets, so a pass
over text costs a few numpy operations a byte instead of Python calls a token.
Null texts are seen as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: arrays of eight bytes a position stay in cache-sized memory.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}

WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    WORD[_c] = True
WORD[0x80:] = True


def view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK, prepare: Callable[[pa.Array], pa.Array] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) of about ``limit`` bytes; a longer row comes alone.

    ``prepare`` is applied to each piece of the column, so that it copies a piece at a time.
    """
    buf, off = view(column)
    rows, lo = len(off) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, rows)
        if prepare:
            own, ends = view(prepare(column.slice(lo, hi - lo)))
            yield lo, hi, own[ends[0] : ends[-1]], ends - ends[0]
        else:
            yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of True that stays inside a row."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = off[(off > 0) & (off < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, row_of(starts, off)


def row_of(positions: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row of each of the ascending positions."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(positions, off)))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, CHUNK + (CHUNK >> 2)), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[kind] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they are."""
    return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(column: pa.Array) -> pa.Array:
    """Lower-cased strings; nulls become empty."""
    column = column.cast(pa.large_string())
    return pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Lookup:
    """A read-only open-addressing table from 64-bit keys to int32 values, probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.key = np.zeros(size, np.uint64)
        self.value = np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.value[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.key[slot[first]] = keys[left[first]]
            self.value[slot[first]] = values[left[first]]
            keep = np.ones(len(left), bool)
            keep[first] = False
            left, slot = left[keep], (slot[keep] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.value[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            now = self.value[slot[todo]]
            out[todo] = now
            todo = todo[(now >= 0) & (self.key[slot[todo]] != keys[todo])]
        return out
