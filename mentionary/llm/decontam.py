"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m characters that occurs with at most k edits shares at least
m - q + 1 - k*q of its q-grams with its occurrence, all on diagonals (text position
less item position) that differ by k at most. Shared q-grams are counted in diagonal
bands that overlap by k; bands that reach the item's bound are verified by banded
alignment, which decides. Items and texts are compared in lower case, with every run
of white space and ASCII punctuation as one space.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import CHUNK, Lookup, lower, pieces, ragged, row_of
from .scratch import text_pass, written

#: Characters of a q-gram. At RATE, items of MIN_CHARS or more share one with any occurrence within their budget.
Q = 7
#: Edits allowed a character of an item; items shorter than MIN_CHARS after folding aren't searched (0 of the 200 here), as they occur by chance.
RATE, MIN_CHARS = 0.1, 24
#: Bytes of benchmark text that one pass broadcasts; a larger benchmark takes more passes.
PASS_BYTES = 16_000_000
SCHEMA = "doc_id long, item_id long, start int, end int, edits int"
_ONE = np.int64(1) << 32

_FOLD = np.full(256, 32, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c
_FOLD[0x80:] = np.arange(0x80, 0x100)


def fold(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, folded bytes, folded offsets, their places in the lower-cased bytes, those bytes); each row ends in a line feed."""
    lines = lambda c: pc.binary_join_element_wise(lower(c), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    for lo, hi, raw, off in pieces(column, limit, lines):
        buf = _FOLD[raw]
        buf[off[1:] - 1] = 10
        keep = np.empty(len(buf), bool)
        keep[0] = buf[0] != 32
        keep[1:] = (buf[1:] != 32) | (buf[:-1] > 32)
        at = np.flatnonzero(keep)
        yield lo, hi, buf[at], np.searchsorted(at, off), at, raw


def fold_text(text: str) -> bytes:
    """One folded text, without a space at its end."""
    return next(fold(pa.array([text])))[2][:-1].tobytes().rstrip(b" ")


def _grams(buf: np.ndarray) -> np.ndarray:
    """The ``Q`` bytes from each position as one number."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", np.concatenate([buf, np.zeros(8 - Q, np.uint8)]), strides=(1,)) & np.uint64((1 << (8 * Q)) - 1)


@dataclass
class Index:
    """Items of a benchmark (part) with the places of their q-grams."""

    ids: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    shift: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str], rate: float = RATE, min_chars: int = MIN_CHARS) -> Index:
        folded = [(i, fold_text(t)) for i, t in zip(ids, texts) if t is not None and i is not None]
        folded = [(i, t) for i, t in folded if len(t) >= max(Q, min_chars)]
        size = np.array([len(t) for _, t in folded], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])
        text = np.frombuffer(b"".join(t for _, t in folded), np.uint8)
        budget = np.minimum(np.floor(rate * size + 1e-9).astype(np.int64), np.maximum(0, (size - Q) // Q))
        item = np.repeat(np.arange(len(folded)), size - Q + 1)
        place = ragged(np.zeros(len(folded), np.int64), size - Q + 1)
        grams = _grams(text)[starts[item] + place] if len(item) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        gram, first = np.unique(grams[order], return_index=True)
        shift = np.ceil(np.log2(np.maximum(64, 2 * budget))).astype(np.int64)
        return cls(np.array([i for i, _ in folded], np.int64), text, starts[:-1], size, budget, size - Q + 1 - budget * Q, shift, gram, np.append(first, len(order)), item[order], place[order])


class Matcher:
    def __init__(self, index: Index):
        self.x = index
        self.lookup = Lookup(index.gram, np.arange(len(index.gram)))
        self.counts = np.diff(index.first)

    def bands(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands of folded bytes that share enough q-grams."""
        x = self.x
        none = np.zeros(0, np.int64)
        if not len(x.gram) or len(buf) < Q:
            return none, none
        found = self.lookup(_grams(buf))
        pos = np.flatnonzero(found >= 0)
        g = found[pos]
        n = self.counts[g]
        at = ragged(x.first[g], n)
        item = x.item[at]
        diagonal = np.repeat(pos, n) - x.place[at]
        shift = x.shift[item]
        band = diagonal >> shift
        also = (diagonal - (band << shift)) < x.budget[item]
        key = np.concatenate([((item << 40) + (band + (1 << 30))), ((item[also] << 40) + (band[also] - 1 + (1 << 30)))])
        key, n = np.unique(key, return_counts=True)
        item = key >> 40
        good = n >= x.bound[item]
        key, item = key[good], item[good]
        return item, ((key & ((1 << 40) - 1)) - (1 << 30)) << x.shift[item]

    def align(self, buf: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best alignment of each whole item on the diagonals of its band, start and end in ``buf``."""
        edits, start, end = (np.zeros(len(item), np.int64) for _ in range(3))
        for shift in np.unique(self.x.shift[item]).tolist():
            of = np.flatnonzero(self.x.shift[item] == shift)
            of = of[np.argsort(-self.x.size[item[of]], kind="stable")]
            step = max(1, 2_000_000 // ((1 << shift) * 3))
            for lo in range(0, len(of), step):
                part = of[lo : lo + step]
                edits[part], start[part], end[part] = self._align(buf, item[part], diagonal[part], 1 << shift)
        return edits, start, end

    def _align(self, buf: np.ndarray, item: np.ndarray, diagonal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.x
        size, k = x.size[item], int(x.budget[item].max())
        wide = width + 3 * k + 1
        base = diagonal - k
        d = np.arange(wide, dtype=np.int64)
        slope = d * _ONE
        best = np.zeros((len(item), wide), np.int64) + d  # cost in the high half, first diagonal in the low half
        done = np.zeros((len(item), wide), np.int64)
        padded = np.concatenate([np.full(wide + k + 1, 10, np.uint8), buf, np.full(wide + int(size.max()) + 2 * width + 2, 10, np.uint8)])
        at = base + wide + k + 1
        at = np.clip(at, 0, len(padded) - wide - int(size.max()) - 1)
        n = len(item)
        for j in range(int(size.max())):
            n = int(np.searchsorted(-size, -j, side="left"))
            text = padded[at[:n, None] + (d + j)[None, :]]
            new = best[:n] + (text != x.text[x.starts[item[:n]] + j][:, None]) * _ONE
            new[:, :-1] = np.minimum(new[:, :-1], best[:n, 1:] + _ONE)
            new = np.minimum.accumulate(new - slope, axis=1) + slope
            best[:n] = new
            ended = np.flatnonzero(size[:n] == j + 1)
            done[ended] = new[ended]
        where = np.argmin(done, axis=1)
        value = done[np.arange(len(item)), where]
        shiftback = at - (wide + k + 1)
        return value >> 32, shiftback + (value & (_ONE - 1)), shiftback + where + size

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of every item found in a column of texts; places are in characters of the lower-cased text."""
        for lo, _, buf, off, places, raw in fold(column):
            item, diagonal = self.bands(buf)
            if not len(item):
                continue
            edits, start, end = self.align(buf, item, diagonal)
            good = (edits <= self.x.budget[item]) & (start >= 0) & (end <= len(buf)) & (end > start)
            found = np.unique(np.stack([start[good], item[good], end[good], edits[good]], 1), axis=0)
            rows = row_of(found[:, 0], off)
            for r, (s, i, e, c) in zip(rows.tolist(), found.tolist()):
                if e > off[r + 1]:
                    continue
                begin = places[off[r]] if off[r] < len(places) else len(raw)
                row_start = begin if r == 0 else places[off[r] - 1] + 1
                chars = lambda a, b: int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
                first = chars(row_start if r else 0, places[s])
                yield lo + r, i, first, first + chars(places[s], places[e - 1] + 1), c


def _best(found: Iterable[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping alignments of one item in one row, the one with the fewest edits (the first of equals)."""
    kept: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for row, item, start, end, edits in sorted(found, key=lambda f: (f[0], f[1], f[4], f[2], f[3])):
        own = kept.setdefault((row, item), [])
        at = bisect_left(own, (start, end, edits))  # none overlap, so the neighbours tell
        if (at == 0 or own[at - 1][1] <= start) and (at == len(own) or own[at][0] >= end):
            own.insert(at, (start, end, edits))
    return sorted((*key, *f) for key, own in kept.items() for f in own)


_matchers: dict[int, Matcher] = {}


def _matcher(index: Index) -> Matcher:
    key = hash((index.text.tobytes(), index.ids.tobytes(), index.budget.tobytes()))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(index)
    return _matchers[key]


def indexes(benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, pass_bytes: int = PASS_BYTES) -> Iterator[tuple[Index, bool]]:
    """The benchmark's index, in as many parts as ``pass_bytes`` makes needed, one at a time, and whether it is the only one."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // pass_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        rows = items.where(part == p).distinct().orderBy("item_id", "text").toArrow()
        yield Index.build(rows["item_id"].to_pylist(), rows["text"].to_pylist(), rate, min_chars), parts == 1


def _done(rows: DataFrame, shared) -> DataFrame:
    """The rows of a pass, written, so that its part of the index can go before the next one is built."""
    rows = written(rows, "leaks")
    shared.destroy()
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Every benchmark item that occurs in a text with at most ``rate`` edits a character: (doc_id, item_id, start, end, edits).

    One narrow pass over the texts for each ``pass_bytes`` of benchmark, without a shuffle.
    Places are in characters of the lower-cased text; of alignments of one item that
    overlap, the one with the fewest edits is given. Null and empty texts, an empty
    benchmark and items shorter than ``min_chars`` give no rows; a null doc_id is passed
    through, items with a null id or text are left out; repeated rows give repeated
    findings, repeated equal items one; texts are read whole; other columns are not read.
    """

    def search(index: Index, only: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for batch in batches:
                rows = _best(matcher.leaks(batch.column(1)))
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array(matcher.x.ids[[r[1] for r in rows]] if rows else [], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3, 4)], names=["doc_id", "item_id", "start", "end", "edits"])

        rows = text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, SCHEMA)
        return rows if only else _done(rows, shared)

    out = None
    for index, only in indexes(benchmark, rate, min_chars, pass_bytes):
        found = search(index, only)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` without the rows in which a benchmark item occurs, all columns as they were.

    Null and empty texts and rows with a null id stay unless their text holds an item; an
    empty table stays empty, and an empty benchmark drops nothing.
    """
    at = docs.columns.index("text")
    for index, only in indexes(benchmark, rate, min_chars, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for batch in batches:
                stays = np.ones(len(batch), bool)
                stays[[f[0] for f in matcher.leaks(batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(stays))

        docs = text_pass(docs, run, docs.schema)
        if not only:
            docs = _done(docs, shared)
    return docs
