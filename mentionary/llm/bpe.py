"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that can be the last
of its BPE encoding. A suffix automaton over the vocabulary gives, at each position,
the tokens that end there, longest first; a token is the one if the encoding up to
its start ends in a token with which it is compatible, that is, if BPE would not
merge across their border. Back-pointers from the end give the ids. Many pieces are
worked on at once: each step of the dynamic programme is a few array operations over
all pieces that have a byte at that position.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .buffers import Lookup, mix, pieces, ragged, view
from .scratch import text_pass

#: How text is cut before BPE, as published with the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, ids array<int>, n_tokens int, exact boolean"


@dataclass
class Vocabulary:
    """Tokens by id; a token's id is the rank of its merge."""

    tokens: list[bytes]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of base64 tokens and ranks, one a line."""
        with open(path, "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without a gap")
        return cls([ranks[i] for i in range(len(ranks))])

    def tables(self) -> Tables:
        return Tables.build(self.tokens)


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain BPE with the merges of rank under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], below)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass
class Tables:
    """What encoding needs, as arrays: each token's bytes and last merge, the merges by pair, and the trie of tokens."""

    text: bytes
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    depth: np.ndarray
    token: np.ndarray

    @classmethod
    def build(cls, tokens: list[bytes]) -> Tables:
        ranks = {t: i for i, t in enumerate(tokens)}
        if len(ranks) != len(tokens) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every single byte, and each token once")
        n = len(tokens)
        left, right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        for t, i in ranks.items():
            if len(t) > 1:
                parts = _merge(t, ranks, i)
                if len(parts) == 2:
                    left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
                else:
                    raise ValueError(f"token {i} isn't a merge of two earlier tokens")
        nodes: dict[tuple[int, int], int] = {}
        parent, edge, depth, token = [0], [0], [0], [-1]
        for t in sorted(tokens):
            at = 0
            for b in t:
                nxt = nodes.get((at, b))
                if nxt is None:
                    nxt = nodes[at, b] = len(parent)
                    parent.append(at)
                    edge.append(b)
                    depth.append(depth[at] + 1)
                    token.append(-1)
                at = nxt
            token[at] = ranks[t]
        return cls(b"".join(tokens), np.cumsum([0, *map(len, tokens)]), left, right, np.array(parent), np.array(edge), np.array(depth), np.array(token))

    def key(self) -> str:
        return hashlib.sha256(self.text + self.offsets.tobytes()).hexdigest()


class Encoder:
    """Encodes pieces of bytes; remembers those it has seen, up to ``remember``, then starts anew."""

    def __init__(self, tables: Tables, pattern: str = PATTERN, remember: int = 250_000):
        self.find = regex.compile(pattern).findall
        self.remember, self.n = remember, len(tables.left)
        self.left, self.right = tables.left, tables.right
        self.size = np.diff(tables.offsets)
        self.bytes, self.offsets = np.frombuffer(tables.text, np.uint8), tables.offsets
        merged = np.flatnonzero(tables.left != tables.right)
        same = np.flatnonzero((tables.left == tables.right) & (self.size > 1))  # as in "aa" from "a", "a"
        merged = np.sort(np.concatenate([merged, same]))
        self.merges = Lookup(mix(self.left[merged].astype(np.uint64) << np.uint64(32) | self.right[merged].astype(np.uint64)), merged)
        self._automaton(tables)
        self._forget()

    def _automaton(self, t: Tables) -> None:
        """Transitions, and for each state the longest token that ends there and the state of the next shorter one."""
        n = len(t.parent)
        inner = np.zeros(n, bool)
        inner[t.parent] = True
        self.row = np.zeros(n, np.int32)  # states without edges share the row of their longest suffix that has some
        self.row[inner] = np.arange(int(inner.sum()))
        self.goto = np.zeros((int(inner.sum()), 256), np.int32)
        fail = np.zeros(n, np.int64)
        order = np.argsort(t.depth, kind="stable")
        bounds = np.searchsorted(t.depth[order], np.arange(int(t.depth.max()) + 2))
        ends = np.zeros(n, np.int64)  # the state itself if a token ends in it, else the longest proper suffix state in which one does
        for d in range(len(bounds) - 1):  # a state's suffixes are shallower, so their rows are whole when it copies them
            level = order[bounds[d] : bounds[d + 1]]
            if d > 1:
                fail[level] = self.goto[self.row[fail[t.parent[level]]], t.edge[level]]
            if d:
                leaves, own = level[~inner[level]], level[inner[level]]
                self.row[leaves] = self.row[fail[leaves]]
                self.goto[self.row[own]] = self.goto[self.row[fail[own]]]
                ends[level] = np.where(t.token[level] >= 0, level, ends[fail[level]])
            if d + 2 < len(bounds):
                below = order[bounds[d + 1] : bounds[d + 2]]
                self.goto[self.row[t.parent[below]], t.edge[below]] = below
        self.token, self.ends, self.shorter = t.token, ends, ends[fail]

    def _forget(self) -> None:
        self.fresh: list[str] = []

        class Ids(dict):
            def __missing__(ids, piece: str) -> int:  # noqa: N805
                n = ids[piece] = len(ids)
                self.fresh.append(piece)
                return n

        self.ids = Ids()
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the tokens a and b apart where their texts meet; both are undone merge by merge, latest first."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            joint = self.merges(mix(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)))
            bad = (joint >= 0) & (joint < limit[todo])
            ok[todo[bad]] = False
            todo = todo[~bad]
            x, y = a[todo], b[todo]
            xs, ys = self.size[x] == 1, self.size[y] == 1
            todo, x, y, xs, ys = (v[~(xs & ys)] for v in (todo, x, y, xs, ys))
            undo = (~xs) & (ys | (x > y))  # the later merge of the two comes apart first; a tie undoes the right one
            i, j = todo[undo], todo[~undo]
            limit[i] = x[undo]
            a[i] = self.right[x[undo]]
            limit[j] = y[~undo] + 1
            b[j] = self.left[y[~undo]]
        return ok

    def encode_pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row of bytes, as flat ids and offsets; all rows step through the dynamic programme together."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        sizes, starts = size[order], off[:-1][order]
        last = np.full(len(buf), -1, np.int64)  # the unique last token of each prefix
        state = np.zeros(len(order), np.int64)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -i, side="left"))
            at = starts[:n] + i
            state[:n] = self.goto[self.row[state[:n]], buf[at]]
            node, todo = self.ends[state[:n]], np.arange(n)
            while len(todo):
                token = self.token[node]
                length = self.size[token]
                begin = i + 1 - length
                before = last[np.maximum(starts[todo] + begin - 1, 0)]
                good = begin == 0
                check = np.flatnonzero(~good & (before >= 0))
                good[check] = self.compatible(before[check], token[check])
                last[at[todo[good]]] = token[good]
                todo, node = todo[~good], self.shorter[node[~good]]
                left = node > 0
                todo, node = todo[left], node[left]
        used, counts = np.zeros(len(buf), bool), np.zeros(len(order), np.int64)
        pos, alive = starts + sizes, np.flatnonzero(sizes)
        while len(alive):
            end = pos[alive] - 1
            used[end] = True
            counts[alive] += 1
            pos[alive] -= self.size[last[end]]
            alive = alive[pos[alive] > starts[alive]]
        out = np.zeros(len(off), np.int64)
        out[1 + order] = counts
        return last[used].astype(np.int32), np.cumsum(out)

    def _learn(self) -> None:
        """Encode the pieces that were new."""
        if not self.fresh:
            return
        flat, at = self.encode_pieces(*view(pa.array(self.fresh, pa.large_string())))
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, at[1:] + self.at[-1]])
        self.fresh = []

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of a column of texts; null and empty texts have none."""
        flats, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        texts = column.to_pylist()
        for lo, hi, _, _ in pieces(column):
            if len(self.ids) > self.remember:
                self._forget()
            words, n = [], np.zeros(hi - lo, np.int64)
            for k, text in enumerate(texts[lo:hi]):
                if text:
                    found = [self.ids[p] for p in self.find(text)]
                    words.extend(found)
                    n[k] = len(found)
            self._learn()
            w = np.array(words, np.int64)
            size = self.at[w + 1] - self.at[w]
            flats.append(self.flat[ragged(self.at[w], size)])
            total = np.concatenate([[0], np.cumsum(size)])
            ends = np.cumsum(n)
            counts.append(total[ends] - total[ends - n])
        return np.concatenate(flats), np.cumsum(np.concatenate(counts))

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of rows of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id outside the vocabulary")
        size = self.size[ids]
        return self.bytes[ragged(self.offsets[ids], size)], np.concatenate([[0], np.cumsum(size)])[off]


_encoders: dict[str, Encoder] = {}


def encoder(tables: Tables, pattern: str = PATTERN) -> Encoder:
    """This process's encoder for these tables."""
    key = tables.key() + pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tables, pattern)
    return _encoders[key]


def encode_texts(docs: DataFrame, vocabulary: str | Vocabulary, pattern: str = PATTERN) -> DataFrame:
    """BPE ids of every text: (doc_id, ids, n_tokens, exact), a row for each row of ``docs``; no shuffle.

    ``exact`` says that decoding the ids gave the text's bytes again. The vocabulary is
    read once, on the driver; its tables (about 2 MB, of the vocabulary's size whatever
    the corpus) go to the workers by broadcast. Null texts have null ids, n_tokens and
    exact; empty texts have no ids; repeated rows give equal ids; a null id stays; an
    empty table gives no rows; texts are encoded whole; other columns are not read.
    """
    tables = (Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary).tables()
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, pattern)
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            for lo in range(0, len(batch), 2000):
                text = batch.column(1).slice(lo, 2000)
                ids, off = coder.encode(text)
                back, ends = coder.decode(ids, off)
                buf, want = view(text)
                exact = np.diff(ends) == np.diff(want)
                for k in np.flatnonzero(exact).tolist():
                    exact[k] = np.array_equal(back[ends[k] : ends[k + 1]], buf[want[k] : want[k + 1]])
                mask = null[lo : lo + 2000]
                arrays = [
                    batch.column(0).slice(lo, 2000),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(mask)),
                    pa.array(np.diff(off), pa.int32(), mask=mask),
                    pa.array(exact, mask=mask),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_tokens", "exact"])
        coder._forget()  # the next task has other pieces

    return text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, SCHEMA)


def decode_ids(encoded: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of rows of ids: (doc_id, text). Null ids give a null text, no ids an empty one; an id outside the vocabulary is an error."""
    tables = (Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary).tables()
    shared = encoded.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            column = batch.column(1)
            size = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            back, ends = coder.decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            texts = [None if null else back[a:b].tobytes().decode("utf-8", "replace") for null, a, b in zip(np.asarray(column.is_null()), ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return text_pass(encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")), run, "doc_id long, text string")
