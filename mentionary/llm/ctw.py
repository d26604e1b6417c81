"""LM scoring by context-tree weighting over byte contexts.

A byte is coded as eight binary decisions, each a node of a binary tree over byte
values. Every node has its own context tree whose contexts are the 0 to ``depth``
bytes before. A context holds how often the decision was 0 and 1; its estimate is
Krichevsky and Trofimov's, and its weighted probability is half its own estimate and
half the product over its longer contexts. After the corpus, a decision's
probability is a mix over all depths along its context path, with the posterior
weights that these probabilities give. The product of the eight decisions depends
on the (depth + 1)-gram alone, so a text is scored by the prices of its grams.

No table of all grams is ever in one place. Texts are worked on in chunks; a chunk asks
for the prices of its distinct grams and gets them back, in the order of its grams:

* chunk: distinct grams and their counts, cut by a hash of the gram into parts;
* part: counts of the whole corpus, and where each chunk's grams are among them;
* bucket: grams whose contexts end in the same two bytes, which form whole subtrees;
* the few nodes above these subtrees meet on the driver;
* prices go back from the buckets to the parts, and from there to the chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import mix, pieces
from .scratch import scanned, text_pass, written

#: Context bytes; a gram with its last byte has to fit a signed 64-bit key.
DEPTH = 6
#: Context bytes that the grams of one subtree share; shorter contexts are worked out on the driver (at most 256^2 grams).
SHARED = 2
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 32 << 20
#: Grams that are sorted at once.
SORT_GRAMS = 8 << 20
#: Parts (and buckets) for each partition of the texts, their least and their most.
PARTS, LEAST_PARTS, MOST_PARTS = 4, 64, 1 << 14
SCHEMA = "doc_id long, n_bytes long, bits double, bits_per_byte double"
_HALF = 0.5 * np.log(np.pi)


def grams(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """The byte at each position with the ``depth`` bytes before it in its row (zeros before the start), earliest byte highest."""
    padded = np.concatenate([np.zeros(8, np.uint8), buf])
    out = np.ndarray((len(buf),), ">u8", padded, offset=1, strides=(1,)).astype(np.uint64)
    out &= np.uint64((1 << (8 * (depth + 1))) - 1)
    size = np.diff(off)
    for k in range(depth):
        out[off[:-1][size > k] + k] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series after eight steps of the recurrence."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - 2 * _HALF - _lgamma(a + b + 1)


class _Level:
    """Counts of all decisions in all contexts of one length."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int):
        mask = np.uint64((1 << (8 * (depth + 1))) - 1)
        g = gram & mask
        context, byte = g >> np.uint64(8), g & np.uint64(255)
        self.bit, parts = [], []
        for j in range(8):  # decision j: the context and the byte's first j bits
            parts.append((context << np.uint64(8)) | (np.uint64(1 << j) | (byte >> np.uint64(8 - j))))
            self.bit.append(((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int8))
        self.key, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.astype(np.int32).reshape(8, -1)
        self.slot = list(at)
        ones = np.bincount(at.ravel(), (np.array(self.bit) * count).ravel(), len(self.key))
        total = np.bincount(at.ravel(), np.tile(count, 8), len(self.key))
        self.n1, self.n0 = ones, total - ones
        self.kt = log_kt(self.n0, self.n1)
        self.weighted = self.kt

    def estimate(self, j: int) -> np.ndarray:
        """Probability of decision j of each gram by this context length alone."""
        n0, n1 = self.n0[self.slot[j]], self.n1[self.slot[j]]
        return (np.where(self.bit[j] > 0, n1, n0) + 0.5) / (n0 + n1 + 1)


def _tree(gram: np.ndarray, count: np.ndarray, depth: int, least: int) -> list[_Level]:
    """Levels ``least`` .. ``depth`` with weighted probabilities, from the longest context down."""
    levels = [_Level(gram, count, d) for d in range(least, depth + 1)]
    for d in range(depth - 1, least - 1, -1):
        level, longer = levels[d - least], levels[d + 1 - least]
        # a longer context's key is its own bytes over the node; dropping its earliest byte gives the shorter context's key
        parent = (longer.key & np.uint64(255)) | (((longer.key >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8))
        product = np.bincount(np.searchsorted(level.key, parent), longer.weighted, len(level.key))
        level.weighted = np.logaddexp(level.kt, product) - np.log(2)
    return levels


def _mix(levels: list[_Level], j: int) -> np.ndarray:
    """Probability of decision j of each gram, mixed over these levels."""
    p = levels[-1].estimate(j)
    for level in levels[-2::-1]:
        own = np.exp(level.kt - np.log(2) - level.weighted)[level.slot[j]]
        p = own * level.estimate(j) + (1 - own) * p
    return p


def _runs(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often (or with what sum of ``n``) each is there."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[first], np.diff(np.append(first, len(x))) if n is None else np.add.reduceat(n, first)


class _Counter:
    """Distinct grams of a chunk, sorted, with their counts."""

    def __init__(self, depth: int):
        self.depth, self.raw, self.held, self.done = depth, [], 0, []

    def add(self, column: pa.Array) -> None:
        for _, _, buf, off in pieces(column, 1 << 20):
            if len(buf):
                self.raw.append(grams(buf, off, self.depth))
                self.held += len(buf)
                if self.held >= SORT_GRAMS:
                    self._sort()

    def _sort(self) -> None:
        x = np.concatenate(self.raw)
        x.sort()
        self.done.append(_runs(x))
        self.raw, self.held = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.raw or not self.done:
            self.raw.append(np.zeros(0, np.uint64))
            self._sort()
        if len(self.done) > 1:
            x, n = (np.concatenate([d[i] for d in self.done]) for i in range(2))
            order = np.argsort(x, kind="stable")
            self.done = [_runs(x[order], n[order])]
        return self.done[0]


class _Cutter:
    """Gives the rows of a scan their chunks: rows of one split of a file, one after another, up to ``size`` bytes."""

    def __init__(self, size: int):
        self.size, self.split, self.number, self.held = size, None, 0, 0

    def __call__(self, split: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        numbers = np.zeros(len(split), np.uint64)
        for i, (s, n) in enumerate(zip(split.tolist(), sizes.tolist())):
            if s != self.split:
                self.split, self.number, self.held = s, 0, 0
            elif self.held and self.held + n > self.size:
                self.number, self.held = self.number + 1, 0
            self.held += n
            numbers[i] = self.number
        return mix(split.astype(np.uint64) + numbers * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return struct.pack("<II", len(arrays[0]), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, size = struct.unpack("<II", blob[:8])
    raw, out, at = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), np.uint8), [], 0
    for kind in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _split_by(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by ``of`` and where each of the ``n`` values begins in it."""
    order = np.argsort(of.astype(np.uint16), kind="stable")
    return order, np.searchsorted(of[order], np.arange(n + 1))


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    return (mix(gram) % np.uint64(parts)).astype(np.int64)


def _bucket(gram: np.ndarray, shared: int, buckets: int) -> np.ndarray:
    return (mix((gram >> np.uint64(8)) & np.uint64((1 << (8 * shared)) - 1)) % np.uint64(buckets)).astype(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)], schema)


def _readable(docs: DataFrame) -> DataFrame:
    """(split, doc_id, text) from files, so that a row is in the same place of the same split whenever it is read; other tables are written first, and small ones over all cores."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if not scanned(rows) or rows.rdd.getNumPartitions() < cores:
        rows = written(rows.repartition(cores), "ctw-rows")
    return rows.select(F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"), "doc_id", "text")


def _sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def asked_grams(rows: DataFrame, depth: int, parts: int, chunk_bytes: int, counted: bool = True, asked: bool = True) -> DataFrame:
    """(part, chunk, data): the grams and counts of each chunk by part; chunk is null where no prices are asked for, counts are 0 where not ``counted``."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, now, counter = _Cutter(chunk_bytes), None, _Counter(depth)

        def made() -> Iterator[pa.RecordBatch]:
            gram, n = counter.result()
            order, at = _split_by(_part(gram, parts), parts)
            gram, n = gram[order], n[order].astype(np.uint32) * np.uint32(counted)
            for lo in range(0, parts, 64):
                yield _batch(schema, [(p, now if asked else None, _pack(gram[at[p] : at[p + 1]], n[at[p] : at[p + 1]])) for p in range(lo, min(parts, lo + 64)) if at[p + 1] > at[p]])

        for batch in batches:
            if not len(batch):
                continue
            chunk = cut(batch.column(0).to_numpy(), _sizes(batch.column(1)))
            edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if chunk[lo] != now:
                    if now is not None:
                        yield from made()
                    now, counter = int(chunk[lo]), _Counter(depth)
                counter.add(batch.column(1).slice(lo, hi - lo))
        if now is not None:
            yield from made()

    return text_pass(rows.select("split", "text"), run, "part int, chunk long, data binary", whole=True)


_TOTALS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])


def totals(asked: DataFrame, shared: int, buckets: int) -> DataFrame:
    """(part, bucket, chunk, data): rows of a bucket have the part's grams and their counts in the whole corpus, rows of a chunk the gaps between its grams' places among these."""

    def merge(table: pa.Table) -> pa.Table:
        part, chunks = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        each = [_unpack(b, np.uint64, np.uint32) for b in table.column("data").to_pylist()]
        every = np.concatenate([g for g, _ in each])
        gram = np.sort(every)
        gram = _runs(gram)[0]
        at = np.searchsorted(gram, every)
        n = np.bincount(at, np.concatenate([n for _, n in each]), len(gram)).astype(np.uint64)
        order, begin = _split_by(_bucket(gram, shared, buckets), buckets)
        out = [(part, b, None, _pack(gram[order[begin[b] : begin[b + 1]]], n[order[begin[b] : begin[b + 1]]])) for b in np.flatnonzero(np.diff(begin)).tolist()]
        begin = 0
        for chunk, (g, _) in zip(chunks, each):
            if chunk is not None:
                out.append((part, None, chunk, _pack(np.diff(at[begin : begin + len(g)], prepend=0).astype(np.uint32))))
            begin += len(g)
        return _table(_TOTALS, out)

    return asked.groupBy("part").applyInArrow(merge, "part int, bucket int, chunk long, data binary")


def subtrees(found: DataFrame) -> DataFrame:
    """(bucket, parts, sizes, data): all grams of each bucket with their counts, part after part."""
    schema = pa.schema([("bucket", pa.int32()), ("parts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist()))
        each = [_unpack(b, np.uint64, np.uint64) for _, b in rows]
        return _table(schema, [(table.column("bucket")[0].as_py(), [p for p, _ in rows], [len(g) for g, _ in each], _pack(*(np.concatenate([e[i] for e in each]) for i in range(2))))])

    return found.where("bucket is not null").select("bucket", "part", "data").groupBy("bucket").applyInArrow(join, "bucket int, parts array<int>, sizes array<int>, data binary")


def _above(trees: DataFrame, depth: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, base, rest) of the contexts shorter than ``shared``: a decision's mix is base + rest * (the mix over longer contexts)."""
    mask = (1 << (8 * shared)) - 1
    schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("w", pa.float64())])

    def below(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                gram, n = _unpack(blob, np.uint64, np.uint64)
                level = _tree(gram, n.astype(float), depth, shared)[0]
                parent = (level.key & np.uint64(255)) | (((level.key >> np.uint64(8)) & np.uint64(mask >> 8)) << np.uint64(8))
                ends, at = np.unique(gram & np.uint64(mask), return_inverse=True)
                for kind, node, w in ((0, ends, np.bincount(at, n, len(ends))), (1, parent, level.weighted)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), kind, np.int32)), pa.array(node.astype(np.int64)), pa.array(w)], schema=schema)

    # sums in the order of their terms, so that the same corpus has the same prices whatever the tasks do
    rows = text_pass(trees.select("data"), below, "kind int, node long, w double").groupBy("kind", "node").agg(F.sort_array(F.collect_list("w")).alias("w"))
    found = rows.select("kind", "node", F.aggregate("w", F.lit(0.0), lambda s, x: s + x).alias("w")).toArrow().sort_by("node")  # at most 2 * 256^shared rows
    kind, node, w = (found.column(c).to_numpy() for c in ("kind", "node", "w"))
    ends = node[kind == 0].astype(np.uint64)
    levels = [_Level(ends, w[kind == 0], d) for d in range(shared)]
    product = np.zeros(len(levels[-1].key))
    product[np.searchsorted(levels[-1].key, node[kind == 1].astype(np.uint64))] = w[kind == 1]
    levels[-1].weighted = np.logaddexp(levels[-1].kt, product) - np.log(2)
    for d in range(shared - 2, -1, -1):
        level, longer = levels[d], levels[d + 1]
        parent = (longer.key & np.uint64(255)) | (((longer.key >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8))
        level.weighted = np.logaddexp(level.kt, np.bincount(np.searchsorted(level.key, parent), longer.weighted, len(level.key))) - np.log(2)
    base, rest = np.zeros((8, len(ends))), np.ones((8, len(ends)))
    for level in levels:
        share = np.exp(level.kt - np.log(2) - level.weighted)
        for j in range(8):
            part = share[level.slot[j]]
            base[j] += rest[j] * part * level.estimate(j)
            rest[j] *= 1 - part
    return ends, base, rest


def prices(trees: DataFrame, depth: int, shared: int) -> DataFrame:
    """(part, bucket, data): the ideal code length in bits of each gram's last byte in its context, in the order of the part's grams of the bucket."""
    upper = trees.sparkSession.sparkContext.broadcast(_above(trees, depth, shared)) if shared else None
    schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, parts, sizes, blob in zip(*(c.to_pylist() for c in batch.columns)):
                gram, n = _unpack(blob, np.uint64, np.uint64)
                levels, bits = _tree(gram, n.astype(float), depth, shared), np.zeros(len(gram))
                if upper is not None:
                    ends, base, rest = upper.value
                    at = np.searchsorted(ends, gram & np.uint64((1 << (8 * shared)) - 1))
                for j in range(8):
                    p = _mix(levels, j)
                    bits -= np.log2(p if upper is None else base[j][at] + rest[j][at] * p)
                cut = np.concatenate([[0], np.cumsum(sizes)])
                yield _batch(schema, [(p, bucket, bits[a:b].astype(np.float32).tobytes()) for p, a, b in zip(parts, cut[:-1], cut[1:])])

    return text_pass(trees.select("bucket", "parts", "sizes", "data"), run, "part int, bucket int, data binary")


def answers(found: DataFrame, priced: DataFrame) -> DataFrame:
    """(chunk, part, data): the prices of each chunk's grams of each part, in the order of the grams."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])

    def look_up(mine: pa.Table, given: pa.Table) -> pa.Table:
        price = {b: np.frombuffer(d, np.float32) for b, d in zip(given.column("bucket").to_pylist(), given.column("data").to_pylist())}
        gram, bits, asked = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)], []
        part = mine.column("part")[0].as_py() if len(mine) else None
        for bucket, chunk, blob in zip(*(mine.column(c).to_pylist() for c in ("bucket", "chunk", "data"))):
            if bucket is None:
                asked.append((chunk, blob))
            else:
                gram.append(_unpack(blob, np.uint64)[0])
                bits.append(price[bucket])
        bits = np.concatenate(bits)[np.argsort(np.concatenate(gram))]
        return _table(schema, [(chunk, part, bits[np.cumsum(_unpack(blob, np.uint32)[0], dtype=np.int64)].tobytes()) for chunk, blob in asked])

    return found.groupBy("part").cogroup(priced.groupBy("part")).applyInArrow(look_up, "chunk long, part int, data binary")


def _scored(column: pa.Array, depth: int, gram: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bits of each text. A position's gram and its row are sorted as one number, so that equal grams are looked up once."""
    total, size = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for first in range(0, len(column), 256):
        for lo, hi, buf, off in pieces(column.slice(first, 256), 1 << 20):
            size[first + lo : first + hi] = np.diff(off)
            if len(buf):
                x = grams(buf, off, depth) << np.uint64(8)
                x |= np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(off))
                x.sort()
                row = (x & np.uint64(255)).astype(np.int64)
                x >>= np.uint64(8)
                own, n = _runs(x)
                total[first + lo : first + hi] = np.bincount(row, np.repeat(bits[np.searchsorted(gram, own)], n), hi - lo)
    return size, total


def score_texts(docs: DataFrame, corpus: DataFrame | None = None, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Code length of each text under the tree of the whole corpus: (doc_id, n_bytes, bits, bits_per_byte), a row for each row of ``docs``.

    ``corpus`` is ``docs`` by default. Counts come from every text of it; grams that only
    ``docs`` has take part with a count of zero, so any text can be scored. Texts are read
    twice and shuffled once, to meet the prices of their chunk's grams; these are kept as
    32-bit floats. Null and empty texts have 0 bits and a null bits_per_byte; repeated
    rows score equally (and count twice in the corpus); a null id stays; an empty table
    gives no rows; other columns are not read.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a gram and a row number have to fit 64 bits: depth is 0 to 6")
    rows, shared = _readable(docs), min(SHARED, depth)
    parts = min(MOST_PARTS, max(LEAST_PARTS, PARTS * rows.rdd.getNumPartitions()))
    asked = asked_grams(rows, depth, parts, chunk_bytes, counted=corpus is None)
    if corpus is not None:
        asked = asked.unionByName(asked_grams(_readable(corpus), depth, parts, chunk_bytes, asked=False))
    found = written(totals(asked, shared, parts), "ctw-totals")
    trees = written(subtrees(found), "ctw-trees")
    given = answers(found, prices(trees, depth, shared))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter(chunk_bytes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cut(batch.column(0).to_numpy(), _sizes(batch.column(2))), pa.int64()), batch.column(1), batch.column(2)], names=["chunk", "doc_id", "text"])

    def score(texts: pa.Table, prices: pa.Table) -> pa.Table:
        column = texts.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        counter = _Counter(depth)
        counter.add(column)
        gram, _ = counter.result()
        order, _ = _split_by(_part(gram, parts), parts)
        came = b"".join(d for _, d in sorted(zip(prices.column("part").to_pylist(), prices.column("data").to_pylist())))
        if len(came) != 4 * len(gram):
            raise ValueError("the files of the texts changed while they were scored")
        bits = np.zeros(len(gram), np.float32)
        bits[order] = np.frombuffer(came, np.float32)
        size, total = _scored(column, depth, gram, bits)
        return pa.table({"doc_id": texts.column("doc_id"), "n_bytes": pa.array(size), "bits": pa.array(total)})

    placed = text_pass(rows, place, "chunk long, doc_id long, text string", whole=True)
    sums = placed.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(score, "doc_id long, n_bytes long, bits double")
    return sums.select("doc_id", "n_bytes", F.round("bits", 6).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 9)).alias("bits_per_byte"))
