"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of word n-grams; documents with equal sets are one class from the
start, so thousands of copies cost one member. A class's signature of min-hashes is read
once for each tree, from another place on, and these readings form the tree's prefix
trie: sorted, the signatures below a trie node are neighbours. Matching starts with the
longest prefixes and shortens them, each time looking only at the pairs that this adds,
until the recall reaches its target at every similarity that the pairs found so far
have. It can't become shorter than the length at which any pair at the threshold is
found with that probability. Pairs are compared by whole signatures, and those that are
near enough are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .buffers import WORD, lower, mix, pieces, prefix_hash, ragged, runs, span_hash
from .scratch import text_pass, written

THRESHOLD, NGRAM, TREES, RECALL = 0.6, 3, 24, 0.95
#: Prefixes that are tried, as far as they are longer than the shortest one.
PREFIXES = (16, 12, 8, 6, 5)
#: Signatures may differ from the threshold by this much (four standard deviations) before the sets are compared.
SLACK = 0.2
#: Members of a trie node that are compared in one task; a larger node is cut into blocks of about so many, and each pair of blocks is a cell.
BLOCK = 250
#: Pairs whose signatures are compared at once.
PAIRS = 50_000
#: Ids that may be broadcast as a filter (8 bytes each); more ids are joined.
BROADCAST_IDS = 4_000_000


def shortest_prefix(threshold: float, trees: int, recall: float, longest: int = 16) -> int:
    """The longest prefix at which every pair at the threshold shares one in some tree with probability ``recall`` or more."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this threshold and recall")


@lru_cache(maxsize=64)
def recall_at(depth: int, step: int, trees: int, samples: int = 2000) -> np.ndarray:
    """The probability that a pair shares a prefix of ``depth`` in some tree, by the share of equal min-hashes in steps of 1 / (trees * step).

    Prefixes longer than ``step`` run into the next tree's; their recall is counted on random signatures.
    """
    k = trees * step
    s = np.arange(k + 1) / k
    if depth <= step:
        return 1 - (1 - s**depth) ** trees
    u = np.random.default_rng(7).random((samples, k))
    return np.array([_shared(u < x, depth, step).any(1).mean() for x in s])


def _shared(equal: np.ndarray, depth: int, step: int) -> np.ndarray:
    """Whether the first ``depth`` values of each tree are equal, from rows of equal values; trees start ``step`` values apart and go round."""
    n = np.cumsum(np.concatenate([np.zeros((len(equal), 1), bool), equal, equal[:, : depth - 1]], 1), 1, dtype=np.int16)
    at = np.arange(0, equal.shape[1], step)
    return n[:, at + depth] - n[:, at] == depth


def shingle_hashes(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, hashes) of the word n-grams of each text; a shorter text is one n-gram of all its words."""
    for lo, hi, buf, off in pieces(column, prepare=lower):
        starts, ends, rows = runs(WORD[buf], off)
        h = span_hash(prefix_hash(buf), starts, ends)
        count = np.bincount(rows, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])
        if len(h) == 0:
            yield lo, hi, np.zeros(hi - lo + 1, np.int64), h
            continue
        out = np.zeros(len(h), np.uint64)
        left = np.repeat(first[1:], count) - np.arange(len(h))  # words from here to the text's end
        for k in range(n):
            more = left > k
            out = np.where(more, mix(out + np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)])), out)
        made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        keep = np.arange(len(h)) - np.repeat(first[:-1], count) < np.repeat(made, count)
        yield lo, hi, np.concatenate([[0], np.cumsum(made)]), out[keep]


def _constants(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (r[:k] >> np.uint64(32)).astype(np.uint32), (r[k:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(off: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """16 bits of each of ``k`` min-hashes of each row; rows without hashes have zeros."""
    out = np.zeros((len(off) - 1, k), np.uint16)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i, (a, b) in enumerate(zip(*_constants(k))):
            out[full, i] = np.minimum.reduceat((x ^ a) * b, off[full]).astype(np.uint16)
    return out


def signatures(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(doc_id, s1, s2, size, sig): two sums over the distinct n-grams and their number, which tell sets apart, and the min-hashes.

    Of an id that comes with several texts the one with the least sums counts. Texts
    without words are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, hashes in shingle_hashes(batch.column(1), n):
                sums, size = np.zeros((hi - lo, 2), np.int64), np.zeros(hi - lo, np.int32)
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if b > a:
                        size[i], *sums[i] = set_sums(np.unique(hashes[a:b]))
                sig = minhash(off, hashes, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(size), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "s1", "s2", "size", "sig"],
                )

    rows = text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id is not null"), run, "doc_id long, s1 long, s2 long, size int, sig binary")
    return rows.where("size > 0").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "size", "sig")).alias("x")).select("doc_id", "x.*")


def set_sums(distinct: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums of a set of hashes."""
    return len(distinct), int(distinct.sum().astype(np.int64)), int(mix(distinct).sum().astype(np.int64))


def set_classes(found: DataFrame) -> DataFrame:
    """(rep, copies, s1, s2, size, sig): signatures of the documents with the same set, their smallest id and their number."""
    return found.groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))


@dataclass(frozen=True)
class Forest:
    """The shape of the tries: ``trees`` readings of a signature, ``step`` values apart; prefixes of ``step`` values are the shortest."""

    trees: int
    step: int
    threshold: float
    recall: float

    @property
    def width(self) -> int:
        return self.trees * self.step

    def prefixes(self) -> list[int]:
        return [p for p in PREFIXES if self.step < p <= self.width] + [self.step]

    def enough(self, depth: int, found: np.ndarray) -> bool:
        """Whether prefixes of ``depth`` have the target recall wherever pairs were ``found``, which counts them by equal min-hashes."""
        least = np.flatnonzero(found[int(np.ceil(self.threshold * self.width)) :])
        return bool(len(least)) and recall_at(depth, self.step, self.trees)[int(np.ceil(self.threshold * self.width)) + least[0]] >= self.recall

    def cells(self, classes: DataFrame, block: int = BLOCK) -> DataFrame:
        """(cell, tree, members): the trie nodes at the shortest prefix that have two members or more, cut into blocks.

        Nodes are counted before anything is gathered, and a cell has two blocks at most.
        """
        heads = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 2 * self.step * t + 1, 2 * self.step)) for t in range(self.trees)])
        placed = classes.select("rep", F.posexplode(heads).alias("tree", "node"))
        crowds = placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        rows = placed.join(crowds, "node").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.select("rep", "tree", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        rows = rows.select("rep", "tree", "own", (low < high).alias("cross"), F.xxhash64("node", low, high).alias("cell"))
        rows = rows.join(classes.select("rep", "size", "sig"), "rep")
        return rows.groupBy("cell", "tree", "cross").agg(F.collect_list(F.struct("rep", "own", "size", "sig")).alias("m")).where("size(m) > 1")

    def pairs(self, cell: np.ndarray, tree: np.ndarray, cross: np.ndarray, own: np.ndarray, size: np.ndarray, sig: np.ndarray, depth: int, longer: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, equal min-hashes), a and b as positions in the rows: pairs of a cell that prefixes of ``depth`` add to those of ``longer``.

        Each pair comes once in all cells and lengths: in the first tree of the longest prefix.
        """
        n, k = sig.shape
        if n < 2:
            return
        turned = sig[np.arange(n)[:, None], (tree[:, None] * self.step + np.arange(k)[None, :]) % k]
        place = np.unique(cell, return_inverse=True)[1].astype(">u4")
        words = np.concatenate([place[:, None].view(np.uint8).reshape(n, 4), turned[:, : longer or depth].astype(">u2").view(np.uint8).reshape(n, -1)], 1)
        order = np.argsort(np.ascontiguousarray(words).view(f"S{words.shape[1]}").ravel(), kind="stable")
        words = words[order]

        def ends(width: int) -> np.ndarray:
            """For each row the end of the rows that begin with the same ``width`` bytes."""
            last = np.flatnonzero(np.append((words[1:, :width] != words[:-1, :width]).any(1), True)) + 1
            return np.repeat(last, np.diff(np.concatenate([[0], last])))

        hi = ends(4 + 2 * depth)
        lo = ends(4 + 2 * longer) if longer else np.arange(1, n + 1)
        count = hi - lo
        least = (self.threshold - SLACK) * k
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, int(count.sum()) + PAIRS, PAIRS))
        begin = 0
        for end in [*np.unique(cuts + 1).tolist(), n]:
            end = min(end, n)
            if end <= begin:
                continue
            part = slice(begin, end)
            begin = end
            first, second = np.repeat(np.arange(part.start, part.stop), count[part]), ragged(lo[part], count[part])
            for s in range(0, len(first), PAIRS):
                a, b = order[first[s : s + PAIRS]], order[second[s : s + PAIRS]]
                ok = np.minimum(size[a], size[b]) >= self.threshold * np.maximum(size[a], size[b])
                ok &= ~cross[a] | (own[a] != own[b])
                a, b = a[ok], b[ok]
                equal = turned[a] == turned[b]
                agree = equal.sum(1)
                ok = agree >= least
                a, b, equal, agree = a[ok], b[ok], equal[ok], agree[ok]
                if longer and len(a):
                    ok = ~_shared(equal, longer, self.step).any(1)
                    a, b, equal, agree = a[ok], b[ok], equal[ok], agree[ok]
                if len(a):
                    of = (tree[a][:, None] + np.arange(self.trees)[None, :]) % self.trees
                    ok = ~(_shared(equal, depth, self.step) & (of < tree[a][:, None])).any(1)
                    yield a[ok], b[ok], agree[ok]

    def level(self, cells: DataFrame, depth: int, longer: int | None) -> DataFrame:
        """(cell, tree, cross, rep, own) of the members in the pairs that ``depth`` adds, and rows (agree, n) that count the pairs by equal min-hashes."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("cell", pa.int64()), ("tree", pa.int32()), ("cross", pa.bool_()), ("rep", pa.int64()), ("own", pa.int32()), ("agree", pa.int32()), ("n", pa.int64())])
            for batch in batches:
                lists = batch.column(3)
                sizes = np.diff(np.asarray(lists.offsets))
                rep, own, size, sig = lists.flatten().flatten()
                rep, own, size = (np.asarray(x) for x in (rep, own, size))
                sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, self.width)
                at = np.repeat(np.arange(len(batch)), sizes)
                tree, cross = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (1, 2))
                seen, found = np.zeros(len(rep), bool), np.zeros(self.width + 1, np.int64)
                for a, b, agree in self.pairs(at, tree, cross, own, size, sig, depth, longer):
                    seen[a] = seen[b] = True
                    found += np.bincount(agree, minlength=self.width + 1)
                at, kinds = at[seen], np.flatnonzero(found)
                members = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(rep[seen]), pa.array(own[seen])]
                yield pa.RecordBatch.from_arrays([*members, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], schema=schema)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(kinds), schema.field(i).type) for i in range(5)), pa.array(kinds, pa.int32()), pa.array(found[kinds])], schema=schema)

        return text_pass(cells.select("cell", "tree", "cross", "m"), run, "cell long, tree int, cross boolean, rep long, own int, agree int, n long")

    def walk(self, classes: DataFrame) -> DataFrame:
        """(depth, longer, cell, tree, cross, rep, own): members of pairs, with the prefix length (and the longer one before it) at which they were found."""
        cells = written(self.cells(classes), "near-cells")
        found, out, longer = np.zeros(self.width + 1, np.int64), None, None
        for depth in self.prefixes():
            rows = written(self.level(cells, depth, longer), "near-level")
            for r in rows.where("n is not null").groupBy("agree").agg(F.sum("n").alias("n")).collect():  # at most one row a number of equal min-hashes
                found[r.agree] += r.n
            members = rows.where("n is null").select(F.lit(depth).alias("depth"), F.lit(longer or 0).alias("longer"), "cell", "tree", "cross", "rep", "own")
            out = members if out is None else out.unionByName(members)
            longer = depth
            if self.enough(depth, found):
                break
        return out


def with_ids(docs: DataFrame, ids: DataFrame, inside: bool, limit: int = BROADCAST_IDS, must: bool = True) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (``inside``) or isn't in the one column of ``ids``.

    Up to ``limit`` ids are broadcast to a filter without a shuffle of the texts; more are
    joined (or, if ``must`` is false, as before a join that does the same, not filtered at
    all). Rows with a null id are outside.
    """
    name = ids.columns[0]
    ids = written(ids.distinct(), "ids")
    if ids.count() > limit:
        if not must:
            return docs
        other = ids.select(F.col(name).alias("__with_ids"))
        return docs.join(other, docs["doc_id"] == other["__with_ids"], "left_semi" if inside else "left_anti")
    have = np.sort(ids.toArrow()[name].combine_chunks().to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(have)
    at = docs.columns.index("doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            own = batch.column(at)
            values = np.asarray(own.fill_null(0)).astype(np.int64)
            slot = np.searchsorted(keys, values)
            found = np.zeros(len(values), bool)
            ok = slot < len(keys)
            found[ok] = keys[slot[ok]] == values[ok]
            found &= ~np.asarray(own.is_null())
            yield batch.filter(pa.array(found == inside))

    return text_pass(docs, run, docs.schema)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for _, _, off, h in shingle_hashes(texts, n) for a, b in zip(off[:-1], off[1:])]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return common / (len(x) + len(y) - common)


def verified(docs: DataFrame, classes: DataFrame, members: DataFrame, forest: Forest, n: int, pairs: bool = False) -> DataFrame:
    """What the sets say of the forest's pairs, cell by cell: (rep, root, links), a row for each member with a link, or all (doc_a, doc_b, jaccard).

    ``links`` counts the documents that a member's partners stand for; members that pairs
    of the cell connect have one ``root``. Texts travel to their cells once each, and are
    held together only as sets of hashes, of two blocks at most.
    """
    texts = with_ids(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), members.select("rep"), True, must=False)
    rows = members.join(texts.where("text is not null").withColumnRenamed("doc_id", "rep").join(classes, "rep"), "rep")
    rows = rows.repartition("cell", "depth").sortWithinPartitions("cell", "depth", "rep").select("cell", "depth", "longer", "tree", "cross", "own", "rep", "copies", "s1", "s2", "size", "sig", "text")
    schema = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("jaccard", pa.float64())] if pairs else [("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        """Rows of the whole cells in ``rows``, which share a prefix length."""
        if len(rows) < 2:
            return
        cell, tree, cross, own, rep, copies, sig, sets = ([r[i] for r in rows] for i in range(8))
        sig = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, forest.width)
        size = np.array([len(x) for x in sets])
        links, root = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        arrays = np.array(cell), np.array(tree), np.array(cross), np.array(own)
        for xs, ys, _ in forest.pairs(*arrays, size, sig, rows[0][8], rows[0][9] or None):
            for x, y in zip(xs.tolist(), ys.tolist()):
                j = _jaccard(sets[x], sets[y])
                if j < forest.threshold:
                    continue
                if pairs:
                    yield min(rep[x], rep[y]), max(rep[x], rep[y]), j
                    continue
                links[x] += copies[y]
                links[y] += copies[x]
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
        if not pairs:
            yield from ((rep[i], rep[top(i)], k) for i, k in links.items() if k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            sets = _sets(batch.column(12), n)
            cell, depth, longer, tree, cross, own, rep, copies, s1, s2, size, sig = (batch.column(i).to_pylist() for i in range(12))
            for i, x in enumerate(sets):
                if set_sums(x) != (size[i], s1[i], s2[i]) or held and (held[-1][0], held[-1][8], held[-1][4]) == (cell[i], depth[i], rep[i]):
                    continue  # another text of the id, or its text again
                if held and (held[-1][8] != depth[i] or weight > 2_000_000 and held[-1][0] != cell[i]):
                    yield made(list(compare(held)))
                    held, weight = [], 0
                held.append((cell[i], tree[i], cross[i], own[i], rep[i], copies[i], sig[i], x, depth[i], longer[i]))
                weight += len(x)
        yield made(list(compare(held)))

    return text_pass(rows, run, "doc_a long, doc_b long, jaccard double" if pairs else "rep long, root long, links long")


def _found(docs: DataFrame, threshold: float, n: int, trees: int, recall: float) -> tuple[Forest, DataFrame, DataFrame]:
    """The forest, and written tables of the signatures and of the classes."""
    forest = Forest(trees, shortest_prefix(threshold, trees, recall), threshold, recall)
    own = written(signatures(docs, n, forest.width), "near-signatures")
    return forest, own, written(set_classes(own), "near-classes")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """A row for each document that has a partner, another one with a Jaccard index of word n-grams of ``threshold`` or more: (doc_id, class_id, copies, links).

    ``links`` is the number of its partners, ``copies`` how many of them have its very
    set; ``class_id`` is the smallest doc_id of all documents that links connect it with.
    Links between different sets are found with probability ``recall`` or more each and
    verified exactly; those of equal sets are all found. Every document is a query, with
    no cap on partners. ``near_pairs`` gives the pairs themselves. Null texts, texts
    without a word and rows with a null id have no partner; rows that repeat an id are
    one document (of different texts that with the least hash); an empty table gives no
    rows; texts are read whole; other columns are not read.
    """
    forest, own, classes = _found(docs, threshold, n, trees, recall)
    links = written(verified(docs, classes, forest.walk(classes), forest, n), "near-links")
    groups = connected_components(links.where("rep <> root"), "rep", "root").select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    sums = links.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = classes.select("rep", "copies", "s1", "s2", "size").join(sums, "rep", "left").join(groups, "rep", "left")
    linked = linked.select("s1", "s2", "size", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1).alias("copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    return own.select("doc_id", "s1", "s2", "size").join(linked, ["s1", "s2", "size"]).select("doc_id", "class_id", "copies", "links")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(doc_a, doc_b, jaccard), a < b: each document with the smallest id of those with its set, and the pairs of these smallest ids that reach the threshold.

    Linear in the number of copies, but not in that of near copies. Nulls, repeats and
    empty tables are as in ``jaccard_join``.
    """
    forest, own, classes = _found(docs, threshold, n, trees, recall)
    near = verified(docs, classes, forest.walk(classes), forest, n, pairs=True)
    same = own.join(classes.where("copies > 1").select("s1", "s2", "size", "rep"), ["s1", "s2", "size"]).where("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``docs`` with the smallest id of each group of near copies (connected through links), all columns as they were.

    Null and empty texts, documents without words and rows with a null id stay; rows that
    repeat an id share its fate; an empty table stays empty.
    """
    joined = jaccard_join(docs, threshold, n, trees, recall)
    return with_ids(docs, joined.where("doc_id <> class_id").select(F.col("doc_id").alias("gone")), False)
