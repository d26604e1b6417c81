"""Toxicity: a counterfactual-regularised linear classifier.

Features are words and word beginnings (so inflected forms share a weight). Besides
the logistic loss, training pays for every change of score between a labelled
sentence and its counterfactuals, in which an identity term is replaced by another
of its kind: what a neutral mention of a group adds to the score is pressed to the
same value for all groups. An L1 term leaves a short list of features.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import WORD, lower, mix, pieces, prefix_hash, runs, span_hash
from .scratch import first_by_hash, text_pass, written

#: Kinds of identity terms; a counterfactual replaces a term by the others of its list.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender people", "nonbinary people"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("immigrants", "refugees", "locals", "foreigners", "natives"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
BITS = 22
PREFIXES = (4, 5, 6, 8)
DOC_SCHEMA = "doc_id long, toxicity double, toxic boolean"


def feature_ids(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, feature) of every word and word beginning of a column of texts."""
    for lo, hi, buf, off in pieces(column, prepare=lower):
        starts, ends, rows = runs(WORD[buf], off)
        sums = prefix_hash(buf)
        length = ends - starts
        ids, where = [span_hash(sums, starts, ends)], [rows]
        for size in PREFIXES:
            long = length > size
            ids.append(mix(span_hash(sums, starts[long], starts[long] + size) + np.uint64(size)))
            where.append(rows[long])
        yield lo, hi, np.concatenate(where), (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    """Weights of the features that were kept, the intercept, and the score from which a document is rejected."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    threshold: float = 0.5

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of toxicity of each text; features count once a text."""
        out = np.full(len(column), self.intercept)
        if len(self.features):
            table = np.zeros(1 << BITS, np.int32)
            table[self.features] = np.arange(1, len(self.features) + 1)
            for lo, hi, rows, ids in feature_ids(column):
                at = table[ids]
                hit = at > 0
                key = np.unique(rows[hit] * (len(self.features) + 1) + at[hit])
                out[lo:hi] += np.bincount(key // (len(self.features) + 1), self.weights[key % (len(self.features) + 1) - 1], hi - lo)
        return 1 / (1 + np.exp(-out))


def counterfactuals(texts: list[str], identity: tuple[tuple[str, ...], ...] = IDENTITY) -> tuple[list[str], list[str]]:
    """Sentences with an identity term, and the same sentences with another term of its kind instead."""
    kind = {t: k for k, terms in enumerate(identity) for t in terms}
    find = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kind), key=lambda t: (-len(t), t))) + r")\b")
    before, after = [], []
    for text in texts:
        for sentence in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
            for m in find.finditer(sentence):
                for other in identity[kind[m[0]]]:
                    if other != m[0]:
                        before.append(sentence)
                        after.append(sentence[: m.start()] + other + sentence[m.end() :])
    return before, after


def _distinct(column: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text, ascending."""
    out = []
    for lo, hi, rows, ids in feature_ids(column):
        key = np.unique((rows << BITS) | ids)
        ends = np.searchsorted(key, np.arange(1, hi - lo + 1) << BITS)
        out += np.split((key & ((1 << BITS) - 1)).astype(np.int32), ends[:-1])
    return out


def _swaps(texts: list[str], identity: tuple[tuple[str, ...], ...]) -> list[list[np.ndarray]]:
    """For each counterfactual of each text, the features it loses (as -1 - feature) and gains."""
    out: list[list[np.ndarray]] = []
    for text in texts:
        found = counterfactuals([text], identity)
        pair = [_distinct(pa.array(t, pa.large_string())) for t in found] if found[0] else []
        if not pair:
            out.append([])
            continue
        out.append([np.concatenate([-1 - np.setdiff1d(x, y), np.setdiff1d(y, x)]) for x, y in zip(*pair)])
    return out


def gain(inside: np.ndarray, outside: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """How much a feature tells, from the numbers of toxic and other rows that have it; what speaks against toxicity counts a quarter."""
    a, b = inside + 0.5, outside + 0.5
    p, q = a / (positive + 1), b / (negative + 1)
    up = a * np.log(p / q) + (positive + 1 - a) * np.log((1 - p).clip(1e-9) / (1 - q).clip(1e-9))
    return np.where(p > q, up, b * np.log(q / p) * 0.25)


def optimise(y: np.ndarray, rows: list[np.ndarray], swaps: list[np.ndarray], chosen: np.ndarray, pairs_weight: float = 1.0, l1: float = 2e-4, steps: int = 300) -> ToxicityModel:
    """Accelerated proximal gradient steps on loss + ``pairs_weight`` * mean squared change of score over counterfactuals + L1.

    ``rows`` are the features of each labelled text, as places in ``chosen``; ``swaps``
    those that each counterfactual gains, and -1 less those it loses.
    """
    n, k, m, positive = len(y), len(chosen), len(swaps), float(y.sum())
    flat = lambda parts: (np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]), np.concatenate([np.zeros(0, np.int32), *parts]))
    r, c = flat(rows)
    dr, dc = flat(swaps)
    dv = np.where(dc < 0, -1.0, 1.0)
    dc = np.where(dc < 0, -1 - dc, dc)
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    w, z, t, bias = np.zeros(k), np.zeros(k), 1.0, 0.0
    step = 4.0 / max(1.0, float(np.bincount(c, weight[r], k).max()) * 8 if len(c) else 1.0)
    if m:
        step /= 1 + pairs_weight * 4
    for _ in range(steps):
        s = np.bincount(r, z[c], n) + bias
        e = (1 / (1 + np.exp(-s)) - y) * weight
        grad = np.bincount(c, e[r], k)
        if m:
            change = np.bincount(dr, z[dc] * dv, m)
            grad += 2 * pairs_weight / m * np.bincount(dc, change[dr] * dv, k)
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        bias -= step * float(e.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / nt * (new - w), new, nt
    keep = np.abs(w) > 1e-6
    s = np.bincount(r, w[c], n) + bias
    model = ToxicityModel(chosen[keep], w[keep], bias)
    # the threshold with the fewest wrong (balanced) decisions, in the middle of where they stay fewest
    order = np.argsort(-s, kind="stable")
    wrong = (positive - np.cumsum(y[order])) / positive + np.cumsum(1 - y[order]) / (n - positive)
    at = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low, high = s[order[at[-1]]], s[order[min(at[-1] + 1, n - 1)]]
    model.threshold = float(1 / (1 + np.exp(-(low + high) / 2)))
    return model


def _prior(n: int, positive: int) -> ToxicityModel:
    """Without labels of both classes: the smoothed share of toxic labels, and nothing is toxic."""
    p = (positive + 1) / (n + 2)
    return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))), 1.1)


def _local(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Signed features as signed places in ``chosen``; others are left out."""
    lost = features < 0
    ids = np.where(lost, -1 - features, features)
    at = np.minimum(np.searchsorted(chosen, ids), max(0, len(chosen) - 1))
    ok = chosen[at] == ids if len(chosen) else np.zeros(len(ids), bool)
    return np.where(lost, -1 - at, at)[ok].astype(np.int32)


def fit(texts: list[str], y: np.ndarray, features: int = 4096, min_rows: int = 3, identity: tuple[tuple[str, ...], ...] = IDENTITY, **params) -> ToxicityModel:
    """Fit on texts in memory, by the same steps as ``train``."""
    y = np.asarray(y, float)
    positive = float(y.sum())
    if not positive or positive == len(y):
        return _prior(len(y), int(positive))
    rows = _distinct(pa.array(texts, pa.large_string()))
    ids, where = np.concatenate([np.zeros(0, np.int32), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    inside, outside = np.bincount(ids[y[where] > 0], minlength=1 << BITS), np.bincount(ids[y[where] == 0], minlength=1 << BITS)
    seen = np.flatnonzero(inside + outside >= min_rows)
    chosen = np.sort(seen[np.lexsort((seen, -gain(inside[seen], outside[seen], positive, len(y) - positive)))[:features]])
    swaps = [s for t in _swaps(texts, identity) for s in t]
    return optimise(y, [_local(r, chosen) for r in rows], [_local(s, chosen) for s in swaps], chosen, **params)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 6_000, features: int = 4096, min_rows: int = 3, identity: tuple[tuple[str, ...], ...] = IDENTITY, **params) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled documents of each class (the first by a hash of the id).

    The sampled ids are few and bounded, so they are broadcast to the one scan that
    fetches their texts; features are made and counted where the texts are, and only the
    chosen ones reach the driver: the ``features`` that tell most of those in ``min_rows``
    sampled texts or more (the model's size, a bound on what is fitted; no text is cut).
    The threshold has the fewest wrong decisions on the sample itself. Null labels, ids and texts are left out; a repeated id
    counts once in the sample, with its highest label, and with each of its texts.
    """
    y = labels.where(labels[label_col].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("_id")).agg(F.max((labels[label_col] > 0).cast("int")).alias("_y"))
    parts = [first_by_hash(y.where(F.col("_y") == k), "_id", max_rows) for k in (0, 1)]
    texts = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text")).where("_text is not null")
    sample = texts.join(F.broadcast(parts[0].union(parts[1])), "_id").select("_id", "_y", "_text")
    kind = "id long, y int, features array<int>, swaps array<array<int>>"
    lists = pa.list_(pa.int32())

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_distinct(batch.column(2)), lists), pa.array(_swaps(batch.column(2).to_pylist(), identity), pa.list_(lists))], names=["id", "y", "features", "swaps"])

    sample = written(text_pass(sample, extract, kind), "toxicity-sample")
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return _prior(sum(size.values()), size.get(1, 0))
    counts = sample.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= min_rows)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy().astype(float) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(gain(a, b, size[1], size[0]), 9))], names=["f", "gain"])

    best = counts.mapInArrow(weigh, "f int, gain double").orderBy(F.desc("gain"), "f").limit(features)
    chosen = np.sort(np.array([r.f for r in best.collect()], np.int64))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_local(np.asarray(f, np.int64), chosen) for f in batch.column(2).to_pylist()]
            swaps = [[_local(np.asarray(s, np.int64), chosen) for s in t] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, lists), pa.array(swaps, pa.list_(lists))], names=["id", "y", "features", "swaps"])

    rows = sorted(text_pass(sample, local, kind).toArrow().to_pylist(), key=lambda r: (r["id"], r["y"], r["features"]))
    swaps = [np.array(s, np.int32) for r in rows for s in r["swaps"]]
    return optimise(np.array([r["y"] for r in rows], float), [np.array(r["features"], np.int32) for r in rows], swaps, chosen, **params)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row, by one narrow pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(p, 9)), pa.array(p >= model.threshold)], names=["doc_id", "toxicity", "toxic"])

    return text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, DOC_SCHEMA)


def classify_toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Train on labelled documents, score all: (doc_id, toxicity, toxic), a row for each row of ``docs``.

    Null and empty texts score as the intercept alone; repeated rows score equally; a
    null id stays; an empty table gives no rows; without labels of both classes nothing
    is toxic; texts are read whole; other columns are not read.
    """
    return score(docs, train(docs, labels, **params))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that ``model`` rejects, all columns as they were, without a shuffle.

    A row with a null or empty text holds nothing toxic and stays.
    """
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            stays = (model.score(text) < model.threshold) | np.asarray(text.is_null()) | (np.asarray(pa.compute.binary_length(text).fill_null(0)) == 0)
            yield batch.filter(pa.array(stays))

    return text_pass(docs, run, docs.schema)
