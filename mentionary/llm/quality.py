"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has one lookup table (a value a bin) that cyclic boosting builds: round
after round, every feature in turn fits one shallow tree to the gradient that is
left, and the tree is added to its table. Then the feature pairs that explain most
of what remains get two-dimensional tables in the same way. A score is the sum of
one bin of each table, found by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import WORD, mix, pieces, prefix_hash, runs, span_hash
from .scratch import first_by_hash, text_pass, written

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "symbol", "stop", "lines", "line_length",
    "repeated_lines", "distinct_words", "bang", "pipe", "non_ascii", "short_words", "long_words", "repeated_next",
)
_SYMBOL, _STOP = b"#$%&*@^~<>{}[]\\/+=_", b".?;:,"


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_CLASSES = [_lut(c) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", _SYMBOL, _STOP, b"\n", b"!", b"|", bytes(range(0x80, 0x100)))]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each row."""
    key = np.sort((mix(hashes) << np.uint64(20)) | rows.astype(np.uint64))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] & np.uint64(0xFFFFF)).astype(np.int64), minlength=n).astype(float)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text; an empty or null text has zeros."""
    out = []
    for lo, hi, buf, off in pieces(column):
        n = hi - lo
        size = np.diff(off).astype(float)
        upper, digit, space, symbol, stop, newline, bang, pipe, high = (_sums(c[buf], off) for c in _CLASSES)
        starts, ends, rows = runs(WORD[buf], off)
        sums = prefix_hash(buf)
        hashes = span_hash(sums, starts, ends)
        length = ends - starts
        words = np.bincount(rows, minlength=n).astype(float)
        again = np.zeros(len(rows), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        ls, le, lr = runs(buf != 10, off)
        lines = np.bincount(lr, minlength=n).astype(float)
        b, w, k = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
        count = lambda keep: np.bincount(rows[keep], minlength=n)
        out.append(
            np.stack([
                np.log1p(size), np.log1p(words), np.bincount(rows, length, n) / w, upper / b, digit / b, space / b, symbol / b, stop / b, np.log1p(newline), size / k,
                1 - np.where(lines > 0, _distinct(lr, span_hash(sums, ls, le), n) / k, 1), np.where(words > 0, _distinct(rows, hashes, n) / w, 0), bang / b, pipe / b, high / b, count(length <= 3) / w, count(length >= 12) / w, count(again) / w,
            ], 1)
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Bin edges, one table a feature, and tables of pairs over coarse bins."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds, as sums of bins."""
        out = np.full(len(x), self.intercept)
        if not len(x):
            return out
        b = self.bins(x)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids):
            out += g[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out


def _leaf(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    return g / (h + reg)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, reg: float) -> np.ndarray:
    """Values a bin of the shallow tree that best fits gradient sums ``g`` with curvature sums ``h``."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), reg))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + reg) + (g.sum() - cg) ** 2 / (h.sum() - ch + reg)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + reg) + 1e-12:
            out[:cut], out[cut:] = _tree(g[:cut], h[:cut], depth - 1, reg), _tree(g[cut:], h[cut:], depth - 1, reg)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """The best four-leaf tree with one cut on either axis, and its gain."""
    G, H = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((h.shape[0] + 1, h.shape[1] + 1))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[1:-1, 1:-1], H[1:-1, 1:-1]
    if not a.size:
        return np.zeros_like(g), 0.0
    parts_g = (a, G[1:-1, -1:] - a, G[-1:, 1:-1] - a, G[-1, -1] - G[1:-1, -1:] - G[-1:, 1:-1] + a)
    parts_h = (b, H[1:-1, -1:] - b, H[-1:, 1:-1] - b, H[-1, -1] - H[1:-1, -1:] - H[-1:, 1:-1] + b)
    gain = sum(x**2 / (y + reg) for x, y in zip(parts_g, parts_h))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (r, c), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), parts_g, parts_h):
        out[r, c] = _leaf(x[i, j], y[i, j], reg)
    return out, float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + reg))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, depth: int = 2, bins: int = 32, coarse: int = 8, pairs: int = 5, reg: float = 1.0, holdout: float = 0.15) -> AdditiveModel:
    """Boost main effects, then ``pairs`` interactions; the held-out part chooses the number of rounds. The threshold is 0.5.

    With no rows, or rows of one class, the model is the (smoothed) prior alone.
    """
    n, k = x.shape if x.ndim == 2 else (0, len(FEATURES))
    p = (y.sum() + 1) / (n + 2)
    model = AdditiveModel([np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)], float(np.log(p / (1 - p))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(e) + 1) * coarse) // (len(e) + 1) for e in model.edges]
    if n < 20 or p * (n + 2) - 1 in (0, n):
        return model
    rest = np.random.default_rng(17).random(n) < holdout
    b, train = model.bins(x), ~rest
    f = np.full(n, model.intercept)
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y[rest] > 0, -f[rest], f[rest])))) if rest.any() else 0.0

    def boost(step, keep) -> None:
        best, stale = (loss(), keep()), 0
        for _ in range(rounds):
            step()
            now = loss()
            best, stale = ((now, keep()), 0) if now < best[0] - 1e-6 else (best, stale + 1)
            if stale >= 15:
                break
        model.tables, model.grids = best[1]

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return (y - q) * train, q * (1 - q) * train

    def mains() -> None:
        for j in range(k):
            g, h = slope()
            size = len(model.tables[j])
            t = rate * _tree(np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size), depth, reg)
            model.tables[j] = model.tables[j] + t
            f[:] += t[b[:, j]]

    kept = lambda: ([t.copy() for t in model.tables], [g.copy() for g in model.grids])
    boost(mains, kept)
    f[:] = model.score(x)
    c = np.stack([model.coarse[j][b[:, j]] for j in range(k)], 1)
    g, h = slope()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            cell = c[:, i] * coarse + c[:, j]
            grid = lambda v: np.bincount(cell, v, coarse * coarse).reshape(coarse, coarse)  # noqa: B023, E731
            gains.append((_pair_tree(grid(g), grid(h), reg)[1], i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:pairs] if gain > 0]
    model.grids = [np.zeros((coarse, coarse)) for _ in model.pairs]
    cells = [c[:, i] * coarse + c[:, j] for i, j in model.pairs]

    def crosses() -> None:
        for m, cell in enumerate(cells):
            g, h = slope()
            t = rate * _pair_tree(np.bincount(cell, g, coarse * coarse).reshape(coarse, coarse), np.bincount(cell, h, coarse * coarse).reshape(coarse, coarse), reg)[0]
            model.grids[m] = model.grids[m] + t
            f[:] += t.ravel()[cell]

    if model.pairs:
        boost(crosses, kept)
    return model


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>) by one narrow pass over the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1))
            flat = pa.array(x.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)], names=["doc_id", "features"])

    return text_pass(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, features array<double>")


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, **params) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents (the first by a hash of the id); only their few features reach the driver.

    Labels that are null or of unknown documents are left out; a repeated id counts once, with its highest label.
    """
    y = labels.where(labels[label_col].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(labels[label_col].cast("double")).alias("y"))
    sample = F.broadcast(first_by_hash(y, "doc_id", max_rows))  # of bounded size, so a broadcast whatever the corpus
    rows = features.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).orderBy("doc_id").select("features", "y").toPandas()
    x = np.stack(rows["features"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(float), **params)


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, quality double, keep boolean): the probability of good quality, by bin additions over whole batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            q = 1 / (1 + np.exp(-model.score(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(q, 9)), pa.array(q >= model.threshold)], names=["doc_id", "quality", "keep"])

    return text_pass(features.select("doc_id", "features"), run, "doc_id long, quality double, keep boolean")


def classify_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **params) -> DataFrame:
    """Train on labelled documents and score all: (doc_id, quality, keep), a row for each row of ``docs``.

    The text is read once: its features are written to the shared folder, joined to
    the labels for training and scored from there. Null and empty texts have zero
    features and get a score like any other; repeated rows get equal scores; a null id
    stays; an empty table gives no rows; no labels give the prior; other columns are
    not read.
    """
    features = written(features_of(docs), "quality-features")
    return score(features, train(features, labels, max_rows=max_rows, **params))
