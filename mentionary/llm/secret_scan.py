"""Secret scans: sliding-window Shannon entropy per character class, with an allow-list.

Candidate strings are maximal runs of one character class (hexadecimal, base-36,
base-64) of at least its shortest length. A window slides over the candidate; the
counts of its characters change by one leaving and one entering character a step,
and so does the sum of c*log2(c) from which the entropy follows. A candidate whose
highest window entropy reaches the class's threshold is a finding, unless the
allow-list names it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import pieces, runs
from .scratch import text_pass


@dataclass(frozen=True)
class CharClass:
    """Characters, shortest candidate, window and threshold (bits a character) of one class; ``needs`` are sets of which each must occur."""

    name: str
    chars: bytes
    shortest: int
    window: int
    threshold: float
    needs: tuple[bytes, ...]


DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex", DIGITS + b"abcdefABCDEF", 24, 24, 3.0, (DIGITS, b"abcdefABCDEF")),
    CharClass("base36", DIGITS + LOWER + UPPER, 20, 20, 3.5, (DIGITS, LOWER + UPPER)),
    CharClass("base64", DIGITS + LOWER + UPPER + b"+/=_-", 24, 24, 3.7, (DIGITS, LOWER, UPPER)),
)
#: Candidates that match one of these wholly are no secrets: identifiers, placeholders, alphabets.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i).*(?:example|placeholder|changeme|dummy|redacted|your[_-]?(?:key|token|secret)).*",
    r"(?i).*(?:0123456789|123456789|abcdefghijkl|a1b2c3d4).*",
    r".*(.)\1{7,}.*",
    r"sha(?:1|256|384|512)-.*",
)
SCHEMA = "doc_id long, start int, end int, char_class string, entropy double, masked string"


def window_entropy(text: bytes, window: int) -> float:
    """The highest Shannon entropy of any window, by incremental counts; a shorter text is one window."""
    window = min(window, len(text))
    if not window:
        return 0.0
    counts, total = [0] * 256, 0.0
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    best = math.inf
    for i, c in enumerate(text):
        n = counts[c]
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window - 1:
            best = min(best, total)
            c = text[i - window + 1]
            n = counts[c]
            total += term[n - 1] - term[n]
            counts[c] = n - 1
    return math.log2(window) - best / window


def _tables(classes: tuple[CharClass, ...]) -> list[tuple[CharClass, np.ndarray, list[np.ndarray]]]:
    def table(chars: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t

    return [(c, table(c.chars), [table(n) for n in c.needs]) for c in classes]


def _holds(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(table[buf])
    return np.searchsorted(at, ends) > np.searchsorted(at, starts)


def findings(column: pa.Array, ids: list, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for a column of texts. Where classes overlap, a finding inside a longer or earlier-listed one is left out."""
    allowed = [re.compile(a, re.S) for a in allow]
    tables = _tables(classes)
    for lo, _, buf, off in pieces(column):
        taken: dict[int, list[tuple]] = {}
        for c, chars, needs in tables:
            starts, ends, rows = runs(chars[buf], off)
            keep = ends - starts >= c.shortest
            starts, ends, rows = starts[keep], ends[keep], rows[keep]
            for need in needs:
                if len(starts):
                    keep = _holds(buf, starts, ends, need)
                    starts, ends, rows = starts[keep], ends[keep], rows[keep]
            for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist()):
                text = buf[s:e].tobytes()
                entropy = window_entropy(text, c.window)
                if entropy >= c.threshold and not any(a.fullmatch(text.decode("latin-1")) for a in allowed):
                    taken.setdefault(r, []).append((s, e, c.name, entropy, text))
        for r, found in taken.items():
            base, chosen = int(off[r]), []
            for f in sorted(found, key=lambda f: (f[0] - f[1], [c.name for c in classes].index(f[2]))):
                if all(f[1] <= g[0] or f[0] >= g[1] for g in chosen):
                    chosen.append(f)
            chosen.sort()
            at, chars_before = base, 0
            for s, e, name, entropy, text in chosen:
                chars_before += len(buf[at:s].tobytes().decode("utf-8", "replace"))
                at = s
                yield ids[lo + r], chars_before, chars_before + (e - s), name, round(entropy, 9), text[:4].decode("latin-1") + "*" * min(8, e - s - 4)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """High-entropy strings in ``text_col``: (doc_id, start, end, char_class, entropy, masked), offsets in characters.

    One narrow pass over the text, without a shuffle. Null and empty texts, and empty
    tables, give no rows; a null id is passed through; repeated rows give repeated
    findings; of equal spans in two classes the class listed first stays; other
    columns are not read, whatever their names; a text of any length is read whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("char_class", pa.string()), ("entropy", pa.float64()), ("masked", pa.string())])
        for batch in batches:
            rows = list(findings(batch.column(1), batch.column(0).to_pylist(), classes, allow))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    return text_pass(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)
