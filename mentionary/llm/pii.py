"""PII by a skip-chain conditional random field.

Tokens are the nodes of a chain; equal tokens of a document share a potential, however
far apart and however many, and so do the different spellings of similar ones, so that
evidence at one mention reaches all others at once. A shared potential is a hidden node
that all its members are joined to; for two of them it is the same as an edge between
them. Loopy belief propagation passes messages along both kinds of edges until they settle.
Stretches of plain words have constant potentials: a stretch of n of them is one edge
whose potential is the n-th power of the transition matrix, so the chain over the whole
text costs what its few unusual tokens cost. Weights are learned here, by
pseudo-likelihood on generated sentences.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import pieces, prefix_hash, runs, span_hash
from .scratch import text_pass

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "NAME")
SCHEMA = "doc_id long, start int, end int, label string, probability double"
#: Log-potential of O over every other label for a plain word.
PLAIN = 8.0
#: A name needs this probability; without a list of names, capitals alone are weak evidence.
SURE_NAME = 0.8
#: Share of the evidence against a bare capital that an equal token's being a name makes up for.
NAME_AGREEMENT = 0.95
#: Stretches of more plain words than this have the same potential to the last bit.
LONGEST_GAP = 40

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIELD = np.zeros(256, np.uint64)  # packed counters: digits, at signs, lower-case or high bytes
_FIELD[48:58] = 1
_FIELD[64] = 1 << 16
_FIELD[97:123] = 1 << 32
_FIELD[128:256] = 1 << 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_TRIM = "\"'`[]{}<>,;:!?.#$%&*|=~^_/\\«»“”„"
_CUES = {
    "mail": "email e-mail mail contact write kontakt courriel correo",
    "phone": "phone tel telephone call fax mobile cell ring telefon tél téléphone teléfono handy",
    "net": "ip host server address login connected adresse serveur servidor",
    "card": "card visa credit mastercard account konto karte carte tarjeta cuenta iban",
    "ssn": "ssn social security insurance",
    "title": "mr mrs ms dr prof herr frau mme monsieur madame señor señora sr sra",
    "count": "version release page chapter section no year order article license v item total",
}
_CUE = {w: k for k, words in _CUES.items() for w in words.split()}
_SHAPES = tuple(
    (n, re.compile(p))
    for n, p in {
        "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "ip4": r"(?:\d{1,3}\.){3}\d{1,3}", "ip6": r"(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{0,4}", "cc": r"\+\d{1,3}", "area": r"\(0?\d{2,4}\)", "local": r"\d{3}[-.]\d{4}", "full": r"(?:\+?\d{1,3}[-.])?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}", "plus": r"\+\d{7,15}",
        "ssn": r"\d{3}-\d{2}-\d{4}", "four": r"\d{4}", "fours": r"(?:\d{4}[- ]){3}\d{1,7}", "digits": r"\d+", "decimal": r"\d+[.,]\d+", "dotted": r"v?\d+(?:\.\d+)+", "date": r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", "time": r"\d{1,2}:\d{2}(?::\d{2})?", "hex": r"(?=.*[a-f])(?=.*\d)[0-9a-f]{8,}", "mixed": r"(?=.*[A-Za-z])(?=.*\d)[\w.-]+", "capital": r"[A-ZÀ-Þ][a-zß-ÿ'’-]+", "percent": r"[\d.,]+%",
    }.items()
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@lru_cache(maxsize=50_000)
def shape_features(core: str) -> tuple[str, ...]:
    """Features of a token's own text."""
    out = [n for n, p in _SHAPES if p.fullmatch(core)]
    digits = re.sub(r"\D", "", core)
    if digits:
        n = len(digits)
        out.append("n" + ("1-2" if n < 3 else str(n) if n < 5 else "5-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-19" if n < 20 else "20+"))
        if 13 <= n <= 19 and not re.search(r"[A-Za-z]", core):
            out.append("card-size")
            if _luhn(digits):
                out.append("luhn")
    if "ip4" in out and all(int(p) < 256 for p in core.split(".")):
        out.append("octets")
    if "@" in core and "email" not in out:
        out.append("at")
    return tuple(out)


def context_features(before: str, after: str) -> tuple[str, ...]:
    """Features of the tokens next to one."""
    out = []
    for side, word in (("<", before), (">", after)):
        cue = _CUE.get(word.lower().strip(_TRIM + "()"))
        if cue:
            out.append(side + cue)
        out.extend(side + f for f in shape_features(word.strip(_TRIM)) if f in ("cc", "area", "local", "four", "capital", "digits"))
    return tuple(out)


@dataclass
class Tokens:
    """Unusual tokens of a piece of text: row, place, plain tokens before each (-1 at a row's start), text and features.

    ``same`` has the equal tokens of each text, ``alike`` the places in ``same`` of those
    that are similar; ``skips`` joins each to the one before, for learning.
    """

    row: list[int]
    start: list[int]
    end: list[int]
    gap: list[int]
    core: list[str]
    features: list[tuple[str, ...]]
    skips: list[tuple[int, int, int]]
    same: list[list[int]]
    alike: list[list[int]]


def unusual(buf: np.ndarray, off: np.ndarray) -> Tokens:
    """The tokens that may be personal data, and those of the same text as a name that may be."""
    out = Tokens([], [], [], [], [], [], [], [], [])
    starts, ends, rows = runs(~_SPACE[buf], off)
    if not len(starts):
        return out
    fields = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_FIELD[buf], out=fields[1:])
    count = fields[ends] - fields[starts]
    special = (count & np.uint64(0xFFFFFFFF)) > 0
    head = buf[starts]
    follow = buf[np.minimum(starts + 1, len(buf) - 1)]
    capital = (_UPPER[head] & (ends - starts > 1) & ((follow >= 97) & (follow < 123) | (follow >= 0xC3))) | ((head == 0xC3) & (follow < 0x9F))
    first = np.ones(len(starts), bool)
    first[1:] = (rows[1:] != rows[:-1]) | _STOP[buf[ends[:-1] - 1]] | (buf[np.maximum(starts[1:] - 1, 0)] == 10) | ~((buf[starts[:-1]] >= 97) | _UPPER[buf[starts[:-1]]] | (buf[starts[:-1]] >= 48) & (buf[starts[:-1]] < 58))
    at = np.flatnonzero(first & capital & np.append(False, capital[:-1] | (ends[:-1] - starts[:-1] <= 5)))  # after a title with a full stop, as in "Dr. Reed"
    for i in at.tolist():
        if _CUE.get(buf[starts[i - 1] : ends[i - 1]].tobytes().decode("utf-8", "replace").lower().strip(_TRIM)) == "title" and rows[i] == rows[i - 1]:
            first[i] = False
    name = capital & ~first & ~special
    node = special | name
    if name.any():
        sums = prefix_hash(buf)
        trimmed = ends - np.isin(buf[ends - 1], np.frombuffer(b".,;:!?'\")", np.uint8))
        hashes = span_hash(sums, starts, np.maximum(trimmed, starts + 1)) ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        node |= capital & np.isin(hashes, hashes[name])
    known: dict[tuple, int] = {}
    previous, row = -1, -1
    word = lambda i: buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
    for i in np.flatnonzero(node).tolist():
        r = int(rows[i])
        if r != row:
            known, previous, row = {}, -1, r
        text = word(i)
        spans, parts = [], [(m.start(), m.end()) for m in re.finditer(r"[^:=,;|<>\"]+", text)] if special[i] and not _SHAPES[2][1].fullmatch(text.strip(_TRIM)) else [(0, len(text))]
        for a, b in parts:
            while a < b and text[a] in _TRIM:
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if b > a and text[a] == "(" and (")" not in text[a:b] or "@" in text[a:b]):
                a += 1
            if b > a and text[b - 1] == ")" and "(" not in text[a:b]:
                b -= 1
            if b > a and (not special[i] or re.search(r"[\d@]", text[a:b])):
                spans.append((a, b))
        before = word(i - 1) if i and rows[i - 1] == r else ""
        after = word(i + 1) if i + 1 < len(starts) and rows[i + 1] == r else ""
        for k, (a, b) in enumerate(spans):
            core = text[a:b]
            base = int(starts[i])
            n = len(out.row)
            out.row.append(r)
            out.start.append(base + len(text[:a].encode()))
            out.end.append(base + len(text[:b].encode()))
            out.gap.append(0 if k else i - previous - 1 if previous >= 0 else -1)
            out.core.append(core)
            left = text[spans[k - 1][0] : spans[k - 1][1]] if k else text[:a].strip(_TRIM) or before
            out.features.append(shape_features(core) + context_features(left, after) + (("first",) if first[i] and not special[i] else ()) + ("bias",))
            seen = known.get(("same", core.lower()))
            beside = seen == n - 1 and out.gap[n] == 0  # neighbours have their edge already
            if seen is None:
                known["group", core.lower()] = len(out.same)
                out.same.append([n])
            elif not beside:
                out.skips.append((seen, n, 0))
                out.same[known["group", core.lower()]].append(n)
            digits = re.sub(r"\D", "", core)
            alike = ("digits", digits[-7:]) if len(digits) >= 7 else ("mail", core.lower().partition("@")[0]) if "@" in core else ("stem", core.lower().rstrip("s'")) if len(core) > 3 else None
            if alike and seen is None:
                if alike in known:
                    out.skips.append((known[alike], n, 1))
                    out.alike[known["alike", alike]].append(len(out.same) - 1)
                else:
                    known["alike", alike] = len(out.alike)
                    out.alike.append([len(out.same) - 1])
            known["same", core.lower()] = n
            if alike:
                known[alike] = n
            previous = i
    return out


@dataclass
class SkipChainCrf:
    """Feature weights, transitions between neighbouring tokens, and what agreeing on each label adds on equal and on similar tokens."""

    index: dict[str, int]
    weights: np.ndarray
    transition: np.ndarray
    skip: np.ndarray

    def gap_potentials(self) -> np.ndarray:
        """Potential of an edge over 0, 1, ... plain words."""
        step = np.exp(self.transition)
        plain = np.exp(np.array([0.0] + [-PLAIN] * (len(LABELS) - 1)))
        out = [step]
        for _ in range(LONGEST_GAP):
            m = out[-1] @ (plain[:, None] * step)
            out.append(m / m.max())
        return np.array(out)

    def unary(self, features: list[tuple[str, ...]]) -> np.ndarray:
        rows = [(i, self.index[f]) for i, fs in enumerate(features) for f in fs if f in self.index]
        out = np.zeros((len(features), len(LABELS)))
        if rows:
            r, f = np.array(rows).T
            np.add.at(out, r, self.weights[f])
        return out

    def marginals(self, unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
        """Beliefs by (loopy) message passing; edge e joins its two nodes with ``potentials[e]``. Exact where the edges form no cycle.

        After each round only the edges whose messages may still change are gone through,
        until there are none; ``rounds`` ends graphs that never settle.
        """
        n, k = unary.shape
        node = np.maximum(unary - unary.max(1, keepdims=True), -690.0)
        if len(edges):
            source, sink = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            psi = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.full((len(source), k), 1 / k)
            node = node + np.bincount(sink, minlength=n)[:, None] * np.log(1 / k)
            act = np.arange(len(source))
            for turn in range(rounds):
                away = node[source[act]] - np.log(message[back[act]])
                away = np.exp(away - away.max(1, keepdims=True))
                new = np.einsum("ei,eij->ej", away, psi[act]) + 1e-300
                new /= new.sum(1, keepdims=True)
                if turn >= 12:
                    new = 0.5 * new + 0.5 * message[act]  # damped where loops keep it from settling
                moved = np.abs(new - message[act]).max(1) >= tolerance
                np.add.at(node, sink[act], np.log(new) - np.log(message[act]))
                message[act] = new
                if not moved.any():
                    break
                again = np.zeros(len(source), bool)
                again[act[moved]] = True
                touched = np.zeros(n, bool)
                touched[sink[act[moved]]] = True
                act = np.flatnonzero(touched[source] | again)
        belief = np.exp(node - node.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def to_hub(self) -> np.ndarray:
        """Potentials between a token and the hidden node of its kind (equal, similar): two of them in a row are the potential of an edge."""
        values, vectors = np.linalg.eigh(np.exp(self.skip[:, :, None] * np.eye(len(LABELS))))
        return np.maximum((vectors * np.sqrt(np.maximum(values, 0))[:, None, :]) @ vectors.transpose(0, 2, 1), 1e-12)

    def label(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Label and its probability of each token."""
        gaps = np.array(t.gap, np.int64)
        chain = np.flatnonzero(gaps >= 0)
        n = len(gaps)
        if not n:
            return gaps, np.zeros(0)
        hubs, joins, stand = n, [], [g[0] for g in t.same]
        for i, group in enumerate(t.same):
            if len(group) > 1:
                joins.extend((x, hubs, 0) for x in group)
                stand[i], hubs = hubs, hubs + 1
        for group in t.alike:
            if len(group) > 1:
                joins.extend((stand[i], hubs, 1) for i in group)
                hubs += 1
        edges, between = np.stack([chain - 1, chain], 1), self.gap_potentials()[np.minimum(gaps[chain], LONGEST_GAP)]
        if joins:
            s = np.array(joins)
            edges, between = np.concatenate([edges, s[:, :2]]), np.concatenate([between, self.to_hub()[s[:, 2]]])
        every, name = self.marginals(np.concatenate([self.unary(t.features), np.zeros((hubs - n, len(LABELS)))]), edges, between), LABELS.index("NAME")
        p = every[:n]
        best = p.argmax(1)
        sure = p[np.arange(n), best]
        shared = np.zeros(n)
        for group, at in zip(t.same, stand):
            if at >= n:
                shared[group] = every[at, name]
        # a hidden node is sure of a name only where some mention has evidence of its own; then all mentions are the name
        agreed = (shared >= SURE_NAME) & np.isin(best, (0, name)) & ((best == 0) | (sure < shared))
        best, sure = np.where(agreed, name, best), np.where(agreed, shared, sure)
        return np.where((best == name) & (sure < SURE_NAME), 0, best), sure

    def spans(self, column: pa.Array) -> Iterator[tuple[int, int, int, str, float]]:
        """(row, first byte, end byte, label, probability) of personal data in a column of texts; neighbouring tokens of one label are one span."""
        for lo, _, buf, off in pieces(column):
            t = unusual(buf, off)
            best, p = self.label(t)
            held: list | None = None
            for i in np.flatnonzero(best).tolist():
                label, row = LABELS[best[i]], t.row[i] + lo
                start, end = t.start[i] - int(off[t.row[i]]), t.end[i] - int(off[t.row[i]])
                if held and t.gap[i] == 0 and held[5] == i - 1 and held[0] == row and held[3] == label and (label in ("PHONE", "NAME") or label == "CARD" and held[2] - held[1] < 15 and end - start < 13):
                    held = [row, held[1], end, label, min(held[4], float(p[i])), i]
                    continue
                if held:
                    yield tuple(held[:5])
                held = [row, start, end, label, float(p[i]), i]
            if held:
                yield tuple(held[:5])


_FIRST = "Anna Ben Carla David Elena Felix Greta Hugo Irene Jonas Klara Liam Maria Nora Oscar Paula Quentin Rosa Simon Tessa".split()
_LAST = "Abbott Becker Castillo Dubois Ellison Fischer Garcia Hofmann Iverson Jansen Keller Lefevre Moreno Novak Ortega Petit Quinn Reed Schuster Thorne".split()
_FILL = "the of and to in that was it for with on as by der die und le la de que el en los avec mit were often found small new work time week last made read sent near".split()


def generated(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with personal data and with harmless numbers and capitals, and the places (in characters) and labels of the former."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def word() -> str:
        return r.choice(_FILL) if r.random() < 0.5 else "".join(r.choice(["an", "er", "st", "ion", "el", "ou", "ti", "re", "ch", "é", "ü"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        d = digits(15)
        d = d + next(c for c in "0123456789" if _luhn(d + c)) if r.random() < 0.5 else digits(16)
        return d if r.random() < 0.7 else " ".join(d[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.5 else "-".join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49{a}{b}{c}", f"{b}-{c}", f"+1-{a}-{b}-{c}"])

    make = {
        "EMAIL": lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com" if r.random() < 0.5 else f"{r.choice(_FIRST).lower()}.{r.choice(_LAST).lower()}@{r.choice(['mail', 'post', 'corp'])}.example.{r.choice(['com', 'org', 'net'])}",
        "PHONE": phone, "IP": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "CARD": card, "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "NAME": lambda: r.choice(_LAST) if r.random() < 0.4 else f"{r.choice(_FIRST)} {r.choice(_LAST)}",
    }
    cue = {"EMAIL": "mail", "PHONE": "phone", "IP": "net", "CARD": "card", "SSN": "ssn"}
    harmless = [lambda: str(r.randint(1, 2100)), lambda: f"{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{digits(4)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"{r.randint(1, 99)}%", lambda: digits(r.randint(5, 9)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"CC-{digits(1)}.0", lambda: r.choice(["Berlin", "Monday", "Apache", "License", "Public", "General", "Paris", "Version"]), lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}.{r.randint(300, 999)}"]
    def capital(common: list[str]) -> str:
        """A capital word that is no name; it too may come again."""
        common.append(r.choice(common) if common and r.random() < 0.5 else word().capitalize())
        return common[-1]

    out = []
    for _ in range(n):
        text, spans, names, common = "", [], [], []
        kinds = r.sample(list(make), r.randint(0, 3))
        for _ in range(r.randint(2, 8)):
            text += " ".join(capital(common) if r.random() < 0.15 else word() for _ in range(r.randint(1, 9))) + " "
            if r.random() < 0.5 and kinds:
                label = r.choice(kinds)
                again = [s for s in names if s[0] == label]
                value = r.choice(again)[1] if again and r.random() < 0.6 else make[label]()
                if label == "NAME" and (not again or r.random() < 0.4):
                    text += r.choice(["Mr. ", "Dr. ", "Frau ", "Herr ", "Mme ", "Prof. ", "Mrs. ", "Señor "])
                elif label in cue and r.random() < 0.3:
                    text += r.choice(_CUES[cue[label]].split()) + r.choice([": ", " "])
                names.append((label, value))
                spans.append((len(text), len(text) + len(value), label))
                text += value
            elif r.random() < 0.5:
                text += " ".join(capital(common) for _ in range(r.randint(1, 3))) if r.random() < 0.6 else r.choice(harmless)()
            text += r.choice([" ", " ", ", ", ". ", ".\n", "### ", "$$$ ", " | "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(texts: int = 1500, steps: int = 250, l2: float = 1e-3) -> SkipChainCrf:
    """Weights that maximise the pseudo-likelihood (each token given its neighbours' true labels) of generated texts."""
    data = generated(texts)
    column = pa.array([t for t, _ in data], pa.large_string())
    index: dict[str, int] = {}
    cols, ys, near, skips = [], [], [], []
    for lo, _, buf, off in pieces(column):
        t = unusual(buf, off)
        y = np.zeros(len(t.row), np.int64)
        for i, (row, start) in enumerate(zip(t.row, t.start)):
            text, spans = data[lo + row]
            at = len(buf[off[row] : start].tobytes().decode())
            y[i] = next((LABELS.index(s[2]) for s in spans if s[0] <= at < s[1]), 0)
        base = sum(map(len, ys))
        for i, fs in enumerate(t.features):
            cols.extend((base + i, index.setdefault(f, len(index))) for f in fs)
        gaps = np.array(t.gap)
        before = np.where(gaps == 0, np.append(0, y[:-1]), np.where(gaps < 0, -1, 0))  # -1: none; plain words are O
        after = np.append(np.where(gaps[1:] == 0, y[1:], 0), 0)
        near.append(np.stack([before, after], 1))
        skips.append(np.array([(a + base, b + base, k) for a, b, k in t.skips], np.int64).reshape(-1, 3))
        ys.append(y)
    y, near, skips = np.concatenate(ys), np.concatenate(near), np.concatenate(skips)
    n, k, f = len(y), len(LABELS), len(index)
    x = np.zeros((n, f))
    x[tuple(np.array(cols).T)] = 1
    onehot = np.eye(k + 1)
    before, after, truth = onehot[near[:, 0]][:, :k], onehot[near[:, 1]][:, :k], np.eye(k)[y]
    agree = np.zeros((2, n, k))
    for a, b, kind in skips:
        agree[kind, a, y[b]] += 1
        agree[kind, b, y[a]] += 1
    w, tr, sk = np.zeros((f, k)), np.zeros((k, k)), np.zeros((2, k))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, tr, sk)]
    for step in range(1, steps + 1):
        s = x @ w + before @ tr + after @ tr.T + (agree * sk[:, None, :]).sum(0)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - truth) / n
        grads = (x.T @ e + l2 * w / 10, before.T @ e + e.T @ after + l2 * tr / 10, (agree * e).sum(1) + l2 * sk / 10)
        for v, g, m in zip((w, tr, sk), grads, moments):  # Adam
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            v -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    sk = np.maximum(sk, 0)
    # agreeing on a name may cancel what speaks against a bare capital, but not outweigh it: without other evidence repetition makes no name
    o, name, bare = 0, LABELS.index("NAME"), w[index["capital"]] + w[index["bias"]]
    margin = bare[o] - bare[name] + 2 * tr[o, o] - tr[o, name] - tr[name, o]
    sk[:, name] = np.minimum(sk[:, name], sk[:, o] + NAME_AGREEMENT * max(0.0, margin))
    # what counts is agreeing on a label rather than on none, so that many plain mentions don't outvote the one that tells
    sk = np.maximum(sk - sk[:, [o]], 0)
    return SkipChainCrf(index, w, tr, sk)


def find_pii(docs: DataFrame, model: SkipChainCrf | None = None) -> DataFrame:
    """Personal data in every text: (doc_id, start, end, label, probability), places in characters.

    One narrow pass. Null and empty texts and an empty table give no rows; a null id is
    passed through; repeated rows give repeated findings; a document's whole text is one
    graph, whatever its length; other columns are not read.
    """
    model = model or trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for row, start, end, label, p in model.spans(texts):
                text = texts[row].as_py().encode()
                first = len(text[:start].decode("utf-8", "replace"))
                rows.append((row, first, first + len(text[start:end].decode("utf-8", "replace")), label, round(p, 6)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.float64()), 1))],
                names=["doc_id", "start", "end", "label", "probability"],
            )

    return text_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, SCHEMA)


def redact(docs: DataFrame, model: SkipChainCrf | None = None) -> DataFrame:
    """``docs`` with personal data replaced by its label in brackets, and n_chars (where there is one) made to fit; other texts and all other columns as they were.

    Null and empty texts and rows with a null id go through like others; repeated rows are
    redacted alike; an empty table stays empty.
    """
    model = model or trained()
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            found: dict[int, list] = {}
            for row, start, end, label, _ in model.spans(column):
                found.setdefault(row, []).append((start, end, label))
            if found:
                texts = column.to_pylist()
                for row, spans in found.items():
                    text, parts, last = texts[row].encode(), [], 0
                    for start, end, label in spans:
                        parts += [text[last:start], f"[{label}]".encode()]
                        last = end
                    texts[row] = b"".join([*parts, text[last:]]).decode("utf-8", "replace")
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if size is not None:
                    counts = batch.column(size).to_pylist()
                    for row in found:
                        counts[row] = len(texts[row])
                    arrays[size] = pa.array(counts, batch.schema.field(size).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return text_pass(docs, run, docs.schema)
