"""Media columns: what a blob really is, and what media lie inside it.

One Aho-Corasick pass over a blob finds all magic bytes of all formats, wherever they
are. At each of them the format's validator reads the structure that must follow
(chunks, segments, boxes, length fields, check sums) and gives the length of a whole
object, or nothing. A valid object at the start corrects the declared type; others are
carved out, also from base64 in data URIs.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import text_pass

SCHEMA = "media_id long, at int, length int, declared string, sniffed string, action string, nested boolean"


def _png(b: bytes, i: int) -> int | None:
    p = i + 8
    first = True
    while p + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        end = p + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack(">I", b[end - 4 : end])[0]:
            return None
        if kind == b"IEND":
            return end - i
        p, first = end, False
    return None


def _gif(b: bytes, i: int) -> int | None:
    if i + 13 > len(b) or b[i : i + 6] not in (b"GIF87a", b"GIF89a"):
        return None
    p = i + 13 + (3 << ((b[i + 10] & 7) + 1) if b[i + 10] & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            if not b[p]:
                return p + 1
            p += b[p] + 1
        return None

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - i
        if b[p] == 0x21:
            q = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            q = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
        if q is None:
            return None
        p = q
    return None


def _jpeg(b: bytes, i: int) -> int | None:
    p, frame = i + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 - i if frame else None
        if 0xD0 <= kind <= 0xD7 or kind in (0x00, 0x01, 0xD8):
            return None
        n = struct.unpack(">H", b[p + 2 : p + 4])[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next marker that isn't a stuffed byte or a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 - i if frame and b[p : p + 2] == b"\xff\xd9" else None


def _riff(b: bytes, i: int) -> int | None:
    if i + 12 > len(b) or b[i + 8 : i + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    end = i + 8 + struct.unpack("<I", b[i + 4 : i + 8])[0]
    p = i + 12
    if end > len(b) or p >= end:
        return None
    while p + 8 <= end:
        n = struct.unpack("<I", b[p + 4 : p + 8])[0]
        p += 8 + n + (n & 1)
    return end - i if p in (end, end + 1) else None


def _pdf(b: bytes, i: int) -> int | None:
    if not re.match(rb"%PDF-\d\.\d", b[i : i + 8]):
        return None
    nxt = b.find(b"%PDF-", i + 5)
    end = b.rfind(b"%%EOF", i, nxt if nxt >= 0 else len(b))  # no further than the next document, so a blob is gone through once
    if end < 0 or b.find(b"startxref", i, end) < 0:
        return None
    return end + 5 - i


@lru_cache(maxsize=1)
def _archives(b: bytes) -> dict[int, int]:
    """Start and length of each archive: its directory's end says where it starts."""
    out: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, start = struct.unpack("<II", b[end + 12 : end + 20])
        stop = end + 22 + struct.unpack("<H", b[end + 20 : end + 22])[0]
        i = end - size - start
        if i >= 0 and b[i + start : i + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and stop <= len(b):
            out.setdefault(i, stop - i)
        end = b.find(b"PK\x05\x06", end + 4)
    return out


def _zip(b: bytes, i: int) -> int | None:
    return _archives(b).get(i) if i + 30 <= len(b) else None


def _gzip(b: bytes, i: int) -> int | None:
    if i + 18 > len(b) or b[i + 2] != 8 or b[i + 3] & 0xE0:
        return None
    try:
        d = zlib.decompressobj(31)
        view, total = memoryview(b)[i:], 0
        for k in range(0, len(view), 1 << 16):
            d.decompress(view[k : k + (1 << 16)])
            total = min(len(view), k + (1 << 16))
            if d.eof:
                return total - len(d.unused_data)
    except zlib.error:
        return None
    return None


def _bmp(b: bytes, i: int) -> int | None:
    if i + 54 > len(b):
        return None
    size, gap, data, header = struct.unpack("<IIII", b[i + 2 : i + 18])
    return size if not gap and header in (40, 52, 56, 108, 124) and 14 + header <= data <= size and i + size <= len(b) else None


def _ogg(b: bytes, i: int) -> int | None:
    p = i
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        segments = b[p + 26]
        if p + 27 + segments > len(b):
            return None
        end = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if end > len(b):
            return None
        last = b[p + 5] & 4
        p = end
        if last:
            return p - i
    return None


def _mp4(b: bytes, i: int) -> int | None:
    p, seen = i, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"sidx", b"styp", b"mfra", b"udta", b"meta", b"uuid", b"pdin"):
            break
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack(">Q", b[p + 8 : p + 16])[0]
        if n < 8 or p + n > len(b):
            return None
        seen.add(kind)
        p += n
    return p - i if b"ftyp" in seen and seen & {b"moov", b"mdat", b"moof"} else None


def _html(b: bytes, i: int) -> int | None:
    if b[:i].strip(b" \t\r\n\xef\xbb\xbf"):
        return None
    end = b.rstrip()
    return len(b) - i if re.fullmatch(rb"</(?:html|body)\s*>", end[max(0, end.rfind(b"<")) :], re.I) else None


#: (media type, magic bytes, bytes before the magic, validator)
FORMATS: tuple[tuple[str, bytes, int, Callable[[bytes, int], int | None]], ...] = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png), ("image/gif", b"GIF87a", 0, _gif), ("image/gif", b"GIF89a", 0, _gif), ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("riff", b"RIFF", 0, _riff), ("application/pdf", b"%PDF-", 0, _pdf), ("application/zip", b"PK\x03\x04", 0, _zip), ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("image/bmp", b"BM", 0, _bmp), ("audio/ogg", b"OggS\0", 0, _ogg), ("video/mp4", b"ftyp", 4, _mp4),
    ("text/html", b"<!DOCTYPE html", 0, _html), ("text/html", b"<!doctype html", 0, _html), ("text/html", b"<html", 0, _html),
)
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
#: Line breaks may cut the base64; another blank ends it.
_URI = re.compile(rb"data:([\w.+-]+/[\w.+-]+)?(?:;[\w=.-]+)*;base64,([A-Za-z0-9+/]*(?:[ \t]*[\r\n]\s*[A-Za-z0-9+/]+)*(?:(?:[ \t]*[\r\n]\s*)?=){0,2})")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (_, magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.add_word("data:", -1)
    a.make_automaton()
    return a


def objects(blob: bytes) -> list[tuple[int, int, str]]:
    """(place, length, type) of the valid objects that no longer one (or, of equals, an earlier format) contains; also (place, -1, "") of data URIs."""
    places, uris = [], []
    for end, k in _automaton().iter(blob.decode("latin-1")):
        if k < 0:
            uris.append((end - 4, -1, ""))
        elif (at := end + 1 - len(FORMATS[k][1]) - FORMATS[k][2]) >= 0:
            places.append((at, k))
    out, reach = [], -1
    for at, same in groupby(sorted(places), key=lambda p: p[0]):
        if at < reach:
            continue  # inside a valid object; not even looked at, so that archives of many entries cost no more than others
        valid = [(n, -k) for _, k in same if (n := FORMATS[k][3](blob, at))]
        if valid:
            n, k = max(valid)
            kind = FORMATS[-k][0]
            out.append((at, n, _RIFF[blob[at + 8 : at + 12]] if kind == "riff" else kind))
            reach = at + n if kind != "text/html" else at + 1  # a page is text around what it embeds
    return sorted(out + uris)


def _decoded(payload: bytes) -> bytes | None:
    """Bytes of base64 that lines may cut; where the lines together can't be read, those of the first line, which other text follows."""
    for part in (re.sub(rb"\s", b"", payload), (payload.split() or [b""])[0]):
        try:
            return base64.b64decode(part, validate=True)
        except (binascii.Error, ValueError):
            continue
    return None


def sniff(blob: bytes | None, declared: str | None, offset: int = 0, nested: bool = False) -> Iterator[tuple]:
    """Rows (at, length, declared, sniffed, action, nested) of one blob, and of what its data URIs hold, however deep. ``at`` of what a data URI holds is the URI's place."""
    said = declared.strip().lower().partition(";")[0] if declared else None
    if not blob:
        yield offset, 0, declared, None, "missing" if blob is None else "empty", nested
        return
    found = objects(blob)
    own = next((f for f in found if f[1] > 0 and not blob[: f[0]].strip()), None)
    if own:
        kind = own[2]
        whole = own[0] + own[1] >= len(blob.rstrip()) or kind == "text/html"
        yield offset, len(blob), declared, kind, ("kept" if said == kind else "corrected") if whole else "trailing", nested
    else:
        yield offset, len(blob), declared, None, "unknown", nested
    for at, n, kind in found:
        if n < 0:
            m = _URI.match(blob, at)
            if m:
                inner = _decoded(m[2])
                if inner is None:
                    yield offset + at, m.end() - at, m[1].decode("latin-1") if m[1] else None, None, "broken", True
                    continue
                yield from sniff(inner, m[1].decode("latin-1") if m[1] else None, offset + at, True)
        elif own is None or at != own[0]:
            yield offset + at, n, None, kind, "carved", nested


def sniff_media(blobs: DataFrame, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """True types and embedded media of a column of blobs: (media_id, at, length, declared, sniffed, action, nested).

    Each blob has one row for itself, whose action is kept (the declared type is right),
    corrected, trailing (valid, with other bytes after it), unknown, empty or missing
    (null); and one row for each object carved from it or from a data URI in it (broken:
    the URI's base64 can't be read). One narrow pass; a string column is read as its
    UTF-8 bytes. A null id is passed through, repeated rows give repeated results, an
    empty table gives no rows, blobs are read whole, other columns are not read.
    """
    from pyspark.sql import functions as F

    declared = blobs[declared_col].cast("string") if declared_col else F.lit(None).cast("string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        names = ["media_id", "at", "length", "declared", "sniffed", "action", "nested"]
        for batch in batches:
            rows = [(i.as_py(), *r) for i, b, d in zip(*batch.columns) for r in sniff(b.as_py(), d.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return text_pass(blobs.select(blobs[id_col].cast("long").alias("media_id"), blobs[blob_col].cast("binary").alias("blob"), declared.alias("declared")), run, SCHEMA)


def page_media(pages: DataFrame) -> DataFrame:
    """``sniff_media`` of the html column of pages, with the type that the URL's ending declares.

    A null URL declares nothing, and a null html is missing; null ids, repeated rows,
    empty tables and other columns are as in ``sniff_media``.
    """
    from pyspark.sql import functions as F

    ending = F.lower(F.regexp_extract(F.split_part("url", F.lit("?"), F.lit(1)), r"\.([A-Za-z0-9]{2,5})(?:#.*)?$", 1))
    known = {"html": "text/html", "htm": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "mp4": "video/mp4", "wav": "audio/wav", "webp": "image/webp", "bmp": "image/bmp", "ogg": "audio/ogg"}
    declared = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[ending]
    return sniff_media(pages.select("page_id", "html", declared.alias("declared")), "page_id", "html", "declared")
