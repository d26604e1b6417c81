import base64
import math
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from mentionary.llm import media, secret_scan
from mentionary.llm.secret_scan import CLASSES, window_entropy


def entropy(s: bytes) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def test_window_entropy_equals_counting_every_window_anew():
    r = random.Random(3)
    for _ in range(200):
        s = bytes(r.choice(b"abcdef0123456789XYZ") for _ in range(r.randint(1, 80)))
        w = min(r.randint(1, 30), len(s))
        assert window_entropy(s, w) == pytest.approx(max(entropy(s[i : i + w]) for i in range(len(s) - w + 1)))
    assert window_entropy(b"", 20) == 0


def brute(text: str) -> set:
    found = []
    for c in CLASSES:
        for m in re.finditer("[" + re.escape(c.chars.decode()) + f"]{{{c.shortest},}}", text):
            b = m[0].encode()
            if all(set(b) & set(n) for n in c.needs) and max(entropy(b[i : i + c.window]) for i in range(max(1, len(b) - c.window + 1))) >= c.threshold and not any(re.compile(a, re.S).fullmatch(m[0]) for a in secret_scan.ALLOW):
                found.append((m.start(), m.end(), c.name))
    found.sort(key=lambda f: (f[0] - f[1], [c.name for c in CLASSES].index(f[2])))
    kept = []
    for f in found:
        if all(f[1] <= g[0] or f[0] >= g[1] for g in kept):
            kept.append(f)
    return set(kept)


def test_findings_equal_brute_force_and_respect_the_allow_list():
    r = random.Random(4)
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(6):
            k = r.randint(0, 5)
            parts.append({0: "plain prose wörds", 1: "".join(r.choice("0123456789abcdef") for _ in range(40)), 2: "".join(r.choice("ABCDEFghijkl0123456789+/") for _ in range(r.randint(18, 60))), 3: "0" * 40, 4: "EXAMPLEkey0a9b8c7d6e5f4a3b2c1", 5: "123e4567-e89b-12d3-a456-426614174000"}[k])
        texts.append(r.choice([" ", "é", '"']).join(parts))
    got = {}
    for doc, s, e, name, _, _ in secret_scan.findings(pa.array(texts), list(range(len(texts)))):
        got.setdefault(doc, set()).add((s, e, name))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute(t)
    assert sum(map(len, got.values())) > 50


def test_secrets_of_awkward_tables(awkward, nothing, spark):
    assert secret_scan.scan_secrets(awkward).count() == 0
    assert secret_scan.scan_secrets(nothing).count() == 0
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.createDataFrame([(1, f"é {key}"), (1, f"é {key}"), (None, key)], "doc_id long, text string")
    rows = secret_scan.scan_secrets(docs).collect()
    assert sorted((r.doc_id or 0, r.start, r.end) for r in rows) == [(0, 0, 40), (1, 2, 42), (1, 2, 42)]
    assert all(key not in r.masked for r in rows)


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
WAV = b"RIFF" + struct.pack("<I", 36 + 4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"\1\2\3\4"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\ntrailer\nstartxref\n9\n%%EOF"
GZIP = zlib.compressobj(wbits=31)
GZIP = GZIP.compress(b"hello hello") + GZIP.flush()
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
MP4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"mdat"


def zipped() -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "audio/wav": WAV, "application/pdf": PDF, "application/gzip": GZIP, "image/bmp": BMP, "audio/ogg": OGG, "video/mp4": MP4, "application/zip": zipped()}


@pytest.mark.parametrize("kind", ALL)
def test_each_format_is_found_alone_inside_others_and_not_when_cut_short(kind):
    blob = ALL[kind]
    assert list(media.sniff(blob, kind)) == [(0, len(blob), kind, kind, "kept", False)]
    assert [r[4] for r in media.sniff(blob, "text/plain")] == ["corrected"]
    inside = b"\0\1 some bytes " + blob + b" and more"
    assert [(r[0], r[1], r[3], r[4]) for r in media.sniff(inside, None)] == [(0, len(inside), None, "unknown"), (14, len(blob), kind, "carved")]
    assert all(r[3] != kind for r in media.sniff(blob[:-2], kind))
    uri = b'<html><img src="data:' + kind.encode() + b";base64," + base64.b64encode(blob) + b'"></html>'
    assert [(r[3], r[4], r[5]) for r in media.sniff(uri, "text/html")] == [("text/html", "kept", False), (kind, "kept", True)]


def test_a_wrong_check_sum_is_no_png_and_every_place_is_tried():
    bad = bytearray(png())
    bad[-1] ^= 1
    blob = bytes(bad) + png() + GIF
    found = [(a, n, k) for a, n, k in media.objects(blob)]
    brute = []
    for at in range(len(blob)):
        for kind, magic, lead, valid in media.FORMATS:
            if blob[at + lead : at + lead + len(magic)] == magic and (n := valid(blob, at)):
                brute.append((at, n, kind))
    assert found == sorted(brute) == [(len(bad), len(bad), "image/png"), (2 * len(bad), len(GIF), "image/gif")]


def test_media_of_awkward_tables(spark):
    rows = [(1, None, None, "x"), (2, b"", "image/png", "x"), (None, png(), "image/gif", None), (3, GIF, None, "x"), (3, GIF, None, "x"), (4, b"data:;base64,A", None, "x"), (5, b"\0" * 300_000 + png(), None, "x")]
    df = spark.createDataFrame(rows, "id long, blob binary, declared string, sniffed string")
    got = sorted((r.media_id or 0, r["at"], r.action) for r in media.sniff_media(df, "id", "blob", "declared").collect())
    assert got == [(0, 0, "corrected"), (1, 0, "missing"), (2, 0, "empty"), (3, 0, "corrected"), (3, 0, "corrected"), (4, 0, "broken"), (4, 0, "unknown"), (5, 0, "unknown"), (5, 300_000, "carved")]
    assert media.sniff_media(df.where("false"), "id", "blob").count() == 0


def test_pages_are_html_unless_they_are_cut_off(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.media_id: r for r in media.page_media(pages).where("at = 0").collect()}
    for p in pages.collect():
        whole = re.match(r"\s*<(?:!doctype )?html", p.html, re.I) and re.search(r"</(?:html|body)\s*>\s*$", p.html, re.I)
        assert (rows[p.page_id].sniffed == "text/html") == bool(whole) and rows[p.page_id].length == len(p.html.encode())
    assert sum(r.sniffed == "text/html" for r in rows.values()) > len(rows) / 2


def test_a_page_may_be_followed_by_any_space_and_uris_may_be_nested_deep():
    page = b"<html><body>x</body></html>" + b" " * 600
    assert [r[3:5] for r in media.sniff(page, "text/html")] == [("text/html", "kept")]
    inner = b"GIF89a\x01\x00\x01\x00\x00\x00\x00;"
    blob = inner
    for _ in range(5):
        blob = b"see data:text/plain;base64," + base64.b64encode(blob) + b" there"
    assert [r[3] for r in media.sniff(blob, None)][-1] == "image/gif"


def test_archives_with_many_entries_are_gone_through_once():
    import io
    import time
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(3000):
            z.writestr(f"f{i}", "x" * 50)
    blob = b"before " + out.getvalue()
    start = time.time()
    assert [(r[0], r[1], r[3]) for r in media.sniff(blob, None)][1:] == [(7, len(blob) - 7, "application/zip")]
    assert list(media.objects(blob[:-30])) == [] and time.time() - start < 5


def test_pages_of_awkward_tables(spark):
    rows = [(1, None, "<html></html>", 1), (1, None, "<html></html>", 1), (None, "a.png", None, 2), (2, "http://x/a.PNG?q=1", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at int")
    got = sorted(((r.media_id or 0), r.declared or "", r.action) for r in media.page_media(pages).collect())
    assert got == [(0, "image/png", "missing"), (1, "", "corrected"), (1, "", "corrected"), (2, "image/png", "empty")]
    assert media.page_media(pages.where("false")).count() == 0
