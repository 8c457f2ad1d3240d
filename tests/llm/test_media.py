import base64
import gzip
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import pytest

from loomtext.llm import media as M


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def wav():
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\1\2" * 40)
    return f.getvalue()


def zipped():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return f.getvalue()


SAMPLES = {
    "image/png": png(), "audio/wav": wav(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 500),
    "image/gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0\x3f\0\x12\xff\0\x34\xff\xd9",
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
    "image/bmp": b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "audio/ogg": b"OggS\0\6" + b"\0" * 20 + b"\1\5abcde",
    "video/mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov"),
    "application/wasm": b"\0asm\1\0\0\0\1\4\1\x60\0\0",
}


def brute(data):
    """Every format tried at every offset."""
    out, at = [], 0
    while at < len(data):
        ends = [(f[3](data, at + f[1]), f[2]) for f in M.BINARY if data.startswith(f[0], at + f[1])]
        ends = [x for x in ends if x[0]]
        if ends:
            out.append((ends[0][1], at, ends[0][0] - at))
            at = ends[0][0]
        else:
            at += 1
    return out


@pytest.mark.parametrize("kind", SAMPLES)
def test_formats(kind):
    found, data = M.automaton(), SAMPLES[kind]
    assert M.sniff(data, found)[:2] == (kind, True)
    assert M.sniff(data + b"tail", found)[:2] in ((kind, False),)
    cut = M.sniff(data[: len(data) - 3], found)[0]
    assert cut is None, "truncated data isn't of its type"
    assert [(x[0], x[2], x[4], x[5]) for x in M.sniff(b"junk " + data + b" more", found)[2] if x[5] is None] == [(kind, 5, data, None)]


def test_carving_against_brute_force():
    rng, found = random.Random(4), M.automaton()
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice([*SAMPLES.values(), bytes(rng.randrange(256) for _ in range(rng.randint(0, 60))), b"BM", b"PK\3\4 RIFF GIF8"]))
        data = b"?" + b"".join(parts)
        assert [(t, s, n) for t, _, s, n, _, parent in M.sniff(data, found)[2] if parent is None] == brute(data)


def test_media_within_media():
    found, inner = M.automaton(), png()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.png", inner)
        z.writestr("b.wav", SAMPLES["audio/wav"])
    archive = buffer.getvalue()
    kind, whole, media = M.sniff(archive, found)
    assert (kind, whole) == ("application/zip", True)
    assert [(t, archive[s : s + n], p) for t, _, s, n, _, p in media] == [("image/png", inner, None), ("audio/wav", SAMPLES["audio/wav"], None)]
    uri = b"<html><img src='data:application/zip;base64," + base64.b64encode(archive) + b"'>" + SAMPLES["image/bmp"]
    kind, _, media = M.sniff(uri, found)
    assert kind == "text/html"
    assert [(t, d, p) for t, d, _, _, _, p in media] == [("application/zip", "application/zip", None), ("image/png", None, 0), ("audio/wav", None, 0), ("image/bmp", None, None)]
    assert media[1][4] == inner == archive[media[1][2] : media[1][2] + media[1][3]]


def test_hostile_values_take_linear_time():
    found = M.automaton()
    began = time.time()
    M.sniff(b"PK\3\4" * 200_000 + b"PK\5\6" * 50_000, found)
    assert time.time() - began < 5


def test_planted_query(spark, tmp_path):
    rows = [(1, "u", "<html>é</html>"), (2, "u", ""), (3, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = M.planted(spark, str(tmp_path)).filter("page_id = 1").collect()
    want = duckdb.sql(M.PLANTED_SQL).filter("page_id = 1").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 4


def test_column(spark):
    uri = b"<p><img src='data:image/gif;base64," + base64.b64encode(png()) + b"'>"
    data = [(1, png(), "image/JPEG "), (2, b"<!doctype html>" + uri, "text/html"), (3, None, "image/png"), (4, b"", None), (5, b"plain", "text/plain"), (6, b"x" * 3_000_000 + png(), None), (1, png(), "image/JPEG ")]
    df = spark.createDataFrame([(*d, "x") for d in data], "id int, content binary, said string, embedded string").selectExpr("*", "2 AS found", "3 AS `a.b`")
    rows = M.media_columns(df, "content", "said").collect()
    one, html, null, empty, plain, big, again = rows
    assert one == again and (one.media_type, one.corrected, one.whole, one.embedded_in) == ("image/png", True, True, "x")
    assert html.media_type == "text/html" and not html.corrected
    (inner,) = html.embedded
    assert (inner.type, inner.declared, bytes(inner.content)) == ("image/png", "image/gif", png())
    assert (null.media_type, null.sniffed, null.corrected, null.n_bytes) == ("image/png", None, None, None)
    assert empty.sniffed is None and empty.corrected is False and plain.media_type == "text/plain"
    assert big.embedded[0].start == 3_000_000
    assert M.media_columns(df.limit(0), "content", "said").collect() == []
