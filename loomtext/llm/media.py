"""Operator 10, media columns by signature sniffing: an Aho-Corasick automaton locates magic bytes, a validator for each
format confirms structure and length; declared types are corrected and embedded media carved out.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import Guarded, guarded, table

# Each validator takes the bytes and where the format would begin, and returns where it ends, or None.


def png(b: bytes, at: int) -> int | None:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or (first and kind != b"IHDR") or struct.unpack_from(">I", b, end - 4)[0] != zlib.crc32(b[p + 4 : end - 4]):
            return None
        if kind == b"IEND":
            return end
        p, first = end, False
    return None


def jpeg(b: bytes, at: int) -> int | None:
    p, scanned = at + 2, False
    while p + 2 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
        elif kind == 0xD9:
            return p + 2 if scanned else None
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            p += 2
        else:
            if p + 4 > len(b):
                return None
            size = struct.unpack_from(">H", b, p + 2)[0]
            if size < 2 or kind < 0xC0:
                return None
            p += 2 + size
            if kind == 0xDA:
                scanned = True
                while True:  # entropy-coded data: 0xFF is followed by 0 or a restart mark
                    p = b.find(b"\xff", p)
                    if p < 0 or p + 1 >= len(b):
                        return None
                    if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                        p += 2
                    else:
                        break
    return None


def gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b) or b[at + 4] not in b"79" or b[at + 5 : at + 6] != b"a":
        return None

    def table_size(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    p = at + 13 + table_size(b[at + 10])
    images = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 if images else None
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 < len(b):
            images += 1
            p += 11 + table_size(b[p + 9])
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def riff(form: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p = at + 12
        while p + 8 <= end:
            size = struct.unpack_from("<I", b, p + 4)[0]
            p += 8 + size + (size & 1)
        return end if end <= len(b) and end > at + 12 and p in (end, end + 1) else None

    return check


def pdf(b: bytes, at: int) -> int | None:
    if not re.match(rb"%PDF-[12]\.\d", b[at : at + 8]):
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    return end + 5


class Value(bytes):
    """A value that keeps what validators have found out about all of it."""

    @property
    def zip_ends(self) -> dict[int, int]:
        """Where a ZIP archive begins -> where the first one from there ends, by the end records of the value."""
        if "ends" not in self.__dict__:
            ends: dict[int, int] = {}
            p = self.find(b"PK\x05\x06")
            while 0 <= p <= len(self) - 22:
                size, offset, comment = struct.unpack_from("<IIH", self, p + 12)
                if p + 22 + comment <= len(self):
                    ends.setdefault(p - offset - size, p + 22 + comment)
                p = self.find(b"PK\x05\x06", p + 4)
            self.__dict__["ends"] = ends
        return self.__dict__["ends"]


def zip_(b: bytes, at: int) -> int | None:
    return (b if isinstance(b, Value) else Value(b)).zip_ends.get(at)


def gzip_(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    data, view = b"", memoryview(b)
    try:
        data = view[at:]
        while not d.eof:
            d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
            if not data and not d.eof:
                return None
    except zlib.error:
        return None
    return len(b) - len(d.unused_data)


def bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= start <= size or at + size > len(b):
        return None
    return at + size


def ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        if p + 27 + n > len(b):
            return None
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if end > len(b):
            return None
        last = b[p + 5] & 4
        p = end
        if last:
            return p
    return None


def mp4(b: bytes, at: int) -> int | None:
    """at: of ``ftyp``, four bytes into the first box."""
    p, kinds = at - 4, set()
    if p < 0:
        return None
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        head = 8
        if size == 1 and p + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        if not kind.isalnum() or size < head or p + size > len(b):
            break
        kinds.add(kind)
        p += size
    return p if {b"ftyp", b"moov"} <= kinds else None


def wasm(b: bytes, at: int) -> int | None:
    p, any_ = at + 8, False
    while p < len(b) and b[p] <= 13:
        size = shift = 0
        q = p + 1
        while q < len(b) and shift < 35:
            size |= (b[q] & 127) << shift
            shift += 7
            q += 1
            if b[q - 1] < 128:
                break
        if q + size > len(b) or not size:
            break
        p, any_ = q + size, True
    return p if any_ else None


def flac(b: bytes, at: int) -> int | None:
    """The audio frames have no length: from valid metadata on, all of the rest is taken."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        head, size = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (head & 127 or size != 34) or p + 4 + size > len(b):
            return None
        p, first = p + 4 + size, False
        if head & 128:
            return len(b)
    return None


def _start(pattern: bytes):
    rx = re.compile(rb"(?:\xef\xbb\xbf)?\s*" + pattern, re.I)

    def check(b: bytes, at: int) -> int | None:
        return len(b) if rx.match(b) else None

    return check


#: Magic bytes, where in the format they lie, type, validator.
BINARY = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png), (b"\xff\xd8\xff", 0, "image/jpeg", jpeg), (b"GIF8", 0, "image/gif", gif),
    (b"RIFF", 0, "audio/wav", riff(b"WAVE")), (b"RIFF", 0, "image/webp", riff(b"WEBP")), (b"RIFF", 0, "video/avi", riff(b"AVI ")),
    (b"%PDF-", 0, "application/pdf", pdf), (b"PK\x03\x04", 0, "application/zip", zip_), (b"\x1f\x8b", 0, "application/gzip", gzip_),
    (b"BM", 0, "image/bmp", bmp), (b"OggS", 0, "audio/ogg", ogg), (b"ftyp", 4, "video/mp4", mp4), (b"\0asm\x01\0\0\0", 0, "application/wasm", wasm),
    (b"fLaC", 0, "audio/flac", flac),
]
#: Text types, known by how a value starts; they are never embedded.
TEXT = [("text/html", _start(rb"(?:<!--.*?-->\s*)*(?:<!doctype html|<html)")), ("image/svg+xml", _start(rb"(?:<\?xml[^>]*>\s*)?<svg\b")), ("application/xml", _start(rb"<\?xml\b"))]
_URI = re.compile(rb"data:([\w.+-]+/[\w.+-]+)?(?:;[\w=-]+)*;base64,([A-Za-z0-9+/]+={0,2})")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[bytes, list] = {b"data:": [None]}
    for f in BINARY:
        words.setdefault(f[0], []).append(f)
    for w, fs in words.items():
        a.add_word(w.decode("latin-1"), (len(w), fs))
    a.make_automaton()
    return a


def places(b: bytes, found) -> list[tuple[int, object]]:
    """(position of the magic bytes, format or None for a data URI), by position."""
    out = []
    for end, (size, formats) in found.iter(b.decode("latin-1")):
        out.extend((end + 1 - size, f) for f in formats)
    return sorted(out, key=lambda x: x[0])


def sniff(b: bytes, found) -> tuple[str | None, bool, list[tuple]]:
    """(type, whether its structure holds up to the last byte, embedded media).

    Embedded: (type, declared type or None, start, length, bytes, parent), a medium before those within it. parent: the place
    in the list of the medium that encloses it, None for the value itself; start: in the value, or for what lies in a data
    URI's decoded content, in that content.
    """
    b = Value(b)
    kind, whole, inner = None, False, []
    open_: list[tuple[int, int, int | None]] = []  # start, end and place of the media around the present position
    for at, f in places(b, found):
        start = at if f is None else at - f[1]
        while open_ and open_[-1][1] <= start:
            open_.pop()
        limit, parent = (open_[-1][1], open_[-1][2]) if open_ else (len(b), None)
        if start < 0 or (open_ and open_[-1][0] == start):
            continue
        if f is None:
            m = _URI.match(b, at, limit)
            if not m:
                continue
            try:
                data = base64.b64decode(m[2], validate=True)
            except binascii.Error:
                continue
            inside, _, deeper = sniff(data, found)
            place = len(inner)
            inner.append((inside, m[1].decode().lower() if m[1] else None, at, m.end() - at, data, parent))
            inner.extend((*x[:5], place if x[5] is None else x[5] + place + 1) for x in deeper)
            open_.append((at, m.end(), place))
            continue
        end = f[3](b, at)
        if end is None or end > limit:
            continue
        if start == 0:
            kind, whole = f[2], end == len(b)
            open_.append((start, end, None))
        else:
            open_.append((start, end, len(inner)))
            inner.append((f[2], None, start, end - start, bytes(b[start:end]), parent))
    if kind is None:
        for name, check in TEXT:
            if check(b, 0):
                return name, True, inner
    return kind, whole, inner


_INNER = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("parent", T.IntegerType())]))
_RESULT = T.StructType([T.StructField("type", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("embedded", _INNER)])


@F.arrow_udf(_RESULT)
def _sniffed(values: pa.Array) -> pa.Array:
    found = automaton()
    out = []
    for v in values.to_pylist():
        if v is None:
            out.append(None)
            continue
        kind, whole, inner = sniff(v, found)
        out.append({"type": kind, "whole": whole, "embedded": [dict(zip(("type", "declared", "start", "length", "content", "parent"), x)) for x in inner]})
    kinds = pa.struct([("type", pa.string()), ("whole", pa.bool_()), ("embedded", pa.list_(pa.struct([("type", pa.string()), ("declared", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary()), ("parent", pa.int32())])))])
    return pa.array(out, kinds)


def media_columns(rows: DataFrame, content: str, declared: str) -> DataFrame:
    """The columns of rows without content, and media_type (sniffed, else declared), sniffed (null if no format holds),
    whole (the format ends with the value), corrected (sniffed differs from declared), n_bytes, embedded.

    embedded: type, declared type (of data URIs), start, length and content of each medium within the value, parent: the place in
    the list of the medium that encloses it (null: the value itself). Media within media are carved too: in containers with
    their start in the value, in data URIs with their start in the decoded content. type is null where a data URI's content isn't
    recognised. Whole values are searched, however long. Nulls: a null value has null results but keeps its declared type; a null
    declared type is corrected by any sniffed one. An empty value has no format. Repeated rows get equal results; an
    empty table gives an empty table. Columns called like a result become *_in (content and declared too: they are named
    as they are called in rows), any other name is left alone.
    """
    names = ("media_type", "sniffed", "whole", "corrected", "n_bytes", "embedded")
    g = guarded(rows, [], names)
    inner = {c.lower(): i for c, (i, _) in zip(rows.columns, g.names)}
    value, said = F.col(inner[content.lower()]), F.col(inner[declared.lower()])
    got = g.rows.withColumn("found", _sniffed(value.cast("binary")))
    kind = F.col("found.type")
    rest = [n for c, n in zip(rows.columns, g.names) if c.lower() != content.lower()]
    return Guarded(g.rows, rest).restored(
        got, F.coalesce(kind, said).alias("media_type"), kind.alias("sniffed"), F.col("found.whole").alias("whole"),
        F.when(value.isNotNull(), kind.isNotNull() & ~kind.eqNullSafe(F.lower(F.trim(said)))).alias("corrected"), F.octet_length(value).cast("bigint").alias("n_bytes"), F.col("found.embedded").alias("embedded"),
    )


def declared_type() -> Column:
    """Of pages, by their URLs' endings."""
    end = F.lower(F.regexp_extract("url", r"\.(\w+)(?:[?#]|$)", 1))
    return F.when(end.isin("png", "gif", "bmp", "webp"), F.concat(F.lit("image/"), end)).when(end.isin("jpg", "jpeg"), "image/jpeg").when(end == "pdf", "application/pdf").otherwise("text/html")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' contents, declared by their URLs' endings."""
    pages = table(spark, sf_dir, "pages")
    return media_columns(pages.select("page_id", declared_type().alias("declared"), "html"), "html", "declared")


#: A bitmap and a sound whose data are the page's digest: 54 and 44 bytes of head, 16 of data.
_BMP = "424d46000000000000003600000028000000020000000200000001001800000000001000000000000000000000000000000000000000"
_WAV = "524946463400000057415645666d74201000000001000100401f0000401f0000010008006461746110000000"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with media whose places are known: a bitmap alone (declared as a page) and, in the page itself, a bitmap and a
    sound behind the text, and the bitmap as a data URI that is declared as a GIF."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("html"), F.unhex(F.md5(F.coalesce("html", F.lit("")))).alias("digest"))
    bmp, wav = F.concat(F.unhex(F.lit(_BMP)), "digest"), F.concat(F.unhex(F.lit(_WAV)), "digest")
    uri = F.concat(F.lit("data:image/gif;base64,"), F.regexp_replace(F.base64(bmp), r"\s", "")).cast("binary")
    text = F.concat("html", F.lit("\n").cast("binary"), bmp, wav, uri)
    cases = F.explode(F.array(F.struct(F.lit("alone").alias("case"), bmp.alias("value")), F.struct(F.lit("inside").alias("case"), text.alias("value"))))
    rows = pages.filter("html IS NOT NULL").select("page_id", cases.alias("x")).select("page_id", "x.*", F.lit("text/html").alias("declared"))
    got = media_columns(rows, "value", "declared")
    inner = F.explode_outer("embedded").alias("e")
    return got.select("page_id", "case", "media_type", "whole", "corrected", "n_bytes", inner).select(
        "page_id", "case", "media_type", "whole", "corrected", "n_bytes", F.col("e.type").alias("type"), F.col("e.declared").alias("said"), F.col("e.start").alias("start"), F.col("e.length").alias("length"), F.md5("e.content").alias("content")
    )


PLANTED_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(html)) AS n, unhex('{_BMP}') || unhex(md5(html)) AS bmp, unhex('{_WAV}') || unhex(md5(html)) AS wav FROM pages WHERE html IS NOT NULL),
q AS (SELECT *, octet_length(bmp) AS b, octet_length(wav) AS w, 22 + length(to_base64(bmp)) AS u FROM p)
SELECT page_id, 'alone' AS "case", 'image/bmp' AS media_type, true AS whole, true AS corrected, b::BIGINT AS n_bytes, NULL::VARCHAR AS type, NULL::VARCHAR AS said, NULL::BIGINT AS start, NULL::BIGINT AS length, NULL::VARCHAR AS content FROM q
UNION ALL SELECT page_id, 'inside', 'text/html', true, false, n + 1 + b + w + u, 'image/bmp', NULL, n + 1, b, md5(bmp) FROM q
UNION ALL SELECT page_id, 'inside', 'text/html', true, false, n + 1 + b + w + u, 'audio/wav', NULL, n + 1 + b, w, md5(wav) FROM q
UNION ALL SELECT page_id, 'inside', 'text/html', true, false, n + 1 + b + w + u, 'image/bmp', 'image/gif', n + 1 + b + w, u, md5(bmp) FROM q"""
