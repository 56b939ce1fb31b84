"""Media columns: lossless storage as WAV, and signature sniffing.

Sniffing: one Aho-Corasick pass locates every magic byte string, and the closing marks of
formats that have no length in front; then a validator of that format confirms its
structure and returns its exact length, in bounded memory whatever the value holds. The validated format at
offset 0 is the detected type and corrects the declared one; validated formats at other
offsets are carved as embedded media. Magic bytes without valid structure are ignored.

Null values count as empty bytes: no detected type, nothing carved. Equal bytes give
equal results; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import plain, ship, slices, spread

UNIT = 576
PAD = b"\xff"
#: Bytes read, and bytes inflated, at a time.
STEP = 1 << 18


@dataclass
class Marks:
    """Places of closing marks in a value: archives of ZIP end records, startxref and end-of-file marks of PDF."""

    zips: dict[int, int]
    starts: list[int]
    ends: list[int]


def _wav(b: bytes, at: int) -> int | None:
    """Length of a RIFF/WAVE file whose chunks add up, with a format chunk before its data."""
    if len(b) - at < 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, formed = at + 12, False
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        if b[p : p + 4] == b"fmt ":
            formed = size >= 16
        elif b[p : p + 4] == b"data" and formed and p + 8 + size <= end:
            return end - at
        p += 8 + size + size % 2
    return None


def _png(b: bytes, at: int) -> int | None:
    """Length of a PNG: chunks with right checksums from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + size > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Length of a GIF: screen descriptor, then blocks up to the trailer."""

    def skip(p: int) -> int | None:
        while p < len(b):
            if b[p] == 0:
                return p + 1
            p += 1 + b[p]
        return None

    if len(b) - at < 14 or not (int.from_bytes(b[at + 6 : at + 8], "little") and int.from_bytes(b[at + 8 : at + 10], "little")):
        return None
    p: int | None = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = skip(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = skip(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Length of a JPEG: marker segments with lengths, a frame, a scan, and the end marker."""
    p, framed = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark in (0x00, 0x01, 0xD8) or 0xD0 <= mark <= 0xD7:
            return None
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2 or p + 2 + size > len(b):
            return None
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2 - at if framed else None
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def zip_ends(b: bytes, marks: list[int]) -> dict[int, int]:
    """Where each archive begins whose end record (at one of ``marks``) points back at its central directory, and its first end."""
    found: dict[int, int] = {}
    for p in marks:
        if p + 22 <= len(b):
            size, off, note = struct.unpack_from("<IIH", b, p + 12)
            at = p - size - off
            if at >= 0 and p + 22 + note <= len(b) and b[at + off : at + off + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                found.setdefault(at, p + 22 + note)
    return found


def _zip(b: bytes, at: int, marks: Marks) -> int | None:
    """Length of a ZIP whose end record points back at a central directory of this archive."""
    end = marks.zips.get(at)
    return end - at if end else None


def _gzip(b: bytes, at: int) -> int | None:
    """Length of a gzip member that inflates with the right checksum; what it inflates to is not kept."""
    if len(b) - at < 18 or b[at + 2] != 8:
        return None
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        for i in range(0, len(rest), STEP):
            some = rest[i : i + STEP]
            while True:
                d.decompress(some, STEP)
                if d.eof:
                    return min(i + STEP, len(rest)) - len(d.unused_data)
                some = d.unconsumed_tail
                if not some:
                    break
    except zlib.error:
        pass
    return None


def _pdf(b: bytes, at: int, marks: Marks) -> int | None:
    """Length of a PDF: version, a startxref and an end-of-file mark."""
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    x = bisect_left(marks.starts, at)
    e = bisect_left(marks.ends, marks.starts[x]) if x < len(marks.starts) else len(marks.ends)
    return marks.ends[e] + 5 - at if e < len(marks.ends) else None


def _bmp(b: bytes, at: int) -> int | None:
    """Length of a BMP with a known header size and pixel offset inside the file."""
    if len(b) - at < 26:
        return None
    size, _, off, head = struct.unpack_from("<IIII", b, at + 2)
    return size if head in (12, 40, 52, 56, 108, 124) and 14 + head <= off <= size <= len(b) - at else None


def _ogg(b: bytes, at: int) -> int | None:
    """Length of a run of Ogg pages, the first of which begins a stream."""
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
        n = b[p + 26]
        if p + 27 + n > len(b) or p == at and not b[p + 5] & 2:
            return None
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
    return p - at or None


#: Closing marks.
CLOSING = (b"PK\x05\x06", b"startxref", b"%%EOF")
#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[..., int | None]], ...] = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"BM", "image/bmp", _bmp),
    (b"OggS", "audio/ogg", _ogg),
)


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for no, word in enumerate([*(magic for magic, _, _ in FORMATS), *CLOSING]):
        a.add_word(word.decode("latin-1"), (no, len(word)))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Validated media as (start, end, type), by start; one inside another is left to a later sniff of it."""
    places: list[list[int]] = [[] for _ in CLOSING]
    heads = []
    for last, (no, size) in _automaton().iter(data.decode("latin-1")):
        if no < len(FORMATS):
            heads.append((last + 1 - size, no))
        else:
            places[no - len(FORMATS)].append(last + 1 - size)
    marks = Marks(zip_ends(data, places[0]), *places[1:])
    found, free = [], 0
    for at, no in sorted(heads):
        _, kind, valid = FORMATS[no]
        if at >= free and (size := valid(data, at, marks) if valid in (_zip, _pdf) else valid(data, at)):
            found.append((at, at + size, kind))
            free = at + size
    return found


def store_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as one channel of 8-bit samples; a pad byte follows an odd length."""
    pad = len(payload) % 2
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)
    )
    return head + payload + b"\0" * pad


def read_wav(media: bytes) -> bytes:
    """The samples of a WAV file that :func:`sniff` accepts at offset 0."""
    if not (found := sniff(media)) or found[0][0] or found[0][2] != "audio/wav":
        raise ValueError("not a WAV file")
    p = 12
    while media[p : p + 4] != b"data":
        size = int.from_bytes(media[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    return media[p + 8 : p + 8 + int.from_bytes(media[p + 4 : p + 8], "little")]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with 255 up to a positive multiple of 576, and their unfilled length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * ((-len(raw)) % UNIT if raw else UNIT), len(raw)


def sniff_column(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """Add detected_type, corrected_type, is_wrong, and carved array<struct<start,end,type,bytes>>."""
    ship(df.sparkSession)
    kind = "struct<detected_type:string,carved:array<struct<start:long,end:long,type:string,bytes:binary>>>"

    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.DataFrame:
        rows = []
        for b in col:
            b = bytes(b) if b is not None else b""
            found = sniff(b)
            head = found[0][2] if found and found[0][0] == 0 else None
            rows.append((head, [{"start": s, "end": e, "type": k, "bytes": b[s:e]} for s, e, k in found if s]))
        return pd.DataFrame(rows, columns=["detected_type", "carved"])

    named = F.col(f"`{declared}`")
    return (
        df.withColumn("__sniffed", run(F.col(f"`{media}`")))
        .withColumn("detected_type", F.col("__sniffed.detected_type"))
        .withColumn("carved", F.col("__sniffed.carved"))
        .withColumn("corrected_type", F.coalesce(F.col("detected_type"), named))
        .withColumn("is_wrong", F.coalesce(F.col("detected_type") != named, F.lit(False)))
        .drop("__sniffed")
    )


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text as a WAV, sniff and read it back, and return digests of both.

    ``feature`` holds the detected type and the sample layout, then the media carved from
    the samples themselves, as ``type@start-end``.
    """
    ship(df.sparkSession)
    names = [f.split()[0] for f in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                payload, n = payload_of(text)
                media = store_wav(payload)
                kind = sniff(media)[0][2]
                back = read_wav(media)
                inside = "".join(f";{k}@{s}-{e}" for s, e, k in sniff(back))
                rows.append(
                    (
                        n,
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"{kind};8bit;1ch;{len(back)}{inside}",
                    )
                )
            cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if cols:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    return spread(plain(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, DIGEST)
