"""Signature sniffing of binary media columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass. A format's validator then
reads the structure from that place (chunk lengths and checksums, boxes, pages, markers) and returns
where the object ends, or nothing, so text that happens to hold a magic is no finding. An object at
the start gives the column's true type, which corrects the declared one; objects inside others or
after other bytes are carved by offset and length.

``store``/``load`` write and read payloads as 8-bit samples of a PCM sound, one sample for each byte.

Defined results: null content counts as empty and has the type ``application/octet-stream``;
repeated rows give equal values; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import ready

UNKNOWN = "application/octet-stream"
BLOCK = 192
RATE = 8000


def _png(b: bytes, at: int) -> int | None:
    k = at + 8
    while k + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[k : k + 8])
        if k + 12 + n > len(b) or zlib.crc32(b[k + 4 : k + 8 + n]) != struct.unpack(">I", b[k + 8 + n : k + 12 + n])[0]:
            return None
        k += 12 + n
        if kind == b"IEND":
            return k
    return None


def _riff(kind: bytes) -> Callable:
    def run(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0]
        k, chunks = at + 12, 0
        while k + 8 <= min(end, len(b)):
            n = struct.unpack("<I", b[k + 4 : k + 8])[0]
            k, chunks = k + 8 + n + n % 2, chunks + 1
        return end if chunks and end <= len(b) and k in (end, end + 1) else None

    return run


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    k = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += 1 + b[k]
        return k + 1

    while k < len(b):
        if b[k] == 0x3B:
            return k + 1
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 < len(b):
            flags = b[k + 9]
            k = blocks(k + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    k, frame = at + 2, False
    while k + 4 <= len(b):
        if b[k] != 0xFF:
            return None
        marker = b[k + 1]
        if marker == 0xFF:
            k += 1
        elif marker == 0xD9:
            return k + 2 if frame else None
        elif marker == 0xDA:
            k += 2 + struct.unpack(">H", b[k + 2 : k + 4])[0]
            k = b.find(b"\xff", k)
            while 0 <= k < len(b) - 1 and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k = b.find(b"\xff", k + 2)
            if not 0 <= k < len(b) - 1:
                return None
            if b[k + 1] == 0xD9:
                return k + 2 if frame else None
        else:
            frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
            k += 2 + struct.unpack(">H", b[k + 2 : k + 4])[0]
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, start, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes = struct.unpack("<H", b[at + 26 : at + 28])[0]
    return at + size if zero == 0 and header in (40, 108, 124) and planes == 1 and 14 + header <= start <= size <= len(b) - at else None


def _pnm(b: bytes, at: int) -> int | None:
    head = b[at : at + 64].split(None, 4)
    if len(head) < 4 or not all(x.isdigit() and len(x) < 8 for x in head[1:4]) or head[3] != b"255":
        return None
    k, seen = at, 0
    while seen < 4:  # the header ends with one byte of white space after its fourth word
        while b[k : k + 1].isspace():
            k += 1
        while k < len(b) and not b[k : k + 1].isspace():
            k += 1
        seen += 1
    end = k + 1 + int(head[1]) * int(head[2]) * (3 if head[0] == b"P6" else 1)
    return end if end <= len(b) else None


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    reader = zlib.decompressobj(31)
    try:
        data = memoryview(b)[at:]
        while data and not reader.eof:
            reader.decompress(data, 1 << 20)
            data = reader.unconsumed_tail
    except zlib.error:
        return None
    return len(b) - len(reader.unused_data) if reader.eof else None


@functools.lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int | None]:
    """End of the archive by its start, from every end record of a content; the first record counts."""
    out: dict[int, int | None] = {}
    k = b.find(b"PK\x05\x06")
    while k >= 0 and k + 22 <= len(b):
        size, start, note = struct.unpack("<IIH", b[k + 12 : k + 22])
        at = k - start - size
        if at >= 0 and (size == 0 or b[at + start : at + start + 4] == b"PK\x01\x02"):
            out.setdefault(at, k + 22 + note if k + 22 + note <= len(b) else None)
        k = b.find(b"PK\x05\x06", k + 4)
    return out


def _zip(b: bytes, at: int) -> int | None:
    return _zip_ends(b).get(at)


@functools.lru_cache(maxsize=1)
def _pdf_marks(b: bytes) -> tuple[int, int]:
    """The last end mark, and the place from which on a file can't begin any more to hold what comes before that mark."""
    k = b.rfind(b"%%EOF")
    return k, min(b.rfind(b"startxref", 0, max(k, 0)), b.rfind(b" obj", 0, max(k, 0)))


def _pdf(b: bytes, at: int) -> int | None:
    end, last = _pdf_marks(b)
    return end + 5 if b[at + 5 : at + 6].isdigit() and at <= last else None


def _ogg(b: bytes, at: int) -> int | None:
    k = at
    while k + 27 <= len(b) and b[k : k + 4] == b"OggS" and b[k + 4] == 0:
        n = b[k + 26]
        size = 27 + n + sum(b[k + 27 : k + 27 + n])
        if k + size > len(b):
            return None
        last, k = b[k + 5] & 4, k + size
        if last:
            return k
    return None


def _mp4(b: bytes, at: int) -> int | None:
    k, kinds = at - 4, []
    while k >= 0 and k + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[k : k + 8])
        if n < 8 or k + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"udta", b"meta", b"wide", b"sidx", b"uuid"):
            break
        kinds.append(kind)
        k += n
    return k if kinds[:1] == [b"ftyp"] and len(kinds) > 1 else None


# type, magic bytes, where the object starts relative to them, its validator.
FORMATS = (
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png), ("image/gif", b"GIF87a", 0, _gif), ("image/gif", b"GIF89a", 0, _gif), ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg), ("image/bmp", b"BM", 0, _bmp),
    ("image/x-portable-anymap", b"P5\n", 0, _pnm), ("image/x-portable-anymap", b"P6\n", 0, _pnm), ("audio/wav", b"RIFF", 0, _riff(b"WAVE")), ("image/webp", b"RIFF", 0, _riff(b"WEBP")), ("video/avi", b"RIFF", 0, _riff(b"AVI ")),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip), ("application/zip", b"PK\x03\x04", 0, _zip), ("application/pdf", b"%PDF-", 0, _pdf), ("audio/ogg", b"OggS", 0, _ogg), ("video/mp4", b"ftyp", -4, _mp4),
)
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        by: dict[bytes, list[int]] = {}
        for k, (_, magic, _, _) in enumerate(FORMATS):
            by.setdefault(magic, []).append(k)
        for magic, ks in by.items():
            a.add_word(magic.decode("latin-1"), (len(magic), ks))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def objects(content: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every object that a validator confirms, in order; nested ones too."""
    out = []
    for end, (n, ks) in _automaton().iter(content.decode("latin-1")):
        at = end + 1 - n
        for k in ks:
            kind, _, start, valid = FORMATS[k]
            stop = valid(content, at) if at + start >= 0 else None
            if stop is not None:
                out.append((at + start, stop - at - start, kind))
    return sorted(set(out))


def sniff(rows: DataFrame, content_col: str = "content", declared_col: str | None = None, id_col: str = "id") -> DataFrame:
    """(id, type, corrected, length, carved): the true type of each content and what lies inside it."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content = content or b""
                found = objects(content)
                head = max((x for x in found if x[0] == 0), key=lambda x: x[1], default=(0, len(content), UNKNOWN))
                out.append((head[2], head[2] != UNKNOWN and head[2] != declared, head[1], [dict(zip(("offset", "length", "type"), x, strict=True)) for x in found if x != head]))
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True))], ["id", "type", "corrected", "length", "carved"])

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).cast("binary").alias("content"), declared.alias("declared")).mapInArrow(run, "id long, type string, corrected boolean, length long, carved array<struct<offset:long,length:long,type:string>>")


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A payload of even length as a sound of unsigned 8-bit samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def load(media: bytes, at: int = 0, length: int | None = None) -> bytes:
    """The samples of a sound that lies in ``media``: its data chunk."""
    end = len(media) if length is None else at + length
    k = at + 12
    while k + 8 <= end:
        n = struct.unpack("<I", media[k + 4 : k + 8])[0]
        if media[k : k + 4] == b"data":
            return media[k + 8 : k + 8 + n]
        k += 8 + n + n % 2
    raise ValueError("no data chunk")


def feature(samples: bytes) -> str:
    """Level, spread and zero crossings of the samples around the middle, and the share of each quarter of the scale."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    quarters = np.bincount(x >> 6, minlength=4) * 1000 // len(x)
    return f"mean={x.sum(dtype=np.int64) / len(x):.3f};peak={int(x.max())};floor={int(x.min())};crossings={crossings};quarters={'/'.join(map(str, quarters))}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "text/plain") -> DataFrame:
    """Each text stored as a sound, found again by its signature, and read back.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature):
    the feature names the type found, whether it corrects the declared one, and what was carved.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1), "").cast(pa.binary()), strict=True):
                    data = text.as_buffer().to_pybytes()
                    media = store(data + b"\x20" * (-len(data) % BLOCK or (BLOCK if not data else 0)))
                    found = objects(media)
                    at, length, kind = next(x for x in found if x[0] == 0)
                    back = load(media, at, length)
                    inner = ",".join(f"{a}+{n}:{t}" for a, n, t in found if a)
                    rows.append((key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};corrected={int(kind != declared)};carved={inner};{feature(back)}"))
                long, text = pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (long, long, long, text, long, long, text, text), strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
