"""Media columns: store bytes as media, tell media by their signatures, correct declared types, carve embedded media.

An Aho-Corasick automaton finds every magic number of a value in one pass. A hit is only a guess: the format's
validator then walks the structure behind it (chunk lengths, check sums, header fields) and returns the medium's
length, or refuses. A valid medium at the first byte gives the value's type, whatever was declared; valid media
further in are carved.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import slices, small_batches, text_of, utf8

UNIT = 64
UNKNOWN = "application/octet-stream"
RATE = 8000


class Ends:
    """Where a value's end marks are, found in one pass when they are first asked for, however many begins ask."""

    def __init__(self, data: bytes):
        self.data = data

    def _places(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.data)]

    @cached_property
    def eof(self) -> list[int]:
        return self._places(b"%%EOF")

    @cached_property
    def startxref(self) -> list[int]:
        return self._places(b"startxref")

    @cached_property
    def archives(self) -> dict[int, int]:
        """The begin that each end of an archive tells, and the archive's length; of ends with one begin the first."""
        out: dict[int, int] = {}
        for i in self._places(b"PK\x05\x06"):
            if i + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, i + 12)
                at = i - size - start
                if at >= 0 and i + 22 + note <= len(self.data) and (not size or self.data[at + start : at + start + 4] == b"PK\x01\x02"):
                    out.setdefault(at, i + 22 + note - at)
        return out


# -- validators: the length of the medium at `at`, or None ---------------------------------------------------------


def _png(b: bytes, at: int, ends: Ends) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if (first and (kind != b"IHDR" or size != 13)) or i + 12 + size > len(b):
            return None
        if struct.unpack_from(">I", b, i + 8 + size)[0] != zlib.crc32(memoryview(b)[i + 4 : i + 8 + size]):
            return None
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return i - at
    return None


def _wav(b: bytes, at: int, ends: Ends) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    i, end, seen = at + 12, at + size, set()
    if end > len(b):
        return None
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, i)
        if i + 8 + n > end:
            return None
        seen.add(kind)
        i += 8 + n + (n & 1)
    return size if {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int, ends: Ends) -> int | None:
    if len(b) < at + 54:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = not reserved and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size
    return size if good and at + size <= len(b) else None


def _au(b: bytes, at: int, ends: Ends) -> int | None:
    if len(b) < at + 24:
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    good = 24 <= start <= 1 << 16 and 1 <= coding <= 27 and 1 <= rate <= 400_000 and 1 <= channels <= 64 and size != 0xFFFFFFFF
    return start + size if good and at + start + size <= len(b) else None


def _gif(b: bytes, at: int, ends: Ends) -> int | None:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or len(b) < at + 13:
        return None
    flags, i = b[at + 10], at + 13
    i += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 <= len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _jpeg(b: bytes, at: int, ends: Ends) -> int | None:
    i, framed = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        mark = b[i + 1]
        if mark == 0xD9:
            return i + 2 - at if framed else None
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or mark in (0, 1) or 0xD0 <= mark <= 0xD8:
            return None
        framed |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if mark == 0xDA:  # entropy-coded data, up to the next marker that is no restart or stuffing
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return i + 2 - at if framed and b[i : i + 2] == b"\xff\xd9" else None


def _pdf(b: bytes, at: int, ends: Ends) -> int | None:
    k = bisect.bisect_left(ends.eof, at)
    if k == len(ends.eof):
        return None
    end, x = ends.eof[k], bisect.bisect_left(ends.startxref, at)
    return end + 5 - at if x < len(ends.startxref) and ends.startxref[x] < end else None


def _zip(b: bytes, at: int, ends: Ends) -> int | None:
    return ends.archives.get(at)


#: Magic numbers, types and validators.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, Ends], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _wav),
    (b"BM", "image/bmp", _bmp),
    (b".snd", "audio/basic", _au),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
]


@lru_cache(1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), k)
    out.make_automaton()
    return out


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The type and length of the medium at the first byte (UNKNOWN and 0 if none), and type, offset and length of the
    media inside and behind it. Of media inside a carved one only the outer one is listed."""
    kind, length, carved, free, ends = UNKNOWN, 0, [], 0, Ends(data)
    hits = sorted((end - len(FORMATS[k][0]) + 1, k) for end, k in _automaton().iter(data.decode("latin-1")))
    for at, k in hits:
        if at and at < free:
            continue
        if n := FORMATS[k][2](data, at, ends):
            if at:
                carved.append((FORMATS[k][1], at, n))
                free = at + n
            else:
                kind, length = FORMATS[k][1], n
    return kind, length, carved


# -- lossless stores of 8-bit samples ------------------------------------------------------------------------------


def _to_png(p: bytes) -> bytes:
    rows = np.zeros((len(p) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, UNIT)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def _from_png(b: bytes) -> bytes:
    i, data = 8, []
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if kind == b"IDAT":
            data.append(b[i + 8 : i + 8 + size])
        i += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are stored here")
    return rows[:, 1:].tobytes()


def _to_wav(p: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(p)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(p)) + p


def _to_bmp(p: bytes) -> bytes:
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)
    grey[:, 3] = 0
    start = 54 + 1024
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(p), 0, start, 40, UNIT, -(len(p) // UNIT), 1, 8, 0, len(p), 2835, 2835, 256, 0)
    return head + grey.tobytes() + p


def _to_au(p: bytes) -> bytes:
    return b".snd" + struct.pack(">IIIII", 24, len(p), 2, RATE, 1) + p


#: Type, store, read. A value's own check sum picks the format, so that equal texts are stored alike.
STORES: list[tuple[str, Callable[[bytes], bytes], Callable[[bytes], bytes]]] = [
    ("image/png", _to_png, _from_png),
    ("audio/wav", _to_wav, lambda b: b[44:]),
    ("image/bmp", _to_bmp, lambda b: b[struct.unpack_from("<I", b, 10)[0] :]),
    ("audio/basic", _to_au, lambda b: b[struct.unpack_from(">I", b, 4)[0] :]),
]
READ = {kind: read for kind, _, read in STORES}


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's UTF-8, padded with zeros to a positive multiple of 64, as a PNG or
    BMP of 64 samples a row, or as WAV or AU. `declared` is what a careless sender might have said: often wrong.

    A null text counts as empty; rows that repeat each get their row; other columns are ignored; an empty table gives
    none. A very long text is one value, which one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            raw, media, declared = data.tobytes(), [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                payload = raw[a:b] + bytes(-(b - a) % UNIT if b > a else UNIT)
                pick = zlib.crc32(payload)
                media.append(STORES[pick % len(STORES)][1](payload))
                declared.append(STORES[(pick >> 8) % len(STORES)][0])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(declared), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, declared string, media binary")


_FOUND = "media_type string, corrected boolean, carved array<struct<type:string,offset:long,length:long>>"


def inspect(rows: DataFrame, data_col: str = "media", declared_col: str = "declared", id_col: str = "doc_id") -> DataFrame:
    """doc_id, media_type, corrected (the declared type was another) and carved media of each row. A null or empty
    value, or one that begins with no valid medium, is UNKNOWN; a null declared type counts as UNKNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            found = [(*sniff(x or b""), d or UNKNOWN) for x, d in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True)]
            kinds = [f[0] for f in found]
            carved = [[{"type": t, "offset": o, "length": n} for t, o, n in f[2]] for f in found]
            kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kinds, pa.string()), pa.array([f[0] != f[3] for f in found]), pa.array(carved, kind)], ["doc_id", "media_type", "corrected", "carved"])

    own = rows.select(F.col(id_col).alias("doc_id"), F.col(data_col).alias("media"), F.col(declared_col).alias("declared"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


def features(stored: DataFrame) -> DataFrame:
    """One row per stored value, from its bytes as read back by the type that sniffing finds: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, corrected, n_carved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected", "n_carved"]
        kinds = [None, None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
        for part in slices(batches, "media"):
            out: list[list] = [[] for _ in names[2:]]
            for b, declared in zip(part.column("media").to_pylist(), part.column("declared").to_pylist(), strict=True):
                kind, length, carved = sniff(b)
                if kind not in READ:
                    raise ValueError(f"a stored value reads back as {kind}")
                payload = READ[kind](b[:length])
                samples = np.frombuffer(payload, np.uint8)
                share = np.bincount(samples, minlength=256) / len(samples)
                entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
                told = f"{kind} {UNIT}x{len(payload) // UNIT} mean {samples.mean():.3f} entropy {entropy:.3f} carved {len(carved)}"
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), told, kind != declared, len(carved))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x, k) for x, k in zip(out, kinds[2:], strict=True))], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return small_batches(stored).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean, n_carved int"
    )
