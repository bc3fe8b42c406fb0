"""Media columns: storing payloads as samples, sniffing types by signature, carving.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator
of the format then checks structure and lengths before a hit counts. The type found at the
start corrects the declared one; hits further in are embedded media and are carved.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import arrow_rows

UNIT, RATE = 64, 8000
#: Marks within the formats.
JPEG_MARK = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)
PDF_VERSION, PDF_END, PDF_MORE = re.compile(rb"%PDF-[0-9]\."), re.compile(rb"%%EOF"), re.compile(rb"\s*(?:[0-9]+\s+[0-9]+\s+obj|xref\s)")
ZIP_END, FLAC_SYNC = re.compile(rb"PK\x05\x06"), re.compile(rb"\xff[\xf8\xf9]")
UNKNOWN = "application/octet-stream"


def _riff(b: memoryview, at: int) -> tuple[str, int] | None:
    if len(b) < at + 12:
        return None
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(bytes(b[at + 8 : at + 12]))
    if kind is None or size < 12 or at + size > len(b):
        return None
    seen, p = set(), at + 12
    while p + 8 <= at + size:
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        seen.add(bytes(b[p : p + 4]))
        p += 8 + n + n % 2
    whole = p in (at + size, at + size + 1)
    return (kind, size) if whole and (kind != "audio/wav" or {b"fmt ", b"data"} <= seen) else None


def _png(b: memoryview, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if p + 12 + n > len(b) or first and (name, n) != (b"IHDR", 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data up to a marker: the end, or that of another scan
            if (mark := JPEG_MARK.search(b, p)) is None:
                return None
            p = mark.end() - 2
            if b[p + 1] == 0xD9:
                return "image/jpeg", p + 2 - at
    return None


def _gif(b: memoryview, at: int) -> tuple[str, int] | None:
    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return "image/gif", p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _bmp(b: memoryview, at: int) -> tuple[str, int] | None:
    if len(b) < at + 30:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = not zero and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size and at + size <= len(b)
    return ("image/bmp", size) if good else None


def _pdf(b: memoryview, at: int) -> tuple[str, int] | None:
    """Up to the first end mark that no further part follows: a changed file has bodies and cross references behind one."""
    if PDF_VERSION.match(b, at) is None:
        return None
    for mark in PDF_END.finditer(b, at):
        if PDF_MORE.match(b, mark.end()) is None:
            return "application/pdf", mark.end() - at
    return None


def _zip(b: memoryview, at: int) -> tuple[str, int] | None:
    for mark in ZIP_END.finditer(b, at):
        end = mark.start() - at
        if at + end + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, at + end + 12)
            if start + size == end and bytes(b[at + start : at + start + 4]) == b"PK\x01\x02" and at + end + 22 + note <= len(b):
                return "application/zip", end + 22 + note
    return None


def _gzip(b: memoryview, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while rest and not d.eof:
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(b) - at - len(d.unused_data)) if d.eof else None


def _crc(b: memoryview, table: list[int], width: int) -> int:
    out, top, mask = 0, width - 8, (1 << width) - 1
    for x in b:
        out = (out << 8 & mask) ^ table[out >> top ^ x]
    return out


def _crc_table(poly: int, width: int) -> list[int]:
    out = []
    for i in range(256):
        c = i << width - 8
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> width - 1 else 0)) & (1 << width) - 1
        out.append(c)
    return out


#: The checks of a FLAC frame's header and of the frame.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: memoryview, p: int) -> tuple[int, int, int] | None:
    """(bytes of the header, samples, number) of the FLAC frame at p, if one begins there."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return None
    code, rate, lead = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    more = 0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()
    if more == 1 or more == 8:
        return None
    more = max(0, more - 1)
    size = {6: 1, 7: 2}.get(code, 0)
    n = 5 + more + size + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p + n + 1 > len(b) or _crc(b[p : p + n], CRC8, 8) != b[p + n]:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for x in b[p + 5 : p + 5 + more]:
        number = number << 6 | x & 0x3F
    explicit = int.from_bytes(b[p + 5 + more : p + 5 + more + size], "big") + 1
    samples = 192 if code == 1 else 576 << code - 2 if code < 6 else explicit if code < 8 else 256 << code - 8
    return n + 1, samples, number


def _flac(b: memoryview, at: int) -> tuple[str, int] | None:
    """Header blocks, then frames one behind the other; the last ends where its check fits, at its least size or later."""
    p, last, info = at + 4, False, None
    while not last and p + 4 <= len(b):
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if info is None and (kind, n) != (0, 34):
            return None
        info = info or bytes(b[p + 4 : p + 38])
        p += 4 + n
    if not last or p > len(b) or len(info or b"") < 34:
        return None
    least, most = int.from_bytes(info[4:7], "big"), int.from_bytes(info[7:10], "big")
    total, done = int.from_bytes(info[13:18], "big") & (1 << 36) - 1, 0
    if (frame := _flac_frame(b, p)) is None:
        return None if total else ("audio/flac", p - at)
    while True:
        head, samples, number = frame
        done += samples
        if total and done >= total:
            break
        for mark in FLAC_SYNC.finditer(b, p + head):
            # frames of a fixed size count one by one, others by their first sample
            if (following := _flac_frame(b, mark.start())) and following[2] in (number + 1, number + samples):
                p, frame = mark.start(), following
                break
        else:
            if total:
                return None
            break
    check, ends = 0, []
    stop = min(len(b), p + (most or 1 << 20))
    for i in range(p, stop):
        check = (check << 8 & 0xFFFF) ^ CRC16[check >> 8 ^ b[i]]
        if not check and i + 1 - p >= max(least, head + 2):
            ends.append(i + 1)
    return ("audio/flac", (stop if stop in ends else ends[0]) - at) if ends else None


def _ogg(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        n = b[p + 26]
        if p + 27 + n > len(b):
            return None
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return ("application/ogg", p - at) if at < p <= len(b) else None


def _mp4(b: memoryview, at: int) -> tuple[str, int] | None:
    p = at
    while p + 8 <= len(b):
        n, name = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if n < 8 or p + n > len(b) or not name.isalnum():
            break
        p += n
    return ("video/mp4", p - at) if p > at + 8 else None


#: Magic bytes, how far before the file begins they stand, and the validator.
SIGNATURES: list[tuple[bytes, int, Callable[[memoryview, int], tuple[str, int] | None]]] = [
    (b"RIFF", 0, _riff),
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"BM", 0, _bmp),
    (b"%PDF-", 0, _pdf),
    (b"PK\x03\x04", 0, _zip),
    (b"\x1f\x8b\x08", 0, _gzip),
    (b"fLaC", 0, _flac),
    (b"OggS", 0, _ogg),
    (b"ftyp", 4, _mp4),
]
VALIDATED = frozenset("audio/wav image/webp video/avi image/png image/jpeg image/gif image/bmp application/pdf application/zip application/gzip audio/flac application/ogg video/mp4".split())
_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(SIGNATURES):
            _AUTOMATON.add_word(magic.decode("latin-1"), i)
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media that validate, outermost only unless the outer one is a container that starts at 0."""
    view, out = memoryview(data), []
    for end, i in automaton().iter(data.decode("latin-1")):
        magic, before, validate = SIGNATURES[i]
        at = end + 1 - len(magic) - before
        if at < 0 or any(0 < o <= at < o + n for _, o, n in out):
            continue
        if found := validate(view, at):
            out.append((found[0], at, found[1]))
    return out


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM, lossless: a sample is a byte. Payloads past 4 GiB do not fit the format."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def samples(stored: bytes) -> bytes:
    """The data chunk of a stored WAV."""
    p = 12
    while p + 8 <= len(stored):
        n = int.from_bytes(stored[p + 4 : p + 8], "little")
        if stored[p : p + 4] == b"data":
            return stored[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def feature(kind: str, payload: bytes, embedded: int) -> str:
    """Type, samples, embedded media, and the mean, deviation and crossings of the middle over all samples."""
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    squares = int(np.square(x, dtype=np.uint32).sum(dtype=np.int64))
    mean = total / len(x)
    above = x >= 128
    crossings = int((above[1:] != above[:-1]).sum())
    return f"{kind};n={len(x)};embedded={embedded};mean={mean:.4f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings}"


def sniff_column(df: DataFrame, data: str, declared: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then media_type (corrected), was_wrong, valid_bytes, embedded (type, offset, bytes).

    The type is that of the media that validates at offset 0. Where none does, a declared type
    that no validator knows is kept, and any other is the unknown one; a null or empty value
    has the unknown type and no embedded media. was_wrong: the declared type (null: unknown)
    differs. Rows, nulls and repeats are kept; other columns are not read.
    """
    names = [f"_c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, wrong, sizes, inner = [], [], [], []
            for d, t in zip(batch.column(k), batch.column(k + 1)):
                value = d.as_py() or b""
                found = sniff(value)
                said = t.as_py() or UNKNOWN
                kind, n = next(((m, n) for m, o, n in found if o == 0), (UNKNOWN if said in VALIDATED or not value else said, 0))
                kinds.append(kind)
                wrong.append(kind != said)
                sizes.append(n)
                inner.append([{"media_type": m, "offset": o, "data": value[o : o + n]} for m, o, n in found if o])
            kind_of = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("data", pa.binary())]))
            yield pa.record_batch([*batch.columns[:k], pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(inner, kind_of)], names=[*names, "media_type", "was_wrong", "valid_bytes", "embedded"])

    chosen = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    out = arrow_rows(df, [*chosen, F.col(f"`{data}`").alias("_data"), F.col(f"`{declared}`").alias("_declared")], run, f"{schema}, media_type string, was_wrong boolean, valid_bytes long, embedded array<struct<media_type:string,offset:long,data:binary>>")
    return out.withColumnsRenamed(dict(zip(names, keep)))


def digest(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every whole text as a WAV of its padded bytes, sniff, carve and read it back, and describe it.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A null text is empty: its payload is one unit of zero bytes.
    Equal texts have equal values. Rows, null ids and repeats are kept; an empty table gives
    an empty one; other columns are not read. One narrow pass; a value lives in one row only.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        stored = wav(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"))
        found = sniff(stored)
        media_type, size = next((m, n) for m, o, n in found if o == 0)
        carved = samples(stored[:size])
        return len(raw), len(carved), sha256(carved).hexdigest(), zlib.crc32(carved[-UNIT:]), len(stored), sha256(stored).hexdigest(), feature(media_type, carved, len(found) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *columns], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_rows(df, [F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string")], run, schema)
