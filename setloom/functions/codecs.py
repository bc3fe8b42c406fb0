"""Tag frames and their payloads: bytes in, values out, and back."""

from __future__ import annotations

import base64
import struct

# Fixed values of the formats.
AUTOTAGS, BEATGRID, MARKERS, OVERVIEW = "Serato Autotags", "Serato BeatGrid", "Serato Markers2", "Serato Overview"
MIME, GRID_FOOTER, MARKERS_LENGTH, BEATS_PER_MARKER = "application/octet-stream", 0x37, 470, 8
CUE_COLORS = [0xCC0000, 0xCC4400, 0xCC8800, 0x88CC00, 0x00CC44, 0x00CCCC, 0x0044CC, 0x8800CC]
NEW_PADDING, OLD_PADDING, TAG_PADDING = 1024, 2048, 4096
#: The frame of each field that may be edited, with its description if it needs one.
FIELD_FRAMES = {
    "title": ("TIT2", None), "artist": ("TPE1", None), "album": ("TALB", None), "genre": ("TCON", None), "year": ("TYER", None),
    "bpm": ("TBPM", None), "key": ("TKEY", None), "comment": ("COMM", "pyro"), "camelot": ("TXXX", "CAMELOT"),
}
NUMBER_FRAMES, COMMENT_LANGUAGE = ("TYER", "TBPM"), b"eng"


def synchsafe(data: bytes) -> int:
    out = 0
    for b in data:
        out = out << 7 | b & 0x7F
    return out


def to_synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _number(text: bytes) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def encode_autotags(bpm: float, auto_gain: float = 0.0, gain: float = 0.0) -> bytes:
    return b"\x01\x01" + b"".join(f"{v:.{n}f}".encode() + b"\0" for v, n in ((bpm, 2), (auto_gain, 3), (gain, 3)))


def decode_autotags(data: bytes) -> dict | None:
    parts = data[2:].split(b"\0")
    if len(data) < 3 or (bpm := _number(parts[0])) is None:
        return None
    return {"bpm": bpm, "auto_gain": _number(parts[1]) if len(parts) > 1 else None, "gain": _number(parts[2]) if len(parts) > 2 else None}


def encode_beat_grid(beats: list[float], bpm: float, every: int = BEATS_PER_MARKER, footer: int = GRID_FOOTER) -> bytes:
    """A marker every ``every`` beats and one at the last, which holds the tempo."""
    marks = list(beats[::every])
    if beats and marks[-1] != beats[-1]:
        marks.append(beats[-1])
    body = b"".join(struct.pack(">fI", m, every) for m in marks[:-1]) + (struct.pack(">ff", marks[-1], bpm) if marks else b"")
    return b"\x01\x00" + struct.pack(">I", len(marks)) + body + bytes((footer,))


def decode_beat_grid(data: bytes) -> dict | None:
    if len(data) < 6:
        return None
    n = struct.unpack_from(">I", data, 2)[0]
    if not n or len(data) < 6 + 8 * n:
        return None
    marks = [struct.unpack_from(">fI", data, 6 + 8 * i) for i in range(n - 1)]
    last, bpm = struct.unpack_from(">ff", data, 6 + 8 * (n - 1))
    return {"positions": [m[0] for m in marks] + [last], "beats": [m[1] for m in marks], "bpm": bpm}


def encode_markers(cues: list[dict] = (), color: int = 0xFFFFFF, locked: bool = False) -> bytes:
    def entry(name: bytes, data: bytes) -> bytes:
        return name + b"\0" + struct.pack(">I", len(data)) + data

    rgb = lambda c: c.to_bytes(3, "big")
    inner = b"\x01\x01" + entry(b"COLOR", b"\0" + rgb(color)) + entry(b"BPMLOCK", bytes((locked,)))
    for c in cues:
        shade = c.get("color")
        shade = CUE_COLORS[c["index"] % len(CUE_COLORS)] if shade is None else shade
        at = max(0, int(c["position_ms"] + 0.5))
        inner += entry(b"CUE", b"\0" + bytes((c["index"] & 0xFF,)) + struct.pack(">I", at) + b"\0" + rgb(shade) + b"\0\0" + (c.get("name") or "").encode() + b"\0")
    text = base64.b64encode(inner + b"\0")
    lines = b"\n".join(text[i : i + 72] for i in range(0, len(text), 72))
    return (b"\x01\x01" + lines).ljust(MARKERS_LENGTH, b"\0")


def decode_markers(data: bytes) -> dict:
    """Colour, tempo lock and cues in order of position; what follows a broken entry is left out."""
    text = data[2:].split(b"\0")[0].replace(b"\n", b"")
    inner = base64.b64decode(text + b"=" * (-len(text) % 4))
    out, at = {"color": None, "locked": False, "cues": []}, 2
    while at < len(inner) and inner[at] and (end := inner.find(b"\0", at)) > 0 and end + 5 <= len(inner):
        name, n = inner[at:end], struct.unpack_from(">I", inner, end + 1)[0]
        body = inner[end + 5 : end + 5 + n]
        if len(body) < n:
            break
        if name == b"COLOR" and n >= 4:
            out["color"] = int.from_bytes(body[1:4], "big")
        elif name == b"BPMLOCK" and n:
            out["locked"] = body[0] == 1
        elif name == b"CUE" and n >= 13:
            out["cues"].append({"index": body[1], "position_ms": struct.unpack_from(">I", body, 2)[0], "color": int.from_bytes(body[7:10], "big"), "name": body[12:].split(b"\0")[0].decode("utf-8", "replace")})
        at = end + 5 + n
    out["cues"].sort(key=lambda c: c["position_ms"])
    return out


def encode_geob(description: str, data: bytes, version: int = 3, mime: str = MIME, filename: str = "") -> bytes:
    body = b"\x03" + b"".join(x.encode() + b"\0" for x in (mime, filename, description)) + data
    size = to_synchsafe(len(body)) if version >= 4 else struct.pack(">I", len(body))
    return b"GEOB" + size + b"\0\0" + body


def _tag(data: bytes) -> tuple[int, int, int, int] | None:
    """(version, flags, where frames begin, where the tag ends)"""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] not in (3, 4):
        return None
    begin, end = 10, min(len(data), 10 + synchsafe(data[6:10]))
    if data[5] & 0x40 and end >= 14:
        begin += synchsafe(data[10:14]) if data[3] >= 4 else struct.unpack_from(">I", data, 10)[0] + 4
    return data[3], data[5], begin, end


def _frames(data: bytes):
    if (tag := _tag(data)) is None:
        return
    version, _, at, end = tag
    while at + 10 <= end and data[at] and (name := data[at : at + 4]).isalnum() and name == name.upper():
        n = synchsafe(data[at + 4 : at + 8]) if version >= 4 else struct.unpack_from(">I", data, at + 4)[0]
        if at + 10 + n > end:
            return
        yield name, data[at + 10 : at + 10 + n], at + 10 + n
        at += 10 + n


def read_geob(data: bytes) -> dict[str, bytes]:
    """Payloads by description; of several with one the last counts. Padding or a broken frame ends the scan."""
    out = {}
    for name, body, _ in _frames(data):
        if name == b"GEOB" and body[:1] in (b"\0", b"\3"):
            parts = body[1:].split(b"\0", 3)
            if len(parts) == 4:
                out[parts[2].decode("latin-1" if body[0] == 0 else "utf-8", "replace")] = parts[3]
    return out


def _strings(body: bytes) -> list[str]:
    """The strings of a text frame, whose first byte names their encoding."""
    encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else -1)
    if encoding is None:
        return []
    # each string of UTF-16 may have a mark of its byte order
    return [x.lstrip("\ufeff") for x in body[1:].decode(encoding, "replace").split("\0") if x.strip("\ufeff")]


def read_text(data: bytes) -> dict[str, list[str]]:
    """The strings of every text frame by its name; a user-defined one by TXXX: and its description."""
    out: dict[str, list[str]] = {}
    for name, body, _ in _frames(data):
        if name[:1] == b"T" and (found := _strings(body)):
            key = name.decode()
            if name == b"TXXX":
                key, found = f"TXXX:{found[0]}", found[1:]
            out.setdefault(key, found)
    return out


def encode_text(name: str, text: str, description: str | None = None) -> bytes:
    """A text frame in UTF-16; numbers are written in Latin-1. A comment has a language."""
    marked = lambda x: b"\xff\xfe" + x.encode("utf-16-le")
    if name in NUMBER_FRAMES:
        body = b"\0" + text.encode("latin-1", "replace")
    elif description is None:
        body = b"\x01" + marked(text)
    else:
        body = b"\x01" + (COMMENT_LANGUAGE if name == "COMM" else b"") + marked(description) + b"\0\0" + marked(text)
    return name.encode() + struct.pack(">I", len(body)) + b"\0\0" + body


def standard_tag(data: bytes, edits: dict[str, str]) -> bytes:
    """The file with a new tag of the edited fields alone, in place of the one it had."""
    body = b"".join(encode_text(FIELD_FRAMES[k][0], v, FIELD_FRAMES[k][1]) for k, v in edits.items()) + bytes(TAG_PADDING)
    tag = _tag(data)
    return b"ID3\x03\0\0" + to_synchsafe(len(body)) + body + (data if tag is None else data[tag[3] :])


def inject_geob(data: bytes, frames: dict[str, bytes]) -> bytes:
    """The file with the frames behind those it has, or with a new tag; same-named frames are not removed."""
    if (tag := _tag(data)) is None:
        body = b"".join(encode_geob(k, v) for k, v in frames.items()) + bytes(NEW_PADDING)
        return b"ID3\x03\0\0" + to_synchsafe(len(body)) + body + data
    version, flags, begin, end = tag
    last = max((stop for _, _, stop in _frames(data)), default=begin)
    body = data[begin:last] + b"".join(encode_geob(k, v, version) for k, v in frames.items()) + bytes(OLD_PADDING)
    return b"ID3" + bytes((version, data[4], flags & ~0x40)) + to_synchsafe(len(body)) + body + data[end:]


def payloads(bpm: float, beats: list[float], cues: list[dict], gain: float = 0.0, overview: bytes | None = None) -> dict[str, bytes]:
    """What a track's tag holds; a grid only with beats, an overview only if there is one."""
    out = {AUTOTAGS: encode_autotags(bpm, gain)}
    if beats:
        out[BEATGRID] = encode_beat_grid(beats, bpm)
    out[MARKERS] = encode_markers(cues)
    if overview:
        out[OVERVIEW] = overview
    return out
