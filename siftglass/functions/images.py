"""PNG and JPEG containers and EXIF fields, read and written byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
JPEG_MAGIC = b"\xff\xd8"
# Parts that carry metadata, and those that a strip removes.
PNG_METADATA = ("tEXt", "iTXt", "zTXt", "eXIf", "tIME", "iCCP")
PNG_STRIPPED = ("tEXt", "iTXt", "zTXt", "eXIf", "tIME", "caBX")
JPEG_STRIPPED = (0xE1, 0xED, 0xEB, 0xEF, 0xFE)
JPEG_NAMES = {
    0xE0: "APP0 (JFIF)",
    0xE1: "APP1 (Exif/XMP)",
    0xE2: "APP2 (ICC/FlashPix)",
    0xEB: "APP11 (JUMBF)",
    0xED: "APP13 (Photoshop IRB/IPTC)",
    0xEE: "APP14 (Adobe)",
    0xFE: "COM (comment)",
}
MAX_VALUE = 200


class Chunk(NamedTuple):
    """A part of a container: its name, where it starts, where its payload lies, and where it ends."""

    kind: str
    start: int
    body: int
    body_end: int
    end: int


def png_chunks(data: bytes, with_checksum: bool) -> Iterator[Chunk]:
    """The chunks up to IEND; with a checksum wanted, one that is cut off before its end doesn't count."""
    at = len(PNG_MAGIC)
    while len(data) - at >= 8:
        body = at + 8
        body_end = body + int.from_bytes(data[at : at + 4], "big")
        end = body_end + 4
        if (end if with_checksum else body_end) > len(data):
            return
        kind = data[at + 4 : body].decode("ascii", "replace")
        yield Chunk(kind, at, body, body_end, end)
        if kind == "IEND":
            return
        at = end


class Segment(NamedTuple):
    """A JPEG segment: its marker, where it starts, its payload and where it ends; the scan has no end."""

    marker: int
    start: int
    body: int
    end: int


SCAN = 0xDA


def jpeg_segments(data: bytes, skip_bare_markers: bool) -> Iterator[Segment]:
    """The segments up to the scan, which comes last if it is reached."""
    at = 2
    while len(data) - at >= 4 and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == SCAN:
            yield Segment(marker, at, at, len(data))
            return
        if skip_bare_markers and (marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7):
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        end = at + 2 + size
        if size < 2 or end > len(data):
            return
        yield Segment(marker, at, at + 4, end)
        at = end


def _shown(value: bytes) -> str:
    return value.decode("utf-8", "replace")[:MAX_VALUE]


def png_entries(data: bytes) -> tuple[int, list[str], dict[str, str]] | None:
    """How many metadata chunks a PNG has, their kinds, and its texts by keyword; null if no chunk can be read."""
    chunks = list(png_chunks(data, with_checksum=False))
    if not chunks:
        return None
    kinds: list[str] = []
    entries: dict[str, str] = {}
    for c in chunks:
        if c.kind not in PNG_METADATA:
            continue
        kinds.append(c.kind)
        keyword, nul, rest = data[c.body : c.body_end].partition(b"\0")
        if c.kind == "zTXt":
            entries[_shown(keyword)] = "<compressed>"
        elif nul and c.kind in ("tEXt", "iTXt"):
            entries[_shown(keyword)] = _shown(rest if c.kind == "tEXt" else rest.split(b"\0")[-1])
    return len(kinds), sorted(set(kinds)), entries


def jpeg_names(data: bytes) -> tuple[dict[str, int], dict[str, object]]:
    """How often each kind of segment occurs before the scan, and the fields of the first readable EXIF block."""
    counts: dict[str, int] = {}
    fields: dict[str, object] = {}
    for s in jpeg_segments(data, skip_bare_markers=True):
        if s.marker == SCAN:
            break
        payload = data[s.body : s.end]
        if payload.startswith(b"http://ns.adobe.com/xap/1.0/"):
            name = "APP1 (XMP)"
        elif payload.startswith(EXIF_MAGIC):
            name = "APP1 (Exif)"
            fields = fields or exif_fields(payload)
        else:
            name = JPEG_NAMES.get(s.marker) or (f"APP{s.marker - 0xE0}" if s.marker >= 0xE0 else "other")
        counts[name] = counts.get(name, 0) + 1
    return counts, fields


def has_png_credential(data: bytes) -> bool:
    """Whether a PNG has a chunk for content credentials."""
    return any(c.kind == "caBX" for c in png_chunks(data, with_checksum=False))


def has_jpeg_credential(data: bytes) -> bool:
    """Whether a JPEG has a segment that begins like a box of content credentials."""
    return any(s.marker == 0xEB and b"jumb" in data[s.body : min(s.body + 64, s.end)] for s in jpeg_segments(data, skip_bare_markers=True))


def strip_png(data: bytes) -> tuple[bytes, list[str]]:
    """A PNG without its metadata chunks, and which went."""
    kept, gone = [PNG_MAGIC], []
    for c in png_chunks(data, with_checksum=True):
        if c.kind in PNG_STRIPPED:
            gone.append(c.kind)
        else:
            kept.append(data[c.start : c.end])
    return b"".join(kept), gone


def strip_jpeg(data: bytes) -> tuple[bytes, list[str]]:
    """A JPEG without its metadata segments, and which went; without a scan it stays as it is."""
    kept, gone = [JPEG_MAGIC], []
    for s in jpeg_segments(data, skip_bare_markers=False):
        if s.marker == SCAN:
            return b"".join([*kept, data[s.start :]]), gone
        if s.marker in JPEG_STRIPPED:
            gone.append(f"APP{s.marker - 0xE0}")
        else:
            kept.append(data[s.start : s.end])
    return data, []


def pixel_digest(data: bytes) -> str | None:
    """The digest of what makes the picture; empty for a JPEG without a scan, null for other data."""
    if data.startswith(PNG_MAGIC):
        digest = hashlib.sha256()
        for c in png_chunks(data, with_checksum=True):
            if c.kind == "IDAT":
                digest.update(data[c.body : c.body_end])
        return digest.hexdigest()
    if data.startswith(JPEG_MAGIC):
        for s in jpeg_segments(data, skip_bare_markers=False):
            if s.marker == SCAN:
                return hashlib.sha256(data[s.start :]).hexdigest()
        return ""
    return None


EXIF_MAGIC = b"Exif\0\0"
# Types of fields, and what each tag of a directory means.
TEXT, LONG, RATIONAL = 2, 4, 5
EXIF_TAGS = {
    ("main", 0x010F, TEXT): "camera make",
    ("main", 0x0110, TEXT): "camera model",
    ("main", 0x0131, TEXT): "software",
    ("main", 0x0132, TEXT): "date/time",
    ("main", 0x013B, TEXT): "artist",
    ("photo", 0x9003, TEXT): "date/time original",
    ("place", 0x0001, TEXT): "gps_latitude_side",
    ("place", 0x0002, RATIONAL): "gps_latitude",
    ("place", 0x0003, TEXT): "gps_longitude_side",
    ("place", 0x0004, RATIONAL): "gps_longitude",
}
EXIF_DIRECTORIES = {("main", 0x8769, LONG): "photo", ("main", 0x8825, LONG): "place"}
#: Sides of the globe whose degrees are negative.
NEGATIVE_SIDES = ("S", "W")


class _Tiff:
    """Fields of a TIFF stream; whatever lies outside it reads as nothing."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = {b"II": "little", b"MM": "big"}.get(data[:2]) if len(data) >= 8 else None

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], self.order)  # type: ignore[arg-type]

    def directory(self, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(tag, type, count, place of the value field) of each entry; none at place zero, where the header is."""
        if not at or at + 2 > len(self.data):
            return
        for k in range(self.number(at, 2)):
            entry = at + 2 + 12 * k
            if entry + 12 > len(self.data):
                return
            yield self.number(entry, 2), self.number(entry + 2, 2), self.number(entry + 4, 4), entry + 8

    def value(self, size: int, place: int) -> bytes:
        """The bytes of a value, which stand in its field if they fit."""
        start = place if size <= 4 else self.number(place, 4)
        return self.data[start : start + size] if start + size <= len(self.data) else b""

    def read(self, kind: int, count: int, place: int) -> str | float | None:
        """A text, or degrees, minutes and seconds as one number; null if there is none."""
        if kind == TEXT:
            return self.value(count, place).split(b"\0")[0].decode("ascii", "replace") or None
        raw = self.value(8 * count, place)
        numbers = [int.from_bytes(raw[k : k + 4], self.order) for k in range(0, len(raw), 4)]  # type: ignore[arg-type]
        parts = [a / b if b else 0.0 for a, b in zip(numbers[::2], numbers[1::2], strict=True)]
        return sum(p / 60**k for k, p in enumerate(parts[:3])) if len(parts) >= 3 else None


def exif_fields(payload: bytes) -> dict[str, object]:
    """The private fields of an EXIF block: camera, software, times, artist, place.

    Directories wait in a list; what a field means, and whether it leads to another directory, is looked up by
    directory, tag and type.  A place counts only with both coordinates.
    """
    tiff = _Tiff(payload[len(EXIF_MAGIC) :])
    if not payload.startswith(EXIF_MAGIC) or tiff.order is None:
        return {}
    found: dict[str, object] = {}
    waiting = [("main", tiff.number(4, 4))]
    for name, at in waiting:
        for tag, kind, count, place in tiff.directory(at):
            meaning = name, tag, kind
            if meaning in EXIF_DIRECTORIES:
                waiting.append((EXIF_DIRECTORIES[meaning], tiff.number(place, 4)))
            elif meaning in EXIF_TAGS and (value := tiff.read(kind, count, place)) is not None:
                found[EXIF_TAGS[meaning]] = value
    placed = [n for n in ("gps_latitude", "gps_longitude") if n in found]
    degrees = {n: round(float(found[n]) * (-1 if str(found.get(f"{n}_side", "")).upper() in NEGATIVE_SIDES else 1), 6) for n in placed}  # type: ignore[arg-type]
    return {n: v for n, v in found.items() if not n.startswith("gps_")} | (degrees if len(placed) == 2 else {})
