"""Capture time, dimensions and camera facts from the bytes of photo and video files.

Readers fetch only the ranges they need (`Reader`), so a worker reads headers, not files. Byte layouts are those of JPEG, TIFF/EXIF and
ISO base media files. Everything here is plain Python that runs in Arrow-batched functions of sources/files.py.
"""

from __future__ import annotations

import hashlib
import re
import struct
from calendar import timegm
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.names import EXTENSIONS
from ..functions.times import EXIF, ISO, XMP_TAGS, XMP_VALUE

KIB, MIB = 1 << 10, 1 << 20
# Bytes of a TIFF value by type; tags of dates, each with its fraction's tag.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
DATE_TAGS = {0x9003: 0x9291, 0x9004: 0x9292, 0x0132: 0x9290}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
MAC_EPOCH = timegm((1904, 1, 1, 0, 0, 0))
CREATION_KEY = "com.apple.quicktime.creationdate"
TEXT_FACTS = {0x010F: "make", 0x0110: "model", 0x010E: "description", 0x0131: "software", 0x013B: "artist", 0x8298: "copyright", 0xA434: "lens"}
RATIO_FACTS = {0x829A: "exposure", 0x829D: "aperture", 0x920A: "focal", 0x9204: "bias"}
SHORT_FACTS = {0x8827: "iso", 0x8822: "program", 0x9207: "metering", 0x9209: "flash", 0xA403: "white_balance"}
SIZE_FACTS = {0xA405: "focal35", 0xA002: "width", 0x0100: "width", 0xA003: "height", 0x0101: "height"}
# Limits beyond which a structure counts as broken: entries and depth of TIFF directories for dates and for facts, bytes of a date's text and of a fact's, keys of QuickTime, and items of HEIF with their extents.
DATE_ENTRIES, DATE_DEPTH, DATE_BYTES = 512, 4, 2_000_000
FACT_ENTRIES, FACT_DEPTH, FACT_BYTES = 400, 6, 400
QUICKTIME_KEYS, HEIF_ITEMS, HEIF_EXTENTS = 400, 64, 8


@dataclass
class Capture:
    capture_ms: int
    subsec_known: bool
    source: str


@dataclass
class More:
    """A header that ends beyond the bytes at hand: how many bytes it takes."""

    need: int


class Reader:
    """Ranges of a file or of bytes; counts what it has read."""

    def __init__(self, source: str | bytes):
        self.read_bytes = 0
        if isinstance(source, bytes):
            self._file, self._data, self.size = None, source, len(source)
        else:
            self._file = open(source, "rb")
            self._data = b""
            self.size = self._file.seek(0, 2)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self._file:
            self._file.close()

    def read(self, at: int, n: int) -> bytes:
        if n <= 0:
            return b""
        if self._file:
            self._file.seek(at)
            out = self._file.read(n)
        else:
            out = self._data[at : at + n]
        self.read_bytes += len(out)
        return out


def wall_clock(fields: tuple[str, ...], fraction: str | None, source: str) -> Capture | None:
    y, mo, d, h, mi, s = map(int, fields)
    if not (1980 <= y <= 2100 and 1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and s <= 60):
        return None
    digits = re.sub(r"\D", "", fraction or "")[:3]
    days = timegm((y, mo, 1, 0, 0, 0)) // 86400 + d - 1  # a day past the month's end runs into the next month
    return Capture(((days * 24 + h) * 60 + mi) * 60000 + s * 1000 + int(digits.ljust(3, "0") or 0), bool(digits), source)


def exif_time(text: str | None, fraction: str | None) -> Capture | None:
    m = re.match(EXIF, (text or "").strip(), re.A)
    return wall_clock(m.groups(), fraction, "exif") if m else None


def iso_time(text: str | None, source: str) -> Capture | None:
    m = re.match(ISO, (text or "").strip(), re.A)
    return wall_clock(m.groups()[:6], m[7], source) if m else None


def xmp_time(text: str) -> Capture | None:
    for tag in XMP_TAGS:
        m = re.search(tag + XMP_VALUE, text, re.A)
        if m and (found := iso_time(m[1], "xmp")):
            return found
    return None


class Tiff:
    """A TIFF structure in memory: entries of its directories, those that entries lead to first."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        self.valid = len(data) >= 8 and self.order is not None and self.number(2, "H") == 42
        self.need = 0

    def number(self, at: int, kind: str) -> int | None:
        size = struct.calcsize(kind)
        return struct.unpack_from(self.order + kind, self.data, at)[0] if 0 <= at <= len(self.data) - size else None

    def short_or_long(self, kind: int, at: int) -> int | None:
        return self.number(at, "H" if kind == 3 else "I")

    def entries(self, lead: tuple[int, ...], most: int, deepest: int) -> Iterator[tuple[int, int, int, int]]:
        """tag, type, count and place of the value of each entry."""
        if not self.valid:
            return
        seen: set[int] = set()

        def walk(at: int | None, depth: int):
            if at is None or depth > deepest or at in seen:
                return
            count = self.number(at, "H")
            end = at + 2 + (count or 0) * 12 + 4
            if count is None or end > len(self.data):
                if count is None or count <= most:
                    self.need = max(self.need, at + 2 if count is None else end)
                return
            seen.add(at)
            if count > most:
                return
            for e in range(at + 2, at + 2 + count * 12, 12):
                tag, kind, n = self.number(e, "H"), self.number(e + 2, "H"), self.number(e + 4, "I")
                size = TYPE_SIZE.get(kind, 0)
                if not size:
                    continue
                if tag in lead and kind in (3, 4) and n:
                    inner = self.short_or_long(kind, e + 8)
                    if inner:
                        yield from walk(inner, depth + 1)
                    continue
                place = e + 8 if size * n <= 4 else self.number(e + 8, "I")
                yield tag, kind, n, place

        yield from walk(self.number(4, "I"), 0)

    def text(self, at: int, n: int, encoding: str = "latin1") -> str:
        return self.data[at : at + n].split(b"\0")[0].decode(encoding, "replace")

    def ratio(self, at: int, signed: bool = False) -> float | None:
        a, b = self.number(at, "i" if signed else "I"), self.number(at + 4, "i" if signed else "I")
        return a / b if a is not None and b else None


def tiff_capture(data: bytes) -> Capture | More | None:
    tiff = Tiff(data)
    dates: dict[int, str] = {}
    fractions: dict[int, str] = {}
    for tag, kind, n, at in tiff.entries((EXIF_IFD,), DATE_ENTRIES, DATE_DEPTH):
        if kind != 2 or n > DATE_BYTES or tag not in DATE_TAGS and tag not in DATE_TAGS.values():
            continue
        if at + min(n, 4) > len(data):
            tiff.need = max(tiff.need, at + n)
        elif tag in DATE_TAGS:
            if n >= 19 and at + 19 <= len(data):
                dates[tag] = tiff.text(at, min(n, 32))
        elif 0 < n < 16 and at + min(n, 8) <= len(data):
            fractions[tag] = tiff.text(at, n)
    first = next((t for t in DATE_TAGS if dates.get(t)), None)
    found = exif_time(dates[first], fractions.get(DATE_TAGS[first])) if first else None
    return found or (More(tiff.need) if tiff.need > len(data) else None)


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """marker, start and end of each segment up to the image's data; an end beyond the bytes is the last."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        while data[at + 1] == 0xFF and at + 2 < len(data):
            at += 1
        marker = data[at + 1]
        at += 2
        if marker in (0xD9, 0xDA):
            return
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2], "big") if at + 2 <= len(data) else 65535
        if size < 2:
            return
        yield marker, at, at + size
        at += size


def jpeg_capture(data: bytes) -> Capture | More | None:
    if data[:2] != b"\xff\xd8":
        return None
    xmp = None
    for marker, at, end in jpeg_segments(data):
        if end > len(data):
            return More(end + 2)
        body = data[at + 2 : end]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            found = tiff_capture(body[6:])
            if isinstance(found, Capture):
                return found
        elif marker == 0xE1 and xmp is None and body.startswith(b"http://ns.adobe.com/xap"):
            xmp = body.decode("utf8", "replace")
    return xmp_time(xmp) if xmp else None


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    end: int


def boxes(data: bytes, at: int, end: int) -> Iterator[Box]:
    """Boxes of an ISO base media file; a broken size ends them."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield Box(data[at + 4 : at + 8], at, at + head, at + size)
        at += size


def file_boxes(reader: Reader) -> Iterator[Box]:
    """The same over a file, of which only box headers are read."""
    at = 0
    while at + 8 <= reader.size:
        head = reader.read(at, 16)
        size, n = int.from_bytes(head[:4], "big"), 8
        if size == 1:
            size, n = int.from_bytes(head[8:16], "big"), 16
        size = size or reader.size - at
        if len(head) < n or size < n or at + size > reader.size:
            return
        yield Box(head[4:8], at, at + n, at + size)
        at += size


def movie_header(body: bytes) -> Capture | None:
    wide = {0: 4, 1: 8}.get(body[0] if body else None)
    if wide is None or len(body) < 4 + wide:
        return None
    ms = (int.from_bytes(body[4 : 4 + wide], "big") + MAC_EPOCH) * 1000
    return Capture(ms, False, "mvhd") if timegm((1980, 1, 1, 0, 0, 0)) * 1000 <= ms < timegm((2101, 1, 1, 0, 0, 0)) * 1000 else None


def quicktime_meta(data: bytes, box: Box) -> Capture | None:
    """The creation date among a meta box's keys and values."""
    keys: list[str] = []
    values: dict[int, str] = {}
    for b in boxes(data, box.body + 4, box.end):
        if b.kind == b"keys":
            at, count = b.body + 8, int.from_bytes(data[b.body + 4 : b.body + 8], "big")
            while count <= QUICKTIME_KEYS and len(keys) < count and at + 8 <= b.end:
                size = int.from_bytes(data[at : at + 4], "big")
                if size < 8 or at + size > b.end:
                    break
                keys.append(data[at + 8 : at + size].replace(b"\0", b"").decode("utf8", "replace"))
                at += size
        elif b.kind == b"ilst":
            for item in boxes(data, b.body, b.end):
                for d in boxes(data, item.body, item.end):
                    if d.kind == b"data" and d.body + 8 <= d.end and data[d.body : d.body + 4] == b"\0\0\0\1":
                        text = data[d.body + 8 : d.end].replace(b"\0", b"").decode("utf8", "replace").strip()
                        if text:
                            values[int.from_bytes(item.kind, "big")] = text
                        break
    return next((t for i, k in enumerate(keys, 1) if k == CREATION_KEY and (t := iso_time(values.get(i), "quicktime"))), None)


def movie_capture(data: bytes) -> Capture | None:
    """The QuickTime creation date in a movie box's content, else the movie header's time."""
    found: dict[str, Capture] = {}

    def visit(start: int, end: int, depth: int):
        for b in boxes(data, start, end):
            if b.kind == b"mvhd" and "mvhd" not in found and (t := movie_header(data[b.body : b.end])):
                found["mvhd"] = t
            if b.kind == b"meta" and (t := quicktime_meta(data, b)):
                found["quicktime"] = t
            if b.kind in (b"moov", b"trak", b"mdia", b"minf", b"udta", b"edts") and "quicktime" not in found and depth < 6:
                visit(b.body, b.end, depth + 1)

    visit(0, len(data), 0)
    return found.get("quicktime") or found.get("mvhd")


def exif_items(meta: bytes, body: int) -> Iterator[tuple[int, int]]:
    """Offset and length of the Exif items that a HEIF meta box names."""
    tables = {b.kind: meta[b.body : b.end] for b in boxes(meta, body + 4, len(meta))}
    info, place = tables.get(b"iinf", b""), tables.get(b"iloc", b"")
    wanted: set[int] = set()
    if len(info) >= 6 and int.from_bytes(info[4:6], "big") <= HEIF_ITEMS:
        for b in boxes(info, 6, len(info)):
            version = info[b.body] if b.body < b.end else 0
            wide = 2 if version == 2 else 4
            if b.kind == b"infe" and version >= 2 and info[b.body + 6 + wide : b.body + 10 + wide] == b"Exif":
                wanted.add(int.from_bytes(info[b.body + 4 : b.body + 4 + wide], "big"))
    if len(place) < 8 or not wanted:
        return
    version, sizes = place[0], (place[4] >> 4, place[4] & 15, place[5] >> 4, place[5] & 15 if place[0] in (1, 2) else 0)
    at = 6

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(place) or n > 8:
            raise EOFError
        at += n
        return int.from_bytes(place[at - n : at], "big")

    try:
        count = take(2 if version < 2 else 4)
        for _ in range(count if count <= HEIF_ITEMS else 0):
            item = take(2 if version < 2 else 4)
            method = take(2) & 15 if version in (1, 2) else 0
            take(2)
            base, extents = take(sizes[2]), take(2)
            if extents > HEIF_EXTENTS:
                return
            for _ in range(extents):
                take(sizes[3])
                start, length = base + take(sizes[0]), take(sizes[1])
                if item in wanted and method == 0 and 0 < length <= 2 * MIB:
                    yield start, length
    except EOFError:
        return


def exif_payload(payload: bytes) -> Capture | None:
    """An Exif item: the TIFF structure begins after an offset that stands first, or somewhere near."""
    prefix = int.from_bytes(payload[:4], "big")
    marker = payload.find(b"Exif\0\0")
    for start in (4 + prefix, prefix, 0, *([marker + 6] if marker >= 0 else [])):
        if len(payload) >= 16 and start + 8 <= len(payload) and isinstance(t := tiff_capture(payload[start:]), Capture):
            return t
    return None


def embedded_capture(data: bytes) -> Capture | None:
    """The time of a JPEG or TIFF structure that stands inside, or of XMP text."""
    at = data.find(b"\xff\xd8\xff")
    if at >= 0 and isinstance(t := jpeg_capture(data[at:]), Capture):
        return t
    for m in list(re.finditer(rb"II\x2a\0|MM\0\x2a", data))[:6]:
        if isinstance(t := tiff_capture(data[m.start() :]), Capture):
            return t
    return xmp_time(data.decode("latin1"))


def still_capture(reader: Reader) -> Capture | None:
    data = reader.read(0, min(reader.size, 256 * KIB))
    parse = jpeg_capture if data[:2] == b"\xff\xd8" else tiff_capture if data[:2] in (b"II", b"MM") else None
    if parse:
        found = parse(data)
        if isinstance(found, More) and len(data) < found.need <= min(reader.size, 8 * MIB):
            found = parse(reader.read(0, found.need))
        if isinstance(found, Capture):
            return found
    return embedded_capture(reader.read(0, min(reader.size, 4 * MIB))) if data[:8] == b"FUJIFILM" else None


def bmff_capture(reader: Reader) -> Capture | None:
    if reader.read(0, 12)[4:8] != b"ftyp":
        return None
    for b in file_boxes(reader):
        size = b.end - b.start
        if b.kind == b"meta" and size <= 8 * MIB:
            for at, n in exif_items(reader.read(b.start, size), b.body - b.start):
                if at + n <= reader.size and (t := exif_payload(reader.read(at, n))):
                    return t
        elif b.kind == b"moov" and size <= 16 * MIB:
            data = reader.read(b.body, b.end - b.body)
            if t := movie_capture(data) or embedded_capture(data):
                return t
    return None


def video_capture(reader: Reader) -> Capture | None:
    header = None
    for top in file_boxes(reader):
        if top.kind != b"moov":
            continue
        at = top.body
        while at + 8 <= top.end:  # only headers of what the movie box holds, and its user data
            head = reader.read(at, 16)
            size = int.from_bytes(head[:4], "big") or top.end - at
            n = 8
            if size == 1:
                size, n = int.from_bytes(head[8:16], "big"), 16
            if size < n or at + size > top.end:
                break
            if head[4:8] == b"mvhd" and header is None:
                header = movie_header(reader.read(at + n, min(120, size - n)))
            elif head[4:8] == b"udta" and size <= 6 * MIB:
                data = reader.read(at + n, size - n)
                for b in boxes(data, 0, len(data)):
                    if b.kind == b"meta" and (t := quicktime_meta(data, b)):
                        return t
                key = data.find(CREATION_KEY.encode())
                if key >= 0 and (m := re.search(rb"2.*", data[key : key + 512], re.S)) and (t := iso_time(m[0].decode("latin1"), "quicktime")):
                    return t
            at += size
    return header


def read_capture(source: str | bytes, ext: str) -> tuple[Capture | None, int]:
    """The capture time, and how many bytes were read for it; none if anything is broken."""
    try:
        with Reader(source) as r:
            try:
                found = video_capture(r) if ext.lower() in EXTENSIONS["video"] else still_capture(r) or bmff_capture(r)
            except (struct.error, IndexError, ValueError, OverflowError):
                found = None
            return found, r.read_bytes
    except OSError:
        return None, 0


def tiff_facts(data: bytes) -> dict | None:
    tiff = Tiff(data)
    if not tiff.valid:
        return None
    facts: dict = {}
    angle: dict[int, float] = {}
    refs: dict[int, str] = {}
    for tag, kind, n, at in tiff.entries((EXIF_IFD, GPS_IFD), FACT_ENTRIES, FACT_DEPTH):
        if at is None or n <= 0:
            continue
        text = tiff.text(at, n, "utf8").strip() if n <= FACT_BYTES and at + n <= len(data) else ""
        if tag in TEXT_FACTS:
            facts[TEXT_FACTS[tag]] = text
        elif tag in (0x9003, 0x0132):
            facts["time"] = facts.get("time") or text
        elif tag in RATIO_FACTS:
            facts[RATIO_FACTS[tag]] = tiff.ratio(at, tag == 0x9204)
        elif tag in SHORT_FACTS and kind == 3:
            facts[SHORT_FACTS[tag]] = tiff.number(at, "H")
        elif tag in SIZE_FACTS and kind in (3, 4):
            facts[SIZE_FACTS[tag]] = tiff.short_or_long(kind, at)
        elif tag in (2, 4) and kind == 5 and n >= 3:
            d, m, s = (tiff.ratio(at + k) for k in (0, 8, 16))
            if None not in (d, m, s):
                angle[tag] = d + m / 60 + s / 3600
        elif tag in (1, 3):
            refs[tag] = text
    for tag, name, minus in ((2, "latitude", "S"), (4, "longitude", "W")):
        if tag in angle:
            facts[name] = -angle[tag] if refs.get(tag - 1) == minus else angle[tag]
    return facts


def jpeg_facts(data: bytes) -> dict:
    facts, size = {}, None
    for marker, at, end in jpeg_segments(data):
        if end > len(data):
            break
        if marker == 0xE1 and data[at + 2 : at + 8] == b"Exif\0\0":
            facts = tiff_facts(data[at + 8 : end]) or facts
        elif size is None and 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            size = struct.unpack_from(">HH", data, at + 3)
    if size and not facts.get("width"):
        facts["height"], facts["width"] = size
    return facts


def photo_facts(data: bytes) -> dict:
    """Camera facts from a photo's first bytes."""
    if data[:2] == b"\xff\xd8":
        return jpeg_facts(data)
    if data[:2] in (b"II", b"MM"):
        return tiff_facts(data) or {}
    at = data.find(b"Exif\0\0")
    return (tiff_facts(data[at + 6 :]) or {}) if at >= 0 else {}


def video_size(data: bytes) -> tuple[int, int]:
    """The widest track's width and height."""
    best, at = (0, 0), data.find(b"tkhd")
    while 0 <= at <= len(data) - 96:
        place = {0: at + 80, 1: at + 92}.get(data[at + 4])
        if place and place + 8 <= len(data):
            w, h = (x / 65536 for x in struct.unpack_from(">II", data, place))
            if best[0] < w < 20000 and 0 < h < 20000:
                best = (int(w + 0.5), int(h + 0.5))
        at = data.find(b"tkhd", at + 4)
    return best


def probe(source: str | bytes, ext: str) -> tuple[int, int, str]:
    """Width, height, and the text that an origin can be told from; zeros and nothing if the file cannot be read."""
    try:
        with Reader(source) as r:
            if ext.lower() not in EXTENSIONS["video"]:
                f = photo_facts(r.read(0, 768 * KIB))
                return f.get("width") or 0, f.get("height") or 0, " ".join(filter(None, (f.get("make"), f.get("model"), f.get("lens"))))
            head = r.read(0, 2 * MIB)
            tail = r.read(max(len(head), r.size - 2 * MIB), 2 * MIB) if r.size > len(head) + KIB else b""
            w, h = video_size(head + tail)
            return w, h, (head[: 256 * KIB] + tail[: 256 * KIB]).decode("latin1")
    except (OSError, struct.error, IndexError):
        return 0, 0, ""


def duration(data: bytes) -> float:
    """Seconds of the first movie header that makes sense, or 0."""
    for m in re.finditer(b"mvhd", data):
        at, version = m.start(), data[m.start() + 4] if m.start() + 28 < len(data) else None
        if version == 0:
            scale, length = struct.unpack_from(">II", data, at + 16)
        elif version == 1 and at + 36 < len(data):
            scale, length = struct.unpack_from(">IQ", data, at + 24)
        else:
            continue
        if scale and length and 0.1 <= length / scale <= 86400:
            return length / scale
    return 0.0


def content_hash(source: str | bytes, chunk: int = 8 * MIB) -> str | None:
    """BLAKE2b-512 of a file in pieces."""
    h = hashlib.blake2b()
    if isinstance(source, bytes):
        h.update(source)
        return h.hexdigest()
    try:
        with open(source, "rb") as f:
            while piece := f.read(chunk):
                h.update(piece)
    except OSError:
        return None
    return h.hexdigest()


@dataclass
class Decoded:
    """What a pass over a catalogue gathers of a file."""

    capture: Capture | None = None
    width: int = 0
    height: int = 0
    text: str = ""
    facts: dict = field(default_factory=dict)
