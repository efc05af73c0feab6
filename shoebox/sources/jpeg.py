"""Small grey pictures of JPEG files, for fingerprints: one value for each block of eight by eight, from the DC coefficients alone.

No coefficient is transformed. Baseline files are read symbol by symbol, of which only DC values are kept; of progressive files the first scans that hold DC values are enough. Arithmetic coding, lossless and 12-bit files,
and four colours are not read. A picture of a thousand pixels or more on each edge loses nothing that its fingerprint could show, as decoders that shrink while they decode also take an eighth of it; in a smaller one a few
bits where neighbours are about equally bright may differ from those of all pixels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

MIB = 1 << 20
#: A raw file's preview is looked for in as many bytes (a fixed value).
PREVIEW_BYTES = 8 * MIB
#: Weights of red, green and blue in grey (fixed values).
GREY = (0.299, 0.587, 0.114)
ORIENTATION = 0x0112


class Broken(ValueError):
    """Bytes that are no JPEG file, or one of a kind that is not read."""


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next the symbol that begins them and its length, as symbol * 32 + length; 0 for bits that no code begins."""
    table, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first + (1 << (16 - length)) > 65536 or k >= len(symbols):
                raise Broken("codes")
            table[first : first + (1 << (16 - length))] = [symbols[k] * 32 + length] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    """The bits of one restart interval, without stuffing; beyond the end come ones, and then it is an error."""

    __slots__ = ("at", "data", "held", "n", "over")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.over = data, 0, 0, 0, 0

    def fill(self) -> None:
        piece = self.data[self.at : self.at + 8]
        self.at += 8
        if len(piece) < 8:
            self.over += 8 - len(piece)
            if self.over > 16:
                raise Broken("the file ends within the picture")
            piece += b"\xff" * (8 - len(piece))
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(piece, "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 32:
            self.fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise Broken("no code")
        self.n -= found & 31
        return found >> 5

    def number(self, size: int) -> int:
        """A difference of so many bits: those that begin with 0 stand for negative ones."""
        if not size:
            return 0
        if size > 16:
            raise Broken("a difference of too many bits")
        if self.n < 32:
            self.fill()
        self.n -= size
        value = self.held >> self.n & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


class _Picture:
    """Frame, tables and DC values of a file."""

    def __init__(self, data: bytes):
        self.data, self.tables, self.steps = data, {}, {}
        self.components: dict[int, dict] = {}
        self.interval, self.progressive, self.rgb, self.turn = 0, False, False, 1
        self.width = self.height = 0

    def frame(self, marker: int, at: int) -> None:
        d = self.data
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", d, at)
        if depth != 8 or n not in (1, 3) or not self.height or not self.width:
            raise Broken("a frame that is not read")
        self.progressive = marker == 0xC2
        for i in range(n):
            c, hv, q = d[at + 6 + 3 * i : at + 9 + 3 * i]
            if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4):
                raise Broken("sampling")
            self.components[c] = {"h": hv >> 4, "v": hv & 15, "q": q}
        self.most_h, self.most_v = max(c["h"] for c in self.components.values()), max(c["v"] for c in self.components.values())
        self.across, self.down = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        for c in self.components.values():
            # blocks with all of the picture in them, and those of whole interleaved units
            c["wide"], c["high"] = -(-(-(-self.width * c["h"] // self.most_h)) // 8), -(-(-(-self.height * c["v"] // self.most_v)) // 8)
            c["dc"] = np.zeros((self.down * c["v"], self.across * c["h"]))

    def scan(self, at: int, size: int) -> int:
        """Read a scan's DC values; the place after it."""
        d = self.data
        n = d[at]
        chosen = [(self.components[d[at + 1 + 2 * i]], d[at + 2 + 2 * i]) for i in range(n)]
        begin, end, bits = d[at + 1 + 2 * n], d[at + 2 + 2 * n], d[at + 3 + 2 * n]
        start = at + size
        after, pieces = self._pieces(start)
        if self.progressive and (begin or bits >> 4):  # AC values, or a DC scan that only refines
            return after
        shift = bits & 15 if self.progressive else 0
        for c, _ in chosen:
            c["seen"] = True
        total, places = self._places([c for c, _ in chosen])
        plan = [(c["dc"], self.tables[0, t >> 4], None if self.progressive else self.tables[1, t & 15]) for c, t in chosen]
        k, every = 0, self.interval or total
        for piece in pieces:
            bits_, last = _Bits(piece), [0] * n
            for unit in islice(places, min(every, total - k)):
                for i, y, x in unit:
                    dc, first, rest = plan[i]
                    last[i] += bits_.number(bits_.symbol(first))
                    dc[y, x] = last[i] * (1 << shift)
                    if rest is not None:
                        j = 1
                        while j < 64:
                            s = bits_.symbol(rest)
                            if s & 15:
                                if bits_.n < 32:
                                    bits_.fill()
                                bits_.n -= s & 15
                                j += (s >> 4) + 1
                            elif s == 0xF0:
                                j += 16
                            else:
                                break
                k += 1
        if k < total:
            raise Broken("the file ends within the picture")
        return after

    def _places(self, chosen: list[dict]) -> tuple[int, Iterator[list[tuple[int, int, int]]]]:
        """How many units a scan has, and of each its blocks: which of the scan's components, row and column."""
        if len(chosen) == 1:
            high, wide = chosen[0]["high"], chosen[0]["wide"]
            return high * wide, ([(0, y, x)] for y in range(high) for x in range(wide))
        inside = [(i, v, h, c["v"], c["h"]) for i, c in enumerate(chosen) for v in range(c["v"]) for h in range(c["h"])]
        return self.down * self.across, ([(i, y * cv + v, x * ch + h) for i, v, h, cv, ch in inside] for y in range(self.down) for x in range(self.across))

    def _pieces(self, start: int) -> tuple[int, list[bytes]]:
        """The place of the marker after a scan, and the scan's restart intervals without stuffing."""
        d, at, cut = self.data, start, [start]
        while True:
            at = d.find(b"\xff", at)
            if at < 0 or at + 1 >= len(d):
                at = len(d)
                break
            follows = d[at + 1]
            if 0xD0 <= follows <= 0xD7:
                cut.append(at + 2)
            elif follows == 0xFF:
                at += 1
                continue
            elif follows:
                break
            at += 2
        ends = [c - 2 for c in cut[1:]] + [at]
        return at, [d[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(cut, ends, strict=True)]

    def read(self) -> None:
        d, at = self.data, 2
        while at + 4 <= len(d):
            if d[at] != 0xFF:
                at = d.find(b"\xff", at)
                if at < 0:
                    break
                continue
            marker = d[at + 1]
            at += 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                break
            if marker in (0, 1) or 0xD0 <= marker <= 0xD8:
                continue
            size = int.from_bytes(d[at : at + 2], "big")
            if size < 2 or at + size > len(d):
                raise Broken("a segment beyond the end")
            body, end = at + 2, at + size
            if marker == 0xC4:
                while body + 17 <= end:
                    counts = d[body + 1 : body + 17]
                    self.tables[d[body] >> 4, d[body] & 15] = _lookup(counts, d[body + 17 : body + 17 + sum(counts)])
                    body += 17 + sum(counts)
            elif marker == 0xDB:
                while body < end:
                    wide = 2 if d[body] >> 4 else 1
                    self.steps[d[body] & 15] = int.from_bytes(d[body + 1 : body + 1 + wide], "big")
                    body += 1 + 64 * wide
            elif marker == 0xDD:
                self.interval = int.from_bytes(d[body : body + 2], "big")
            elif marker in (0xC0, 0xC1, 0xC2):
                self.frame(marker, body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise Broken("a coding that is not read")
            elif marker == 0xEE and d[body : body + 5] == b"Adobe" and size >= 14:
                self.rgb = d[body + 11] == 0
            elif marker == 0xE1 and d[body : body + 6] == b"Exif\0\0":
                self.turn = orientation(d[body + 6 : end]) or self.turn
            elif marker == 0xDA:
                if not self.components:
                    raise Broken("no frame")
                at = self.scan(body, size - 2)
                if self.progressive and all("seen" in c for c in self.components.values()):
                    return
                continue
            at = end
        if not self.components or not all("seen" in c for c in self.components.values()):
            raise Broken("no picture")

    def grey(self) -> np.ndarray:
        """A value from 0 to 255 for each block."""

        def plane(c: dict) -> np.ndarray:
            values = np.clip(np.floor(c["dc"] * self.steps.get(c["q"], 1) / 8 + 128.5), 0, 255)[: c["high"], : c["wide"]]
            return values.repeat(self.most_v // c["v"], 0).repeat(self.most_h // c["h"], 1) if self.rgb else values

        parts = [plane(c) for c in self.components.values()]
        if self.rgb and len(parts) == 3:
            rows, columns = min(p.shape[0] for p in parts), min(p.shape[1] for p in parts)
            return np.floor(sum(w * p[:rows, :columns] for w, p in zip(GREY, parts, strict=True)) + 0.5)
        return parts[0]


def orientation(tiff: bytes) -> int | None:
    """How a picture is turned, 1 to 8, from the first directory of a TIFF structure."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 10:
        return None
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return None
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        e = at + 2 + 12 * i
        if e + 12 > len(tiff):
            return None
        tag, kind = struct.unpack_from(order + "HH", tiff, e)
        if tag == ORIENTATION:
            value = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, e + 8)[0]
            return value if 1 <= value <= 8 else None
    return None


def turned(picture: np.ndarray, how: int) -> np.ndarray:
    """The picture as it is to be seen."""
    if how >= 5:
        picture = picture.T
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(how, ())
    return np.flip(picture, flips) if flips else picture


@dataclass(frozen=True)
class Small:
    """A grey picture with a value for each block as it is stored, its height and width in blocks (the last ones may be partly outside), and how it is turned."""

    picture: np.ndarray
    extent: tuple[float, float]
    turn: int


def small_grey(data: bytes) -> Small:
    if data[:2] != b"\xff\xd8":
        raise Broken("no JPEG file")
    p = _Picture(data)
    try:
        p.read()
    except (IndexError, KeyError, struct.error) as e:
        raise Broken("cut off") from e
    c = next(iter(p.components.values()))
    return Small(p.grey(), (p.height * c["v"] / p.most_v / 8, p.width * c["h"] / p.most_h / 8) if not p.rgb else (p.height / 8, p.width / 8), p.turn)


def resized(picture: np.ndarray, width: int, height: int, extent: tuple[float, float] | None = None) -> np.ndarray:
    """The picture, or as much of it as extent says, in another size by a Lanczos filter of three lobes, as wide as what it shrinks; values stay whole."""
    tall, broad = extent or picture.shape

    def weights(n: int, out: int, size: float) -> np.ndarray:
        scale = size / out
        wide = max(scale, 1.0)
        middle = (np.arange(out)[:, None] + 0.5) * scale
        x = (np.arange(n)[None, :] + 0.5 - middle) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
        return w / w.sum(1, keepdims=True)

    whole = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    across = whole(picture @ weights(picture.shape[1], width, broad).T)
    return whole(weights(picture.shape[0], height, tall) @ across)


def difference_hash(picture: np.ndarray, extent: tuple[float, float] | None = None, turn: int = 1) -> int:
    """64 bits, row by row: whether a pixel of the upright picture, shrunk to nine by eight, is brighter than the one to its left. As a signed number."""
    p = turned(resized(picture, *((9, 8) if turn < 5 else (8, 9)), extent), turn)
    bits = int("".join("1" if b else "0" for b in (p[:, 1:] > p[:, :-1]).ravel()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(data: bytes) -> int | None:
    """The difference hash of a JPEG file, or of the first one inside the beginning of another file, such as a raw file's preview; null if there is none that can be read."""
    inside = data.find(b"\xff\xd8\xff", 0, PREVIEW_BYTES)
    for piece in (data, data[inside:PREVIEW_BYTES] if inside > 0 else b""):
        try:
            small = small_grey(piece)
        except Broken:
            continue
        return difference_hash(small.picture, small.extent, small.turn)
    return None
