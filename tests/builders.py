"""Small synthetic media files."""

import struct

import numpy as np


def tiff(date=b"2020:01:02 03:04:05", sub=b"12", order="<"):
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(order + "HI", 42, 8)
    ifd0 = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x8769, 4, 1, 26) + bytes(4)
    entries = [(0x9003, 2, 20, date + b"\0")] + ([(0x9291, 2, len(sub) + 1, sub + b"\0")] if sub else [])
    base = 26 + 2 + 12 * len(entries) + 4
    exif, data = struct.pack(order + "H", len(entries)), b""
    for tag, kind, n, value in entries:
        if n <= 4:
            exif += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
        else:
            exif += struct.pack(order + "HHII", tag, kind, n, base + len(data))
            data += value
    return head + ifd0 + exif + bytes(4) + data


def jpeg(exif=None, size=(640, 480), payload=b"x" * 1000):
    body = b"Exif\0\0" + (exif if exif is not None else tiff())
    app1 = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, size[1], size[0], 1) + b"\1\x11\0"
    return b"\xff\xd8" + app1 + sof + b"\xff\xda\0\2" + payload + b"\xff\xd9"


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(created=3_660_000_000, date=None, payload=b"m" * 5000):
    mvhd = box(b"mvhd", bytes(4) + struct.pack(">IIII", created, 0, 1000, 5000) + bytes(80))
    inner = mvhd
    if date:
        key = b"com.apple.quicktime.creationdate"
        keys = box(b"keys", bytes(4) + struct.pack(">I", 1) + struct.pack(">I", len(key) + 8) + b"mdta" + key)
        ilst = box(b"ilst", box(struct.pack(">I", 1), box(b"data", struct.pack(">II", 1, 0) + date)))
        inner += box(b"udta", box(b"meta", bytes(4) + keys + ilst))
    return box(b"ftyp", b"isom" + bytes(4)) + box(b"mdat", payload) + box(b"moov", inner)


def heic():
    payload = struct.pack(">I", 6) + b"Exif\0\0" + tiff()
    infe = box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 1, 0) + b"Exif\0")
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", 1) + infe)
    ftyp = box(b"ftyp", b"heic" + bytes(4))

    def meta(at):
        iloc = box(b"iloc", bytes(4) + bytes([0x44, 0]) + struct.pack(">HHHHII", 1, 1, 0, 1, at, len(payload)))
        return box(b"meta", bytes(4) + iinf + iloc)

    at = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(at) + box(b"mdat", payload)


def cr3():
    return box(b"ftyp", b"crx " + bytes(4)) + box(b"moov", box(b"uuid", bytes(16) + jpeg()))


def _zigzag():
    return sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


DC_SYMBOLS, AC_SYMBOLS = list(range(12)), [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]


def picture(planes, sampling=((1, 1),), step=8, restart=0, progressive=False, exif=None, adobe=None, interleaved=True):
    """A JPEG file of planes in full size (each a grid of values from 0 to 255), with codes of one length: 4 bits for DC, 8 for AC."""
    height, width = planes[0].shape
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = []
    for plane, (h, v) in zip(planes, sampling):
        fy, fx = most_v // v, most_h // h
        p = np.pad(plane, ((0, down * 8 * most_v - height), (0, across * 8 * most_h - width)), mode="edge").astype(float)
        p = p.reshape(p.shape[0] // fy, fy, p.shape[1] // fx, fx).mean((1, 3)) - 128
        tiles = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(basis @ tiles @ basis.T / step).astype(int))
    out = bytearray(b"\xff\xd8")

    def segment(marker, body):
        out.extend(b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body)

    if exif is not None:
        segment(0xE1, b"Exif\0\0" + exif)
    if adobe is not None:
        segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe]))
    segment(0xDB, b"\0" + bytes([step]) * 64)
    segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(DC_SYMBOLS) + b"\x10" + bytes([0] * 7 + [len(AC_SYMBOLS)] + [0] * 8) + bytes(AC_SYMBOLS))
    if restart:
        segment(0xDD, struct.pack(">H", restart))
    order = _zigzag()

    def scan(which, spectrum, shift):
        first, last = spectrum
        segment(0xDA, bytes([len(which)]) + b"".join(bytes([i + 1, 0]) for i in which) + bytes([first, last, shift]))
        if len(which) == 1:
            h, v = sampling[which[0]]
            units = [[(which[0], y, x)] for y in range(-(-(-(-height * v // most_v)) // 8)) for x in range(-(-(-(-width * h // most_h)) // 8))]
        else:
            units = [[(i, y * sampling[i][1] + b, x * sampling[i][0] + a) for i in which for b in range(sampling[i][1]) for a in range(sampling[i][0])] for y in range(down) for x in range(across)]
        bits, previous, marker = [], dict.fromkeys(which, 0), 0

        def flush():
            text = "".join(bits)
            text += "1" * (-len(text) % 8)
            out.extend(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b"")
            bits.clear()

        def put(value, size):
            if size:
                bits.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

        for n, unit in enumerate(units):
            if restart and n and n % restart == 0:
                flush()
                out.extend(bytes([0xFF, 0xD0 + marker % 8]))
                marker, previous = marker + 1, dict.fromkeys(which, 0)
            for i, y, x in unit:
                z = [int(blocks[i][y, x][p]) for p in order]
                if first == 0:
                    dc = z[0] >> shift
                    size = abs(dc - previous[i]).bit_length()
                    bits.append(format(size, "04b"))
                    put(dc - previous[i], size)
                    previous[i] = dc
                run = 0
                for value in z[max(first, 1) : last + 1]:
                    if not value:
                        run += 1
                        continue
                    while run > 15:
                        bits.append(format(1, "08b"))
                        run -= 16
                    bits.append(format(AC_SYMBOLS.index(run << 4 | abs(value).bit_length()), "08b"))
                    put(value, abs(value).bit_length())
                    run = 0
                if last and run:
                    bits.append(format(0, "08b"))
        flush()

    every = list(range(len(planes)))
    if progressive:
        scan(every, (0, 0), 1)
        for i in every:
            scan([i], (1, 63), 0)
    elif interleaved:
        scan(every, (0, 63), 0)
    else:
        for i in every:
            scan([i], (0, 63), 0)
    return bytes(out + b"\xff\xd9")


def turned_exif(how, order="<"):
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "HHHIHH", 1, 0x0112, 3, 1, how, 0) + bytes(4)
