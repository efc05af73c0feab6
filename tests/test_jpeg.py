"""Grey pictures and fingerprints of JPEG files, against the pixels they were made from."""

import builders as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.sources import files, jpeg


def scene(seed, width=217, height=150):
    """A smooth picture with some noise."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width] / 50
    waves = sum(r.normal() * np.sin(r.normal() * 2 * x + r.normal() * 2 * y + r.uniform(0, 6)) for _ in range(6))
    return np.clip(128 + 35 * waves + r.normal(0, 2, waves.shape), 0, 255).round()


def far(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


COLOURED = ((2, 2), (1, 1), (1, 1))


@pytest.mark.parametrize(
    "options",
    [
        {}, {"restart": 3}, {"progressive": True}, {"sampling": COLOURED}, {"sampling": COLOURED, "restart": 5}, {"sampling": COLOURED, "progressive": True}, {"sampling": COLOURED, "interleaved": False},
        {"sampling": ((2, 1), (1, 1), (1, 1)), "step": 30}, {"sampling": ((1, 1), (1, 1), (1, 1)), "adobe": 0},
    ],
)
def test_pictures_match_their_pixels(options):
    for seed in range(6):
        pixels = scene(seed)
        n = len(options.get("sampling", [0]))
        rgb = options.get("adobe") == 0
        planes = [pixels] + [pixels if rgb else np.full_like(pixels, 90.0)] * (n - 1)
        data = B.picture(planes, **options)
        small = jpeg.small_grey(data)
        grey = small.picture
        rows, columns = -(-pixels.shape[0] // 8), -(-pixels.shape[1] // 8)
        assert grey.shape == (rows, columns)
        means = pixels[: rows // 1 * 8 - 8, : columns * 8 - 8].reshape(rows - 1, 8, columns - 1, 8).mean((1, 3))
        assert np.abs(grey[:-1, :-1] - means).max() < 2 + options.get("step", 8) / 4
        assert far(jpeg.fingerprint(data), jpeg.difference_hash(pixels)) <= 2


def test_turned_pictures():
    pixels = scene(3, 480, 360)
    for how in range(1, 9):
        upright = jpeg.turned(pixels, how)
        for order in "<>":
            data = B.picture([pixels], exif=B.turned_exif(how, order))
            assert far(jpeg.fingerprint(data), jpeg.difference_hash(upright)) <= 2
    corner = np.array([[1, 2], [3, 4], [5, 6]])
    assert [jpeg.turned(corner, k)[0].tolist() for k in range(1, 9)] == [[1, 2], [2, 1], [6, 5], [5, 6], [1, 3, 5], [5, 3, 1], [6, 4, 2], [2, 4, 6]]


def test_previews_and_broken_files(spark, tmp_path):
    pixels = scene(5)
    data = B.picture([pixels])
    want = jpeg.fingerprint(data)
    assert want is not None
    assert jpeg.fingerprint(B.tiff() + b"raw" * 100 + data) == want  # a raw file with a preview
    assert jpeg.fingerprint(b"x" * (8 << 20) + data) is None  # beyond where a preview is looked for
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff", data[: len(data) // 2], b"nothing at all", B.mp4(), B.tiff(), B.jpeg(), data[:2] + b"\xff\xc9" + data[4:]):
        assert jpeg.fingerprint(bad) is None
    rng = np.random.default_rng(1)
    for _ in range(200):  # whatever the bytes, a number or nothing
        noisy = bytearray(data)
        for at in rng.integers(2, len(noisy), 5):
            noisy[at] = rng.integers(256)
        jpeg.fingerprint(bytes(noisy))
    for name, content in (("a.jpg", data), ("b.cr2", B.tiff() + data), ("c.jpg", b"broken")):
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.jpg", "b.cr2", "c.jpg", "missing.jpg")] + [(None,)], "path string")
    got = [r["h"] for r in paths.select(files.phash_embedded("path").alias("h")).collect()]
    assert got == [want, want, None, None, None]
    content = spark.createDataFrame([(bytearray(data),)], "content binary").select(files.phash_embedded("content").alias("h"))
    assert content.first()["h"] == want


def test_recompressed_copies_are_near():
    pixels = scene(7, 640, 480)
    a, b, c = (jpeg.fingerprint(B.picture([p], step=s)) for p, s in ((pixels, 4), (pixels, 40), (scene(8, 640, 480), 8)))
    assert far(a, b) <= 4 < far(a, c)
