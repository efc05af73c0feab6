"""Columns over vectors, fingerprints and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col
from .udfs import vectorised

HEX = "^[0-9a-fA-F]+$"


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Over the common length, in double precision; 0 if either is zero there."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    x, y = F.slice(col(a), F.lit(1), n), F.slice(col(b), F.lit(1), n)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def unit(v: Column | str) -> Column:
    """The vector in double precision divided by its length."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(col(v), lambda x: x.cast("double") / n))


def hex64(text: Column | str) -> Column:
    """16 hex digits as a 64-bit number."""
    return F.conv(col(text), 16, -10).cast("long")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hex fingerprints of one length, in words of 64 bits; null if they cannot be compared."""
    a, b = col(a), col(b)
    words = F.sequence(F.lit(0), F.ceil(F.length(a) / 16).cast("int") - 1)
    bits = F.aggregate(F.transform(words, lambda i: F.bit_count(hex64(F.substr(a, i * 16 + 1, F.lit(16))).bitwiseXOR(hex64(F.substr(b, i * 16 + 1, F.lit(16)))))), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) == F.length(b)) & a.rlike(HEX) & b.rlike(HEX), bits)


def sign_bits(v: Column | str, n: int = 64) -> Column:
    """A fingerprint of a vector: the signs of its first n <= 64 components as bits of a number."""
    return F.aggregate(F.slice(col(v), 1, n), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


@vectorised("array<float>")
def from_blob(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 bytes as an array."""
    for s in blobs:
        yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


@vectorised("binary")
def to_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def box_area(b: Column) -> Column:
    """b: STRUCT<cx, cy, w, h>, the centre and the size."""
    return F.greatest(F.lit(0.0), b["w"]) * F.greatest(F.lit(0.0), b["h"])


def box_iou(a: Column, b: Column) -> Column:
    """Shared part of the area that two boxes cover together."""
    side = lambda c, d: F.greatest(F.lit(0.0), F.least(a[c] + a[d] / 2, b[c] + b[d] / 2) - F.greatest(a[c] - a[d] / 2, b[c] - b[d] / 2))
    inter = side("cx", "w") * side("cy", "h")
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def nms(found: Column | str, limit: float = 0.5) -> Column:
    """Detections ARRAY<STRUCT<score, kind, cx, cy, w, h>>, best score first, without those that overlap a better one of their kind."""
    placed = F.transform(col(found), lambda b, i: F.struct((-b["score"]).alias("minus"), i.alias("i"), b.alias("b")))
    ordered = F.transform(F.array_sort(placed), lambda x: x["b"])
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: (k["kind"] == b["kind"]) & (box_iou(k, b) >= limit)), kept).otherwise(F.concat(kept, F.array(b))))


# Classes and thresholds of the scene detector.
PERSON_SCORE, ANIMAL_SCORE, OBJECT_SCORE, MIN_SUBJECT, OVERLAP = 0.25, 0.75, 0.45, 2500.0, 0.45
ANIMAL, SUSPECT_ANIMAL, VEHICLE = tuple(range(14, 24)), (14, 18, 20, 21, 22, 23), tuple(range(1, 9))
INDOOR = (56, 57, *range(59, 80))


def scene_labels(found: Column | str) -> Column:
    """Labels of a picture from its detections: person, animal; landscape only if neither and nothing blocks it."""
    d = col(found)
    subject = F.filter(d, lambda b: ((b["kind"] == 0) & (b["score"] >= PERSON_SCORE)) | (b["kind"].isin(*ANIMAL) & (b["score"] >= ANIMAL_SCORE)))
    blocked = F.exists(d, lambda b: b["kind"].isin(*VEHICLE, *INDOOR) & (b["score"] >= OBJECT_SCORE))
    kept = F.filter(nms(subject), lambda b: box_area(b) >= MIN_SUBJECT)
    people = F.filter(kept, lambda b: b["kind"] == 0)
    some = F.size(people) > 0
    animal = F.exists(kept, lambda b: b["kind"].isin(*ANIMAL) & ~(some & b["kind"].isin(*SUSPECT_ANIMAL)) & ~F.exists(people, lambda p: box_iou(b, p) >= OVERLAP))
    labels = F.array(F.when(animal, "animal"), F.when(~some & ~animal & ~blocked, "landscape"), F.when(some, "person"))
    return F.filter(labels, lambda x: x.isNotNull())
