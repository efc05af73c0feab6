"""Substring dedup by hashing lines or paragraphs.

Units are normalised (white space runs become one space, lower case) and hashed to 128 bits. The earliest occurrence of a digest, by document
rank and then by place, is kept; all others are removed and their places in the original text returned, with their number and their bytes. Counting
is a partial aggregation, so a line that a third of all documents hold becomes one row per task before the shuffle;
only digests that occur more than once are joined back, in a join whose large keys Spark may split.

Cases: null texts are empty and stay so; blank units and units of fewer than Options.min_words words are always kept; a very long text is split whole, alone in its chunk; rows with the
same id and text are one document, and each gets its result; of the same unit twice in one document the first place counts; null ids rank last, several by their text's hash; an empty table gives an
empty one; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Options:
    #: What parts units: a line end, or blank lines ("\n\n") for paragraphs.
    separator: str = "\n"
    #: Units of fewer words, parted by ASCII spaces, stay; 1 leaves no floor.
    min_words: int = 1


SPACE = re.compile(r"[\t\f\r\n ]+")
UNITS = "row_id long, row_key long, late boolean, start long, stop long, h1 long, h2 long"
RESULT = "doc_id long, n_units long, n_units_removed long, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, text string"


def normalised(unit: str) -> str:
    return SPACE.sub(" ", unit).strip(" ").lower()


def units(docs: DataFrame, o: Options) -> DataFrame:
    """The units that count, with their digests and their places in characters."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            rows, start, stop, digest = [], [], [], []
            for row, text in enumerate(t.column("text").to_pylist()):
                at = 0
                for unit in text.split(o.separator):
                    key = normalised(unit)
                    if key and key.count(" ") + 1 >= o.min_words:
                        rows.append(row)
                        start.append(at)
                        stop.append(at + len(unit))
                        digest.append(hashlib.blake2b(key.encode(), digest_size=16).digest())
                    at += len(unit) + len(o.separator)
            h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            own = t.select(["row_id", "row_key", "late"]).take(pa.array(rows, pa.int64())).combine_chunks()
            yield pa.record_batch(
                [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                [x.split()[0] for x in UNITS.split(", ")],
            )

    return docs.mapInArrow(split, UNITS)


def dedup(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Each document without the units that occurred before, with the places and the bytes of what was removed."""
    C.tune(docs.sparkSession)
    rows = C.keyed(docs)
    found = C.written(units(rows.withColumn("late", F.col("doc_id").isNull()), o))
    rank = F.struct("late", "row_id", "row_key", "start")
    first = C.written(found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    repeated = found.join(first, ["h1", "h2"]).filter(rank != F.col("first"))
    removed = repeated.groupBy(*C.KEYS).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("removed"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            count, gone, size, less, kept, spans = [], [], [], [], [], []
            for text, cut in zip(t.column("text").to_pylist(), t.column("removed").to_pylist(), strict=True):
                drop = {s["start"] for s in cut or ()}
                out, at, n, lost = [], 0, 0, 0
                for unit in text.split(o.separator):
                    if at not in drop or not unit:
                        out.append(unit)
                    else:
                        lost += len(unit.encode())
                    n += 1
                    at += len(unit) + len(o.separator)
                count.append(n)
                gone.append(len(drop))
                size.append(len(text.encode()))
                less.append(lost)
                spans.append(cut or [])
                kept.append(o.separator.join(out))
            numbers = [pa.array(x, pa.int64()) for x in (count, gone, size, less)]
            yield pa.record_batch(
                [t.column("doc_id").combine_chunks(), *numbers, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_units", "n_units_removed", "n_bytes", "n_removed", "removed", "text"],
            )

    return rows.join(removed, C.KEYS, "left").select("doc_id", "text", "removed").mapInArrow(apply, RESULT)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), placed AS (
  SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start,
         lower(trim(regexp_replace(line, '[\\t\\f\\r ]+', ' ', 'g'), ' ')) AS norm
  FROM lines
), ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone
  FROM placed
)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_units_removed, CAST(sum(octet_length(encode(line))) + count(*) - 1 AS BIGINT) AS n_bytes,
       CAST(coalesce(sum(octet_length(encode(line))) FILTER (gone), 0) AS BIGINT) AS n_removed,
       sha256(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone)) AS kept_sha256,
       coalesce(string_agg(start || '-' || (start + length(line)), ' ' ORDER BY i) FILTER (gone), '') AS removed
FROM ranked GROUP BY doc_id
"""
