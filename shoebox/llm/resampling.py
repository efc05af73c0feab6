"""Importance resampling of documents towards a target: hashed n-gram features, a gain for each bucket, and a draw by perturbed scores.

A feature's bucket is its CRC-32 modulo a number, but no feature is ever written out. Each word's CRC is computed once; the CRC of a run of words follows from those of its
words, because appending n bytes to a text multiplies its CRC by a fixed matrix over GF(2), so crc(a + b) = shift(crc(a), len(b)) xor crc(b). The matrices are kept as tables of four times
256 words for each length up to SHORT, and for each power of two beyond.

Buckets of a whole table are counted inside each task and added up by Spark; a gain for each of the fixed number of buckets goes to the tasks that score. The draw sorts all
scores by ranges, numbers each range on its own and adds the sizes of the ranges before, so no task sees more than its range.

Cases: null and empty texts have no words; one-word texts have one feature; very long texts stand alone in their chunk and are taken whole; ties go to the smaller id, null ids last; repeated rows have equal scores and ranks of
their own; a null id is drawn with the hash of "42:"; without benchmark texts every gain is that of t = T = 0; an empty table gives an empty one. Only ids and texts are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Options:
    buckets: int = 10000
    #: Words in the longest feature.
    longest: int = 3
    #: Documents of fewer words are never drawn; of the others this many in a hundred are.
    least_words: int = 20
    percent: int = 5
    seed: str = "42"


#: Lengths that have a table of their own.
SHORT = 64
#: Bytes of words: digits, lower-case letters and every byte of a longer UTF-8 sequence.
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _byte_steps() -> np.ndarray:
    """What a CRC register's low byte turns into when a byte is shifted out: the usual table, from the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEP = _byte_steps()


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The matrix that four tables of 256 words stand for, times each CRC."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _bytes_of_a_word() -> np.ndarray:
    """Every value of each of a word's four bytes, as words."""
    return np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that shift by 0..SHORT bytes, and by each power of two of bytes."""
    one = _bytes_of_a_word()
    one = STEP[one & 255] ^ one >> 8
    short = [_bytes_of_a_word()]
    for _ in range(SHORT):
        short.append(_applied(one, short[-1]))
    powers = [one]
    for _ in range(40):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


SHIFTS, POWERS = _shift_tables()
_FLAT = SHIFTS.reshape(-1)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix of as many bytes as by says: what it adds to the CRC of a text that goes on for that long."""
    crc = crc.astype(np.uint32)
    base = np.minimum(by, SHORT).astype(np.int64) * 1024
    out = _FLAT[base + (crc & 255)] ^ _FLAT[base + 256 + (crc >> 8 & 255)] ^ _FLAT[base + 512 + (crc >> 16 & 255)] ^ _FLAT[base + 768 + (crc >> 24)]
    far = np.flatnonzero(by > SHORT)
    if len(far):
        x, rest = crc[far], by[far].astype(np.int64)
        for k in range(int(rest.max()).bit_length()):
            on = np.flatnonzero(rest >> k & 1)
            x[on] = _applied(POWERS[k], x[on])
        out[far] = x
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes."""
    size = ends - starts
    register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(size <= SHORT)
    where, left = starts[at], size[at]
    j = 0
    while len(at):
        own = register[at]
        register[at] = STEP[(own ^ data[where + j]) & 255] ^ own >> 8
        j += 1
        on = left > j
        at, where, left = at[on], where[on], left[on]
    out = ~register
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(texts: pa.Array, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a column of texts: the number of words of each, and for runs of 1, 2, ... words the CRCs and the text each run is in."""
    raw, at = C.strings(texts)
    data = LOWER[raw]
    word = WORD[data]
    # words end with their text: the edges of texts part what touches there
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin = word & (edge[:-1] | ~np.concatenate(([False], word[:-1])))
    stop = word & (edge[1:] | ~np.concatenate((word[1:], [False])))
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    crc = word_crcs(data, starts, ends)
    size = ends - starts
    space = np.uint32(zlib.crc32(b" "))
    tail = shifted(np.full(len(crc), space, np.uint32), size) ^ crc  # of " word"
    runs, owners = [crc], [doc]
    for n in range(1, longest):
        run = shifted(runs[-1][: max(len(crc) - n, 0)], size[n:] + 1) ^ tail[n:]
        runs.append(run)
        owners.append(doc[n:])
    for n in range(1, longest):
        inside = doc[: max(len(crc) - n, 0)] == doc[n:]
        runs[n], owners[n] = runs[n][inside], owners[n][inside]
    return np.bincount(doc, minlength=len(texts)), runs, owners


def bucket_counts(texts: DataFrame, o: Options = Options()) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(o.buckets, np.int64)
        for t in C.chunks(batches):
            _, runs, _ = features(t.column("text").combine_chunks(), o.longest)
            for run in runs:
                total += np.bincount(run % np.uint32(o.buckets), minlength=o.buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(o.buckets, np.int64)
    out[parts.column("bucket").to_numpy()] = parts.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * the log of its smoothed share in the target over that in the source)."""
    every, wanted, n = float(source.sum() + len(source)), float(target.sum() + len(target)), range(len(source))
    return np.array([math.floor(1000 * math.log((int(target[b]) + 1) * every / ((int(source[b]) + 1) * wanted))) for b in n], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """A Gumbel-distributed number from the id alone, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, o: Options = Options()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            words, runs, owners = features(t.column("text").combine_chunks(), o.longest)
            n, weight = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            for run, owner in zip(runs, owners, strict=True):
                n += np.bincount(owner, minlength=t.num_rows)
                # owners do not fall, so running sums of integers give each text's exactly
                upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(gains[run % np.uint32(o.buckets)])))
                cut = np.searchsorted(owner, np.arange(t.num_rows + 1))
                weight += upto[cut[1:]] - upto[cut[:-1]]
            shift = np.array([noise(i, o.seed) for i in t.column("doc_id").to_pylist()], np.int64)
            yield pa.record_batch([t.column("doc_id").combine_chunks(), *(pa.array(x.astype(np.int64)) for x in (words, n, weight, weight + shift))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return C.texts(docs).mapInArrow(apply, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """Columns + rank: the place of each row by falling score and then by id, null beyond the last one drawn."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = C.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    offset = dealt.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    numbered = dealt.withColumn("place", place).join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + F.col("place"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null for those that are not drawn."""
    C.tune(docs.sparkSession)
    own = C.texts(docs)
    wanted = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = C.written(scored(docs, bucket_gains(bucket_counts(own, o), bucket_counts(wanted, o)), o))
    able = rows.filter(F.col("n_words") >= o.least_words)
    placed = ranked(able, o.percent * able.count() // 100)
    rest = rows.filter(F.col("n_words") < o.least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, o: Options = Options()) -> DataFrame:
    """The documents that are drawn, all their columns: what a training corpus nearer the target is made of. Rows with one id are drawn together."""
    (name,) = C.unused(docs, ["drawn_id"])
    chosen = resample(docs, target, o).filter("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
