"""Best-fit packing of documents into token sequences, by sums of squares.

A document's tokens are cut only if they exceed a sequence; the first piece then takes the remainder. Pieces are placed one
after another where the sum of the squared counts of open sequences per residual gap becomes smallest: that keeps
gaps of many kinds open and so nearly every piece finds one that it fills. Pieces over half a sequence come first, the
longest first, the others in the order of a hash.

Pieces are dealt by a hash to shards of about Options.shard pieces, which are packed on their own. The few sequences of a shard that stay
rather open are emptied; their pieces meet those of Options.merge other shards in a second round, where they are placed
again by sums of squares, and what then stays open is placed by best fit, the longest first. All groups have a bounded size whatever the
input; long documents spread over shards.

Cases: null and empty texts have the end token alone; rows with equal or null ids are packed each on its own; a very long text is cut to pieces of a sequence; an empty table gives an empty one; only the id
and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Options:
    capacity: int = 1024
    end: int = 2
    #: File of the tokenizers library, and the same vocabulary as ranks, which tiktoken encodes several times as fast (None: tokenizers does it).
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str | None = "byte_bpe_50k.tiktoken"
    shard: int = 8192
    merge: int = 16
    #: Sequences with a larger gap are emptied and their pieces placed again.
    loose: int = 24


@lru_cache(maxsize=4)
def encoder(tokenizer: str, ranks: str | None):
    """text -> array of ids. Special tokens in a text are found as tokenizers finds them."""
    import os

    import public_tokenizers as P

    place = lambda name: name if os.path.isabs(name) else P.path(name)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(place(tokenizer))
    library.no_padding()
    library.no_truncation()
    if ranks is None:
        return lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)
    import json

    import tiktoken

    special = {x["content"]: x["id"] for x in json.loads(library.to_str())["added_tokens"]}
    with open(place(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens=special)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the order given by sums of squares; ties go to the smallest gap."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        change = 1 - 2 * count[s:capacity]
        if len(change):
            change[1:] += 2 * count[1 : capacity - s] + 1
            change[count[s:capacity] == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= best:
                gap = s + k
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = at, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(at)
    return where, offset


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, placed in the smallest gap that holds it."""
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fits = count[s:capacity] > 0
        if fits.any():
            gap = s + int(fits.argmax())
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        where[i], offset[i] = at, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(at)
    return where, offset


def _packed(pieces: pd.DataFrame, o: Options, last: bool) -> pd.DataFrame:
    """Pieces of a shard with sequence and offset; sequence -1: to be placed in the next round."""
    size = pieces["length"].to_numpy()
    big = size * 2 > o.capacity
    order = np.lexsort((pieces["piece"], pieces["doc_id"].fillna(-1), np.where(big, 0, pieces["rank"]), np.where(big, -size, 0), ~big))
    pieces, size = pieces.iloc[order].reset_index(drop=True), size[order]
    where, offset = place(size, o.capacity)
    filled = np.bincount(where, weights=size, minlength=1)
    loose = o.capacity - filled[where] > o.loose
    if last:
        again = np.flatnonzero(loose)
        again = again[np.argsort(-size[again], kind="stable")]
        w, offset[again] = best_fit(size[again], o.capacity)
        where[again] = w + len(filled)
    else:
        where[loose] = -1
    return pieces.assign(sequence=where, offset=offset)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def pieces(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """The pieces of every document, with checksums of their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(o.tokenizer, o.ranks)
        for t in C.chunks(batches):
            docs_, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(o.end)).astype("<u4")
                first = len(ids) % o.capacity or o.capacity
                for k, at in enumerate([0, *range(first, len(ids), o.capacity)]):
                    part = ids[at : first if k == 0 else at + o.capacity]
                    docs_.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            rank = C.mix(np.array(crc, np.uint64) ^ (np.array(start, np.uint64) << np.uint64(32))).view(np.int64)
            yield pa.record_batch([pa.array(docs_, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "rank"])

    return C.texts(docs).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    C.tune(docs.sparkSession)
    estimate = C.texts(docs).agg((F.count("*") + F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (2.5 * o.capacity)).alias("n")).first()["n"]
    shards = int(estimate // o.shard) + 1
    salted = pieces(docs, o).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "rank"), F.lit(shards)))
    kind = PIECE + ", shard long, sequence long, offset long"
    first = C.written(salted.groupBy("shard").applyInPandas(lambda p: _packed(p, o, False), kind))
    out = lambda df: df.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shard") * (1 << 32) + F.col("sequence")).alias("sequence_id"), "offset")
    group = (F.lit(shards) + F.floor(F.col("shard") / o.merge)).cast("long")
    again = first.filter("sequence < 0").withColumn("shard", group).select(*salted.columns)
    second = again.groupBy("shard").applyInPandas(lambda p: _packed(p, o, True), kind)
    return out(first.filter("sequence >= 0")).unionByName(out(second))
