"""Look-ups of a block's distinct keys in a table that has no size bound.

Documents are packed to blocks of a few megabytes, written to the shared folder. Each block asks for its distinct keys, one row
of packed keys for each bucket of the key space; a bucket gathers the blocks' requests, answers each distinct key once, and
sends every block its answers. So what is shuffled are distinct keys per block in packed form, never a row for each word, and the
number of buckets grows with the keys, so that a bucket stays within a task's memory. A very frequent key comes at most once from each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

ASK = "block long, bucket long, keys binary, extra binary"
ANSWER = "block long, bucket long, answer binary"


def block_ids() -> Iterator[int]:
    """Numbers for the blocks of this task; they are written with the blocks, so a task that runs again may count anew."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 24
    while True:
        yield at
        at += 1


def squeeze(a: np.ndarray, level: int = 1) -> bytes:
    """An array of unsigned integers, compressed byte by byte of their places."""
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), level)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(n, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def rising(a: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the bytes of their differences, the high bytes, nearly all zero, apart; the shuffle compresses them."""
    d = np.diff(a, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unrising(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def bucket_edges(n: int) -> np.ndarray:
    """Where the buckets of the 64-bit key space begin."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def answered(asked: DataFrame, f: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """f gets all requests of a bucket and returns an answer for each."""

    def run(requests: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": requests["block"], "bucket": requests["bucket"], "answer": f(requests)})

    return asked.groupBy("bucket").applyInPandas(run, ANSWER)


def returned(blocks: DataFrame, answers: DataFrame, f: Callable[[pd.Series, dict[int, bytes]], pd.DataFrame], schema: str) -> DataFrame:
    """f gets a block and its answers by bucket."""

    def run(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(own["bucket"].tolist(), own["answer"], strict=True))
        return pd.concat([f(row, got) for _, row in block.iterrows()]) if len(block) else f(None, {})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
