"""Helpers shared by the training-data operators.

Documents travel through Python in Arrow batches; the kernels below work on the batch's bytes at once with numpy,
so no Python code runs per byte or per word.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: with long texts a batch of Spark's default 10,000 rows would be too large.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: Bytes of text that a kernel takes at once.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names. Where that is unset, a temporary one, but only if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "shoebox-checkpoints")
    return f"{root}/shoebox-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a step's rows to the shared folder and read them again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does when the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, named doc_id and text; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: What tells rows apart: the id (0 for a null one) and a hash of the id and the text. Only texts with one id could share a hash by chance.
KEYS = ["row_id", "row_key"]


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list:
    """The columns of KEYS."""
    own = F.col(doc_id).cast("long")
    return [F.coalesce(own, F.lit(0)).alias(KEYS[0]), F.xxhash64(own, F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(KEYS[1])]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns of KEYS."""
    return texts(docs).select("doc_id", "text", *row_keys())


def unused(df: DataFrame, names: list[str]) -> list[str]:
    """The names, behind as many underscores as make them differ from all columns of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def unlike(keyed: DataFrame, key: str, what: str) -> bool:
    """Whether some rows with one key differ in what it should stand for: two different things have one hash."""
    return keyed.groupBy(key).agg(F.min(what).alias("low"), F.max(what).alias("high")).filter("low <> high").limit(1).count() > 0


def told_apart(docs: DataFrame) -> int:
    """The first salt under which row_key() tells all ids apart."""
    own, salt = texts(docs), 0
    while unlike(own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), row_key(salt).alias("key")), "key", "id"):
        salt += 1
    return salt


def row_key(salt: int, doc_id: str = "doc_id", text: str = "text"):
    """A number for each different id and text."""
    return F.xxhash64(F.lit(salt), F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, fill: bool = False) -> Iterator[pa.Table]:
    """Cut or gather the batches to tables of whole rows with about limit bytes of text; one longer row stands alone.

    fill: gather across batches until the limit is reached.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = strings(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = int(np.searchsorted(at, at[row] + limit - size, "right")) - 1
            last = min(max(last, row + (not held)), batch.num_rows)
            if last > row:
                held.append(batch.slice(row, last - row))
                size += int(at[last] - at[row])
                row = last
            if held and (row < batch.num_rows or not fill or size >= limit):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd 64-bit number for each byte, and the base of the polynomial.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)
SLICE = 1 << 19


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]; runs are not empty and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    p = powers(int(size.max(initial=1)))
    a = 0
    while a < len(starts):  # about SLICE bytes at a time
        b = max(int(np.searchsorted(total, total[a] + SLICE, "right")) - 1, a + 1)
        cut = total[a:b] - total[a]
        inside = np.arange(total[b] - total[a]) - np.repeat(cut, size[a:b])
        value = BYTE[data[np.repeat(starts[a:b], size[a:b]) + inside]] * p[inside]
        out[a:b] = np.add.reduceat(value, cut)
        a = b
    return mix(out + size.astype(np.uint64))


#: Bytes of words: ASCII letters and every byte of a longer UTF-8 sequence.
WORD = np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])


def words(values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of texts: the bytes, the starts and ends of the words in them, and each word's text number."""
    raw = [(v or "").lower().encode() for v in values]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, ends = runs(WORD[data])
    return data, starts, ends, np.searchsorted(at, starts, "right") - 1


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def shared(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)
