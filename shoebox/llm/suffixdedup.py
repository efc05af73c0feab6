"""Removal of repeated substrings, decided by common prefixes of sorted suffixes.

A byte goes if a substring of Options.match bytes that covers it also starts earlier: in a document of smaller rank, or
earlier in the same one. Documents are UTF-8 bytes and substrings never cross them.

The collection is partitioned so that equal substrings meet. Every substring has an anchor: its gram of Options.gram bytes with the
smallest hash, the leftmost of equals. Equal substrings have equal anchors at the same place, and neighbouring substrings mostly
share one, so a document falls to few runs of substrings. A first exchange of anchor hashes finds the anchors that
occur more than once; only their runs, with the bytes they span, go on. A task sends equal runs once, with the earliest place, and
marks the others itself, so a passage that a third of all documents hold meets its copies as one row per task. Runs of
an anchor that occurs more than Options.hot times (a list of bounded length) go on substring by substring, dealt by the hash of each. In
each bucket the different runs of an anchor are a collection of documents whose transform and common prefixes are built column by column
(suffixes.py); neighbours with a common prefix of at least Options.match bytes are equal substrings.

Cases: null and empty texts stay empty; texts under Options.match bytes stay whole; rows with the same id and text are one document and each
gets its result; documents with one id and different texts rank by a hash of the text; null ids rank last; a very long text is cut to runs like any other; an empty table gives an empty one; names of other columns may be any but KEY and GONE with their two underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X
from .suffixes import columnwise


@dataclass(frozen=True)
class Options:
    match: int = 100
    gram: int = 52
    hot: int = 5000
    #: Anchors, and bytes of runs, of a bucket.
    anchors: int = 250_000
    bucket: int = 6 << 20
    #: Bytes of runs whose suffixes are sorted together.
    collection: int = 1 << 20
    chunk: int = 4 << 20


#: Anchors that occur more than Options.hot times, at most; with more the bound rises.
HOT_KEYS = 1_000_000
LAST = np.iinfo(np.int64).max
PLACE = np.uint64((1 << 31) - 1)


def _smallest(key: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (w - size)], key[w - size :]) if size < w else key


#: Bytes whose anchors are found at once.
SLICE = 1 << 20


def _anchored(raw: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Of each substring of raw: the place of its anchor, and of each gram its hash."""
    p = C.powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.BYTE[raw] * p[:-1], dtype=np.uint64)))
    back = np.uint64(pow(int(C.BASE), -1, 1 << 64))
    inverse = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(raw) - o.gram, back, np.uint64))))
    gram = C.mix((total[o.gram :] - total[: -o.gram]) * inverse)
    best = _smallest((gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64), o.match - o.gram + 1)
    return (best & PLACE).astype(np.int64), gram


def anchors(raw: np.ndarray, at: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of substrings that share an anchor: its hash, the text's number, the first substring's start in its text, how many more follow."""
    n = max(len(raw) - o.match + 1, 0)  # substrings, those across texts included
    valid = np.zeros(n + 1, np.int8)  # +1 where a text's substrings begin, -1 after them
    whole = np.diff(at) >= o.match
    starts, stops = at[:-1][whole], at[1:][whole] - o.match + 1
    np.add.at(valid, starts, 1)
    np.add.at(valid, stops, -1)
    ok = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
    begins = np.zeros(n, bool)
    begins[starts] = True
    keys, los, his = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for base in range(0, n, SLICE):
        end = min(base + SLICE, n)
        place, gram = _anchored(raw[base : end + o.match - 1], o)
        own = ok[base:end]
        change = begins[base:end] | np.concatenate(([True], place[1:] != place[:-1]))
        lo = np.flatnonzero(own & change)
        his.append(np.flatnonzero(own & np.concatenate((change[1:] | ~own[1:], [True]))) + base)
        los.append(lo + base)
        keys.append(gram[place[lo]])
    lo, hi = np.concatenate(los), np.concatenate(his)
    doc = np.searchsorted(at, lo, "right") - 1
    return np.concatenate(keys), doc, lo - at[doc], hi - lo


RUN = np.dtype([("key", "<u8"), ("lo", "<u4"), ("more", "<u4")])
ASK = "bucket long, keys binary, counts binary, places binary, rows binary, row_key long, runs binary"
RUNS = "row_key long, runs binary, hot binary"


def _by_row(row: np.ndarray, key: np.ndarray, lo: np.ndarray, more: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Runs packed for each document."""
    order = np.argsort(row, kind="stable")
    row, out = row[order], np.zeros(len(row), RUN)
    out["key"], out["lo"], out["more"] = key[order], lo[order], more[order]
    cut = np.append(np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1]))), len(row)).tolist()
    return row[cut[:-1]].tolist(), [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _ask_anchors(o: Options, edges: np.ndarray):
    """Distinct anchors of a chunk with their counts; anchors that occur in it once with their places. Runs of the others are repeats for sure and are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, limit=o.chunk, fill=True):
            key, doc, lo, more = anchors(*C.strings(t.column("text")), o)
            order = np.argsort(key, kind="stable")
            key, doc, lo, more = key[order], doc[order], lo[order], more[order]
            rows = t.column("row_key").to_numpy()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            every, many = key[first], np.repeat(count > 1, count)
            known, packed = _by_row(rows[doc[many]], key[many], lo[many], more[many])
            out = [(r % len(edges), None, None, None, None, r, x) for r, x in zip(known, packed, strict=True)]
            at = first[count == 1]
            cut, single = np.append(np.searchsorted(every, edges), len(every)), np.cumsum(count == 1)
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    own = at[single[a] - (count[a] == 1) : single[b - 1]]
                    used, number = np.unique(doc[own], return_inverse=True)
                    out.append((k, X.rising(every[a:b]), X.squeeze(count[a:b].astype(np.uint32)), X.squeeze(np.stack((number, lo[own], more[own])).astype(np.uint32).ravel()), rows[used].tobytes(), 0, None))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in ASK.split(", ")])

    return run


def _repeated(hot: int):
    """The runs of anchors that occur more than once, packed for each document, and the anchors that occur more than hot times."""

    def run(requests: pd.DataFrame) -> pd.DataFrame:
        known = requests["runs"].notna()
        passed, asked = requests[known], requests[~known]
        row, runs = passed["row_key"].astype("int64").tolist(), passed["runs"].tolist()
        frequent = np.zeros(0, np.uint64)
        if len(asked):
            keys = [X.unrising(k) for k in asked["keys"]]
            counts = [X.unsqueeze(c, np.uint32) for c in asked["counts"]]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
            frequent = every[total > hot]
            at = 0
            for key, count, places, rows in zip(keys, counts, asked["places"], asked["rows"], strict=True):
                here = total[inverse[at : at + len(key)]]
                at += len(key)
                single = count == 1
                number, lo, more = X.unsqueeze(places, np.uint32).reshape(3, -1)
                take = here[single] > 1
                r, x = _by_row(np.frombuffer(rows, np.int64)[number[take]], key[single][take], lo[take], more[take])
                row += r
                runs += x
        out = pd.DataFrame({"row_key": pd.array(row, "Int64"), "runs": runs, "hot": [None] * len(row)})
        if len(frequent):
            out = pd.concat((out, pd.DataFrame({"row_key": pd.array([None], "Int64"), "runs": [None], "hot": [frequent.tobytes()]})))
        return out

    return run


SPANS = pa.schema([("row_key", pa.int64()), ("spans", pa.binary()), ("bucket", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary()), ("texts", pa.binary())])
SPANS_SQL = "row_key long, spans binary, bucket long, keys binary, ranks binary, texts binary"


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Unions of the spans of each row, packed as pairs."""
    if not len(row):
        return row, []
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.concatenate(([True], row[1:] != row[:-1]))
    # stops only grow within a row: a running maximum, apart for each row
    group = np.cumsum(fresh) - 1
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * wide) - group * wide
    begins = fresh.copy()
    begins[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    ends = reach[np.append(at[1:], len(row)) - 1]
    pairs = np.stack((start[at], ends), 1)
    cut = np.flatnonzero(fresh[at])
    return row[at][cut], [x.tobytes() for x in np.split(pairs, cut[1:])]


def _runs(o: Options, edges: np.ndarray, frequent):
    """Cut the runs out of the texts; of equal ones send the earliest and mark the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = set(frequent.value.tolist())
        for t in C.chunks(batches, limit=o.chunk // 2, fill=True):
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            gone: list[tuple[int, int, int]] = []
            for doc, row, text, parts in zip(t.column("doc_id").to_pylist(), t.column("row_key").to_pylist(), t.column("text").to_pylist(), t.column("runs").to_pylist(), strict=True):
                raw, doc = text.encode(), LAST if doc is None else doc
                for part in parts:
                    for key, lo, more in np.frombuffer(part, RUN).tolist():
                        hot = key in split
                        for a, b in ((k, k + o.match) for k in range(lo, lo + more + 1)) if hot else ((lo, lo + more + o.match),):
                            own, rank = (0 if hot else key, raw[a:b]), (doc, row, a)
                            held = first.setdefault(own, rank)
                            if held != rank:
                                if rank < held:
                                    first[own], held, rank = rank, rank, held
                                gone.append((rank[1], rank[2], rank[2] + b - a))
            x = np.array(sorted(set(gone)), np.int64).reshape(-1, 3)
            rows, spans = merged(x[:, 0], x[:, 1], x[:, 2])
            if spans:
                yield pa.record_batch([pa.array(rows), pa.array(spans, pa.binary()), *(pa.nulls(len(rows), f.type) for f in list(SPANS)[2:])], schema=SPANS)
            texts = [s for _, s in first]
            key = np.array([k for k, _ in first], np.uint64)
            at = np.cumsum([0, *map(len, texts)])
            single = np.flatnonzero(key == 0)  # substrings are dealt by their own hash
            if len(single):
                flat = np.frombuffer(b"".join(texts), np.uint8)
                key[single] = C.hash_runs(flat, at[:-1][single], at[1:][single])
            order = np.argsort(key, kind="stable")
            key, ranks = key[order], np.array(list(first.values()), np.int64).reshape(-1, 3)[order]
            texts = [texts[i] for i in order.tolist()]
            cut = np.append(np.searchsorted(key, edges), len(key))
            out = [(k, X.rising(key[a:b]), ranks[a:b].tobytes(), pa.array(texts[a:b], pa.binary())) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            if out:
                bucket, keys, own, parts = zip(*out, strict=True)
                packed = [np.array([len(s) for s in p.to_pylist()], "<u2").tobytes() + b"".join(p.to_pylist()) for p in parts]
                n = len(out)
                yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(own, pa.binary()), pa.array(packed, pa.binary())], schema=SPANS)

    return run


def _unpacked(keys: bytes, ranks: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    key, rank = X.unrising(keys), np.frombuffer(ranks, np.int64).reshape(-1, 3)
    n = len(key)
    at = (np.cumsum(np.append(0, np.frombuffer(texts, "<u2", n).astype(np.int64))) + 2 * n).tolist()
    return key, rank, [texts[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _equal(texts: list[bytes], ranks: np.ndarray, match: int) -> np.ndarray:
    """Substrings of different runs or places that also start earlier: row_key, start, stop."""
    owner, length, prefixes = columnwise(texts, match)
    group = np.cumsum(prefixes < match)
    size = np.array([len(s) for s in texts])
    long = np.flatnonzero(length >= match)
    owner, group, start = owner[long], group[long], ranks[owner[long], 2] + size[owner[long]] - length[long]
    order = np.lexsort((start, ranks[owner, 1], ranks[owner, 0], group))
    owner, group, start = owner[order], group[order], start[order]
    same = np.concatenate(([False], group[1:] == group[:-1]))
    # a row that is there twice is one document
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(group))))
    same &= ~((ranks[owner, 1] == ranks[owner[head], 1]) & (ranks[owner, 0] == ranks[owner[head], 0]) & (start == start[head])) if len(head) else same
    hit = np.flatnonzero(same)
    return np.stack((ranks[owner[hit], 1], start[hit], start[hit] + match), 1)


def _marked(o: Options):
    def run(requests: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, dict[bytes, tuple[int, int, int]]] = {}
        gone: list[np.ndarray] = []
        own: list[tuple[int, int, int]] = []
        for keys, ranks, packed in zip(requests["keys"], requests["ranks"], requests["texts"], strict=True):
            key, rank, texts = _unpacked(keys, ranks, packed)
            for k, r, s in zip(key.tolist(), map(tuple, rank.tolist()), texts, strict=True):
                group = groups.setdefault(k, {})
                held = group.setdefault(s, r)
                if held != r:
                    if r < held:
                        group[s], held, r = r, r, held
                    own.append((r[1], r[2], r[2] + len(s)))
        gone.append(np.array(own, np.int64).reshape(-1, 3))
        texts, ranks, held = [], [], 0
        for group in groups.values():
            # one run alone repeats nothing: in equal substrings the anchor stands at the same place
            if len(group) > 1:
                texts += group
                ranks += group.values()
                held += sum(map(len, group))
                if held >= o.collection:
                    gone.append(_equal(texts, np.array(ranks, np.int64), o.match))
                    texts, ranks, held = [], [], 0
        if texts:
            gone.append(_equal(texts, np.array(ranks, np.int64), o.match))
        x = np.concatenate(gone)
        rows, spans = merged(x[:, 0], x[:, 1], x[:, 2])
        return pd.DataFrame({"row_key": rows, "spans": spans})

    return run


RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            size, removed, kept = [], [], []
            for text, parts in zip(t.column("text").to_pylist(), t.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                x = np.frombuffer(b"".join(parts or ()), np.int64).reshape(-1, 2)
                cut = np.frombuffer(merged(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])[1][0], np.int64).reshape(-1, 2) if len(x) else x
                edges = [0, *cut.ravel().tolist(), len(raw)]
                size.append(len(raw))
                removed.append(cut)
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(cut) else raw)
            doc, n = t.column("doc_id").combine_chunks(), pa.array(size, pa.int64())
            if digest:
                yield pa.record_batch([doc, n, pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in removed], pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], [x.split()[0] for x in DIGEST.split(", ")])
            else:
                spans = [[{"start": a, "stop": b} for a, b in x.tolist()] for x in removed]
                yield pa.record_batch([doc, n, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return run


def spans(rows: DataFrame, o: Options) -> DataFrame:
    """row_key and packed spans to remove; rows: doc_id, text, row_key."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = int(size * 2 / (o.match - o.gram + 2))
    edges = X.bucket_edges(count // o.anchors + 1)
    asked = rows.select("row_key", "text").mapInArrow(_ask_anchors(o, edges), ASK)
    # no more than HOT_KEYS anchors can occur that often, so they may be sent to all tasks
    hot = max(o.hot, 2 * count // HOT_KEYS)
    paths = [C.scratch(spark) for _ in range(2)]
    runs = C.written(asked.groupBy("bucket").applyInPandas(_repeated(hot), RUNS), paths[0])
    del asked
    C.release(spark)
    frequent = C.shared(spark, np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hot"], np.uint64) for r in runs.filter("hot is not null").select("hot").collect())]))
    runs = runs.filter("row_key is not null").select("row_key", "runs")
    found = runs.agg(F.coalesce(F.sum(F.octet_length("runs")), F.lit(0)).alias("n")).first()["n"] // RUN.itemsize
    parts = X.bucket_edges(int(found * (o.match + 20) // o.bucket) + 1)
    of_row = runs.groupBy("row_key").agg(F.collect_list("runs").alias("runs"))
    cut = C.written(rows.join(of_row, "row_key").select("doc_id", "row_key", "text", "runs").mapInArrow(_runs(o, parts, frequent), SPANS_SQL), paths[1])
    del runs, of_row
    C.drop_written(spark, paths[0])
    C.release(spark)
    met = cut.filter("bucket is not null").select("bucket", "keys", "ranks", "texts").groupBy("bucket").applyInPandas(_marked(o), "row_key long, spans binary")
    out = C.written(cut.filter("spans is not null").select("row_key", "spans").unionByName(met))
    del cut, met
    C.drop_written(spark, paths[1])
    C.release(spark)
    return out


def dedup(docs: DataFrame, o: Options = Options(), digest: bool = False) -> DataFrame:
    """Each document's bytes without what is a repeat, with the places of what was removed; digest: columns as DIGEST says."""
    C.tune(docs.sparkSession)
    rows = C.texts(docs).withColumn("row_key", C.row_key(C.told_apart(docs)))
    gone = spans(rows, o).groupBy("row_key").agg(F.collect_list("spans").alias("spans"))
    return rows.join(gone, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(_apply(digest), DIGEST if digest else RESULT)


def cleaned(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """docs with the repeats cut out of their texts (a character cut in two goes whole) and n_chars, if there, counted anew."""
    C.tune(docs.sparkSession)
    own = C.row_key(C.told_apart(docs))
    key, cuts = C.unused(docs, ["row_key", "gone"])
    gone = spans(C.texts(docs).withColumn("row_key", own), o).groupBy(F.col("row_key").alias(key)).agg(F.collect_list("spans").alias(cuts))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            out = []
            for text, parts in zip(t.column("text").to_pylist(), t.column(cuts).to_pylist(), strict=True):
                if parts:
                    x = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
                    cut = np.frombuffer(merged(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])[1][0], np.int64)
                    raw = text.encode()
                    edges = [0, *cut.tolist(), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode(errors="ignore")
                out.append(text)
            new = {"text": pa.array(out, t.schema.field("text").type)}
            if "n_chars" in schema.names:
                new["n_chars"] = pa.array([None if x is None else len(x) for x in out], t.schema.field("n_chars").type)
            yield from pa.Table.from_arrays([new.get(c, t.column(c)) for c in schema.names], names=schema.names).to_batches()

    return docs.join(gone, own == F.col(key), "left").select(*(docs[c] for c in schema.names), cuts).mapInArrow(run, schema)
