"""Language-model scores from a weighted backoff automaton.

The bigram model of all training documents is an automaton: each word is a state, an arc for each pair seen in training
leads to the next word's state, and a failure arc leads to the root, which has an arc for every word. Weights are
log10-probabilities with Dirichlet smoothing: the arc from u by w weighs (c(u,w) + mass * p(w)) / (c(u) + mass), u's failure arc
mass / (c(u) + mass), and the root's arcs the smoothed p(w) = (c(w) + add) / (N + add * (V + 1)). The weights from each state add up to 1. A text is read
once from left to right; the state is carried along and the weights of the arcs taken are summed.

The automaton grows with the corpus, so no task holds it whole: counts are gathered by bucket (exchange.py) and every block of
documents gets the part of the automaton that its texts can reach, builds it, and traverses it with all its texts. Words and
pairs are known by 64-bit hashes.

Cases: null and empty texts are the end token alone; null ids are scored but not learned from, their held_out is null; repeated rows are each
learned from and scored; without training documents, N and V are 0 and every token has the probability of an unknown word, 1; a very long text is read whole, alone in its block; an empty
table gives an empty one; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X


@dataclass(frozen=True)
class Options:
    #: Rows whose crc32(id) modulo this is 1 are not learned from.
    hold_out: int = 5
    add: float = 0.5
    #: How many observations a state's backoff distribution is worth.
    mass: float = 400.0
    #: Bytes of text of a block, and keys of a bucket.
    block: int = 8 << 20
    bucket: int = 1_000_000


#: ASCII white space parts words; A-Z are lower-cased.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
END = np.uint64(0xE4D0_0000_0000_0001)
BLOCK = "block long, docs array<long>, mods array<long>, sizes array<long>, seq binary, words binary, n_pairs long"


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts raw[at[i]:at[i+1]], each text's end included, and their number in each text."""
    n = len(at) - 1
    # a space between the texts
    data = np.full(len(raw) + n, 32, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(at))] = LOWER[raw]
    starts, ends = C.runs(INSIDE[data])
    doc = np.searchsorted(at[1:] + np.arange(n), starts, "right")
    size = np.bincount(doc, minlength=n) + 1
    out = np.empty(len(starts) + n, np.uint64)
    out[np.arange(len(starts)) + doc] = C.hash_runs(data, starts, ends)
    out[np.cumsum(size) - 1] = END
    return out, size


def _pack(o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = X.block_ids()
        for t in C.chunks(batches, limit=o.block, fill=True):
            token, size = tokens(*C.strings(t.column("text")))
            words, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            row = [next(ids), t.column("doc_id").to_pylist(), t.column("mod").to_pylist(), size, X.squeeze(place[inverse]), words[order].tobytes(), len(token)]
            yield pa.record_batch([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64() if isinstance(v, int) else pa.list_(pa.int64())) for v in row], ["block", "docs", "mods", "sizes", "seq", "words", "n_pairs"])

    return run


class _Block:
    """A block's tokens and the pairs in it."""

    def __init__(self, seq: bytes, words: bytes, sizes: np.ndarray, mods: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.seq = X.unsqueeze(seq, np.uint32).astype(np.int64)
        self.words = np.frombuffer(words, np.uint64)
        self.learn = np.repeat(np.array([m is not None and m == m and m != 1 for m in mods]), self.sizes)
        first = np.zeros(len(self.seq), bool)
        first[np.cumsum(self.sizes)[:-1]] = True
        first[:1] = True
        self.second = np.flatnonzero(~first)  # where a pair ends
        hashed = self.words[self.seq]
        self.pair = C.mix(hashed[self.second - 1] * np.uint64(0x9FB21C651E98DF25) ^ hashed[self.second])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of words and pairs, their training counts, and whether a key is a word's."""
        pairs, inverse = np.unique(self.pair, return_inverse=True)
        own = np.bincount(inverse, weights=self.learn[self.second], minlength=len(pairs))
        word = np.bincount(self.seq, weights=self.learn, minlength=len(self.words))
        keys, counts = np.concatenate((self.words, pairs)), np.concatenate((word, own)).astype(np.uint32)
        kind = np.zeros(len(keys), np.uint8)
        kind[: len(self.words)] = 1
        order = np.argsort(keys)
        return keys[order], counts[order], kind[order]


def _ask(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts, kind = _Block(r["seq"], r["words"], r["sizes"], r["mods"]).keys()
                at = np.append(np.searchsorted(keys, edges), len(keys))
                out = [(k, X.rising(keys[a:b]), X.squeeze(counts[a:b] * np.uint32(2) + kind[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                if out:
                    bucket, packed, extra = zip(*out, strict=True)
                    yield pa.record_batch([pa.array([r["block"]] * len(out), pa.int64()), pa.array(bucket, pa.int64()), pa.array(packed, pa.binary()), pa.array(extra, pa.binary())], ["block", "bucket", "keys", "extra"])

    return run


def _count(requests: pd.DataFrame) -> list[bytes]:
    """Training counts of each request's keys; the first bytes: distinct and all training words of the bucket, with the first request only."""
    keys = [X.unrising(k) for k in requests["keys"]]
    extra = [X.unsqueeze(e, np.uint32) for e in requests["extra"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.concatenate(extra)
    total = np.bincount(inverse, weights=both >> 1, minlength=len(every))
    word = np.zeros(len(every), bool)
    word[inverse[(both & 1) == 1]] = True
    head = np.array([(total[word] > 0).sum(), total[word].sum()], np.int64).tobytes()
    counts = total.astype(np.uint64)[inverse]  # of the whole corpus, so beyond 32 bits
    out, at = [], 0
    for k in keys:
        out.append((head if not out else bytes(16)) + X.squeeze(counts[at : at + len(k)]))
        at += len(k)
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _traverse(o: Options, edges: np.ndarray, n: int, v: int):
    def run(block: pd.Series | None, answers: dict[int, bytes]) -> pd.DataFrame:
        names = [x.split()[0] for x in SCORES.split(", ")]
        if block is None:
            return pd.DataFrame(columns=names)
        b = _Block(block["seq"], block["words"], block["sizes"], block["mods"])
        keys, _, _ = b.keys()
        counts = np.concatenate([X.unsqueeze(answers[k][16:], np.uint64) for k in range(len(edges)) if k in answers]) if answers else np.zeros(0, np.uint64)
        # the part of the automaton that this block can reach: states are words
        seen = counts[np.searchsorted(keys, b.words)].astype(float)
        root = (seen + o.add) / (n + o.add * (v + 1))  # the root's arcs
        fail = np.where(seen > 0, np.log10(o.mass / (seen + o.mass)), 0.0)  # a state that training has not seen is the root itself
        # left to right: the state is the word before; take its arc, or fail to the root and take the root's
        state, word = b.seq[b.second - 1], b.seq[b.second]
        arc = counts[np.searchsorted(keys, b.pair)]
        taken = np.where(arc > 0, np.log10((arc + o.mass * root[word]) / (seen[state] + o.mass)), fail[state] + np.log10(root[word]))
        base = np.log10(root)[b.seq]
        weight = base.copy()
        weight[b.second] = taken
        start = np.cumsum(b.sizes) - b.sizes
        mods = [None if m is None or m != m else int(m) for m in block["mods"]]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if d is None or d != d else int(d) for d in block["docs"]], "Int64"), "held_out": pd.array([None if m is None else m == 1 for m in mods], "boolean"),
                "n_tokens": b.sizes, "n_known": np.add.reduceat((seen > 0)[b.seq].astype(np.int64), start), "train_tokens": n,
                "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(weight, start),
            }
        )

    return run


def score(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Learn from the documents that are not held out and score all of them."""
    C.tune(docs.sparkSession)
    rows = C.texts(docs).withColumn("mod", C.crc_mod("doc_id", o.hold_out))
    blocks = C.written(rows.mapInArrow(_pack(o), BLOCK))
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("words") / 8 + F.col("n_pairs") * 0.7), F.lit(0)).alias("n")).first()["n"]
    edges = X.bucket_edges(int(size // o.bucket) + 1)
    asked = blocks.mapInArrow(_ask(edges), X.ASK)
    answers = C.written(X.answered(asked, _count))
    totals = answers.select(F.substring("answer", 1, 16).alias("head")).mapInArrow(_heads, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    return X.returned(blocks, answers, _traverse(o, edges, totals["n"] or 0, totals["v"] or 0), SCORES)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["v", "n"])
