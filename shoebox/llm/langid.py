"""Language identification by inference of a mixture of languages.

Each language has a smoothed model of the byte trigrams inside words, hashed to a fixed number of cells. Every word of a
document gets a likelihood from every language; expectation-maximisation then finds the proportions of the languages
that explain the document's words best. It runs for the best one, two, ... languages in turn, and the set with the largest
penalised likelihood is the document's: a further language has to gain more than the penalty.

The trigram models are fitted on a bounded sample of the documents with a language (Options.max_docs of each, the
smallest by a hash of the id), counted in Spark; what is broadcast has Options.cells x languages numbers whatever the
corpus holds, at most Options.numbers while there are no more than 16,384 languages. Inference is one pass over all documents, many documents at once in numpy, without a shuffle.

Cases: null or empty texts and texts without a letter are `und` with score 0; without any document to learn from, as with an empty table, all are
`und` and known() has nothing to judge by, so all rows stay; a very long text is taken whole, alone in its chunk; only the named columns are read, so others may have any name; null languages are not learned; null ids are predicted, and not learned from; equal texts get equal results, ties go to the
first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Options:
    #: Documents that a language's model is fitted on, at most.
    max_docs: int = 1500
    #: Cells of a language's model, at most; with many languages fewer (a power of two, 1,024 at least), so that all models have at most `numbers`. No language is left out.
    cells: int = 1 << 18
    numbers: int = 1 << 24
    hold_out: int = 3
    rounds: int = 6
    #: Nats that each further language must gain, times the log of the number of words, on top of half of it.
    penalty: float = 3.0


UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"


def _cells(data: np.ndarray, cells: int) -> np.ndarray:
    """For each byte: the hashed cell of the trigram around it; bytes outside words count as one."""
    key = np.full(len(data) + 2, 32, np.uint32)
    key[1:-1] = np.where(C.WORD[data], data, np.uint8(32))
    key = (key[:-2] << np.uint32(16)) | (key[1:-1] << np.uint32(8)) | key[2:]
    key *= np.uint32(0x9E3779B1)
    key >>= np.uint32(32 - cells.bit_length() + 1)
    return key


def fit(docs: DataFrame, options: Options = Options()) -> tuple[list[str], np.ndarray] | None:
    """Languages and their models: log-probabilities, languages x cells."""
    rows = docs.filter("doc_id is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter(C.crc_mod("doc_id", options.hold_out) != 1)
    # the first of each language, cut to their number in every task before they meet
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    use = C.written(rows.withColumn("place", place).filter(F.col("place") <= options.max_docs).groupBy("doc_id").agg(F.min("lang").alias("lang")))
    langs = sorted(r["lang"] for r in use.select("lang").distinct().collect())
    if not langs:
        return None
    sample = C.texts(docs).join(F.broadcast(use), "doc_id").select("text", "lang")
    number, cells = {x: i for i, x in enumerate(langs)}, options.cells
    while cells > 1024 and cells * len(langs) > options.numbers:
        cells //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), cells), np.int64)
        for t in C.chunks(batches, limit=2 << 20):
            data, starts, ends, doc = C.words(t.column("text").to_pylist())
            if len(starts):
                lang = np.array([number[x] for x in t.column("lang").to_pylist()])[doc]
                cell = _cells(data, cells)
                inside = np.repeat(lang * cells, ends - starts) + cell[C.WORD[data]]
                total += np.bincount(inside, minlength=total.size).reshape(total.shape)
        for i in range(len(langs)):
            at = np.flatnonzero(total[i])
            yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[i, at])], ["lang", "cell", "n"])

    counted = sample.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    model = np.zeros((len(langs), cells))
    model[counted.column("lang").to_numpy(), counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    # what no language has seen, and a little of what another one has
    shared = (model.sum(0) + 0.1) / (model.sum() + 0.1 * cells)
    model = (model + 50 * shared + 0.02) / (model.sum(1, keepdims=True) + 50 + 0.02 * cells)
    return langs, np.log(model).astype(np.float32)


def _mixtures(like: np.ndarray, starts: np.ndarray, size: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many documents: proportions and log-likelihoods. like: words x languages; use: documents x languages allowed."""
    pi = use / use.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = like * np.repeat(pi.astype(np.float32), size, 0)
        total = joint.sum(1, keepdims=True)
        pi = np.add.reduceat(joint / np.maximum(total, 1e-30), starts, 0) / size[:, None]
    joint = (like * np.repeat(pi.astype(np.float32), size, 0)).sum(1)
    return pi, np.add.reduceat(np.log(np.maximum(joint, 1e-30)), starts)


def infer(values: list[str | None], langs: list[str], model: np.ndarray, options: Options = Options()) -> list[tuple[str, float, list[str], list[float]]]:
    """Of each text: the language with the largest share, that share times how sure it is, the set of languages and their shares."""
    out = [(UNKNOWN, 0.0, [], [])] * len(values)
    data, starts, ends, doc = C.words(values)
    if not len(starts):
        return out
    cell, at = _cells(data, model.shape[1])[C.WORD[data]], np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    logs = np.stack([np.add.reduceat(m[cell], at) for m in model], 1)
    best = logs.max(1, keepdims=True)
    like = np.exp(np.maximum(logs - best, -12))  # a word is never proof on its own
    docs, first, size = np.unique(doc, return_index=True, return_counts=True)
    every = np.ones((len(docs), len(langs)))
    pi, _ = _mixtures(like, first, size, every, options.rounds)
    rank = np.argsort(np.argsort(-pi, 1, kind="stable"), 1, kind="stable")
    held = None
    for k in range(1, len(langs) + 1):  # all sizes for each document, whatever its neighbours
        pi, ll = _mixtures(like, first, size, (rank < k).astype(float), 1 if k == 1 else options.rounds)
        value = ll - (k - 1) * (0.5 + options.penalty) * np.log(size + 1)
        if held is None:
            held = [pi, value]
        else:
            better = value > held[1]
            held = [np.where(better[:, None], pi, held[0]), np.maximum(value, held[1])]
    pi = held[0]
    # how sure: the share of the leading language, drawn to the middle for documents of few words
    total = np.add.reduceat(logs, first, 0)
    gap = np.exp(np.maximum(total - total.max(1, keepdims=True), -50))
    sure = gap.max(1) / gap.sum(1)
    top = pi.argmax(1)
    share = pi.max(1)
    for i, d in enumerate(docs):
        text = values[d]
        if not any(c.isalpha() for c in (text if len(text) < 200 else text[:200])) and not any(c.isalpha() for c in text):
            continue
        own = np.flatnonzero(pi[i] > 0.005)
        own = own[np.argsort(-pi[i, own], kind="stable")]
        out[d] = (langs[top[i]], float(share[i] * (sure[i] if share[i] > 0.999 else 1)), [langs[j] for j in own], [float(pi[i, j]) for j in own])
    return out


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray] | None, options: Options = Options()) -> DataFrame:
    """doc_id, lang_pred, score, languages and proportions of each document."""
    rows = C.texts(docs)
    if fitted is None:
        empty = F.array().cast("array<string>")
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), empty.alias("languages"), empty.cast("array<double>").alias("proportions"))
    sent = C.shared(docs.sparkSession, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, limit=2 << 20):
            lang, score, languages, shares = zip(*infer(t.column("text").to_pylist(), *sent.value, options), strict=True)
            yield pa.record_batch([t.column("doc_id").combine_chunks(), pa.array(lang), pa.array(score), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    return rows.mapInArrow(run, SCHEMA)


def known(docs: DataFrame, fitted: tuple[list[str], np.ndarray] | None, least: float, options: Options = Options()) -> DataFrame:
    """The rows of docs whose text has a language, with a score of `least` or more, with all their columns."""
    if fitted is None:
        return docs
    sent = C.shared(docs.sparkSession, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, limit=2 << 20):
            found = infer(t.column("text").to_pylist(), *sent.value, options)
            yield from t.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in found])).to_batches()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Predict the languages of all documents with models fitted on those whose language is known."""
    C.tune(docs.sparkSession)
    return predict(docs, fit(docs, options), options)
