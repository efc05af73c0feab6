"""Toxicity from class-conditional Kneser-Ney models.

Two interpolated bigram models, of toxic and of ordinary documents, back off to a unigram model of their class from continuation
counts, and that one to a unigram model from the continuation counts that both classes share. Discounts depend on the count and are estimated
from the counts of counts; what a class has seen once is discounted wholly, so a rare expression gets what the shared counts say, alike in both classes.

The log-likelihoods of a text under the two models are compared after division by the number of words, for the whole text and for the one and the two words
where the difference is largest: a few words decide in a long text as they do in a short one. A logistic curve of these differences, none
of which may count against toxicity as it grows, turns them into a score from 0 to 1; it is fitted on labelled documents that the models have not seen, with the
classes weighted as they are among all labelled ones.

The models are fitted on a bounded sample of the labelled rows (Options.max_docs, in proportion, but of the rarer class at least an eighth of the bound
if there are as many; the smallest by a hash of the id); counting runs in Spark, and only words and pairs seen at least twice in the sample reach the driver, so what is
broadcast is bounded by the sample. Scoring is one pass over all documents without a shuffle.

Cases: null and empty texts and texts without a word have differences of 0; a very long text is scored whole, alone in its chunk; null ids are scored,
held_out is null for them; repeated rows are each scored, alike; labels that are null or other than 0 and 1 are ignored, of an id labelled both ways the toxic label counts;
equal differences get equal scores, and a score equal to the threshold is predicted 1. Without labels of both classes, as with empty tables, every score is 0 and clean() keeps all rows. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Options:
    #: Labelled documents that the models and the curve are fitted on, at most.
    max_docs: int = 16000
    #: One in so many of them is for the curve.
    curve_share: int = 8
    #: Rows whose crc32(id) modulo this is 1 are not learned from.
    hold_out: int = 3
    threshold: float = 0.7


START = np.uint64(0x1)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return C.mix(u * np.uint64(0x9FB21C651E98DF25) + (w ^ np.uint64(0xD6E8FEB86659FD93)))


def _tokens(values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, the hash of the word before it in its text, its text's number."""
    data, starts, ends, doc = C.words(values)
    w = C.hash_runs(data, starts, ends)
    u = np.empty_like(w)
    if len(w):
        u[1:] = w[:-1]
        u[np.concatenate(([True], doc[1:] != doc[:-1]))] = START
    return w, u, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in C.chunks(batches, fill=True):
        w, u, doc = _tokens(t.column("text").to_pylist())
        label = np.asarray(t.column("toxic").to_numpy(), np.int64)[doc]
        key, first, inv = np.unique(_pair(u, w), return_index=True, return_inverse=True)
        c1 = np.bincount(inv, weights=label, minlength=len(key)).astype(np.int64)
        c = np.bincount(inv, minlength=len(key))
        yield pa.record_batch([pa.array(u[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(c - c1), pa.array(c1)], ["u", "w", "c0", "c1"])


def discounts(of: list[int], whole: bool) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many things were counted once, twice, three and four times; whole: all of a count of one."""
    rate = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    out = [0.0] + [min(max(k - (k + 1) * rate * of[k] / max(of[k - 1], 1), 0.1), k) for k in (1, 2, 3)]
    if whole:
        out[1] = 1.0
    return np.array(out)


def _taken(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3).astype(np.int64)]


def _of_counts(df: DataFrame, columns: tuple[str, ...]) -> dict[str, list[int]]:
    """Of each column: how many of its values are 1, 2, 3, 4, how many over 2, and their sum."""
    some = lambda c, test: F.count(F.when(test, 1)).alias(c)
    row = df.agg(*(some(f"{c}{k}", F.col(c) == k) for c in columns for k in (1, 2, 3, 4)), *(some(f"{c}_more", F.col(c) > 2) for c in columns), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum") for c in columns), F.count("*").alias("rows")).first()
    return {c: [row[f"{c}{k}"] for k in (1, 2, 3, 4)] + [row[f"{c}_more"], row[f"{c}_sum"]] for c in columns} | {"rows": row["rows"]}


def _model(pairs: DataFrame) -> dict[str, np.ndarray]:
    """Log-probability differences of words, pairs and backoff weights; pairs: u, w and their counts c0, c1 in the classes."""
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    by_word = pairs.groupBy("w").agg(seen("c0").alias("n0"), seen("c1").alias("n1"), F.count("*").alias("n"))
    words = _of_counts(by_word, ("n", "n0", "n1"))
    lower = by_word.filter("n >= 2").toArrow()
    w = lower.column("w").to_numpy().view(np.uint64)
    order = np.argsort(w)
    w, (n, n0, n1) = w[order], (lower.column(x).to_numpy()[order] for x in ("n", "n0", "n1"))

    # the shared model: continuation counts, interpolated with a uniform one over all words and one unknown
    d = discounts(words["n"], False)
    held = sum(d[k] * words["n"][k - 1] for k in (1, 2)) + d[3] * words["n"][4]
    total, floor = max(words["n"][5], 1), held / max(words["n"][5], 1) / (words["rows"] + 1)
    shared, single = (n - _taken(n, d)) / total + floor, (1 - d[1]) / total + floor

    # the classes' unigram models
    classes, back = [], []
    for own, c in ((n0, "n0"), (n1, "n1")):
        d = discounts(words[c], True)
        mass = sum(d[k] * words[c][k - 1] for k in (1, 2)) + d[3] * words[c][4]
        back.append(mass / words[c][5])
        classes.append((own - _taken(own, d)) / words[c][5] + back[-1] * shared)

    # the classes' bigram models: what follows a word, and the weight of backing off from it
    counts = _of_counts(pairs, ("c0", "c1"))
    high = [discounts(counts[c], True) for c in ("c0", "c1")]
    kept = pairs.filter("c0 + c1 >= 2")
    taken = lambda c, d: F.sum(F.when(F.col(c) == 1, float(d[1])).when(F.col(c) == 2, float(d[2])).when(F.col(c) > 2, float(d[3])).otherwise(0.0))
    follows = pairs.groupBy("u").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"), taken("c0", high[0]).alias("d0"), taken("c1", high[1]).alias("d1"), F.max(F.col("c0") + F.col("c1")).alias("most"))
    heads = follows.filter("most >= 2").toArrow()  # from others every pair was seen once: discounted wholly in its class
    u = heads.column("u").to_numpy().view(np.uint64)
    order = np.argsort(u)
    u, (s0, s1, t0, t1) = u[order], (heads.column(x).to_numpy()[order].astype(float) for x in ("s0", "s1", "d0", "d1"))
    weight = [np.where(s > 0, t / np.maximum(s, 1), 1.0) for s, t in ((s0, t0), (s1, t1))]
    few = kept.toArrow()
    pu, pw = few.column("u").to_numpy().view(np.uint64), few.column("w").to_numpy().view(np.uint64)
    key = _pair(pu, pw)
    order = np.argsort(key)
    key, pu, pw = key[order], pu[order], pw[order]
    at_u, at_w = C.lookup(pu, u), C.lookup(pw, w)
    pair = []
    for k, (c, s) in enumerate((("c0", s0), ("c1", s1))):
        own = few.column(c).to_numpy()[order]
        word = np.where(at_w >= 0, classes[k][at_w], back[k] * single) if len(w) else np.full(len(own), back[k] * single)
        pair.append((own - _taken(own, high[k])) / np.maximum(s[at_u], 1) + weight[k][at_u] * word if len(own) else np.zeros(0))
    ratio = lambda a: np.log(a[1]) - np.log(a[0])
    return {
        "word": w, "word_d": ratio(classes).astype(np.float32), "unseen_d": np.float32(ratio(back)),
        "head": u, "head_d": ratio([np.maximum(x, 1e-9) for x in weight]).astype(np.float32), "pair": key, "pair_d": ratio(pair).astype(np.float32),
    }


def differences(model: dict[str, np.ndarray], values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood difference, toxic minus ordinary, of each word given the one before it, of the word in any context, and its text's number."""
    w, u, doc = _tokens(values)
    at = C.lookup(w, model["word"])
    diff = np.where(at >= 0, model["word_d"][at] if len(model["word"]) else 0, model["unseen_d"]).astype(float)
    alone, head = diff.copy(), C.lookup(u, model["head"])
    if len(model["head"]):
        diff += np.where(head >= 0, model["head_d"][head], 0)
    known = np.flatnonzero(head >= 0)
    pair = C.lookup(_pair(u[known], w[known]), model["pair"])
    diff[known[pair >= 0]] = model["pair_d"][pair[pair >= 0]]
    return diff, alone, doc


def features(model: dict[str, np.ndarray], values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the length-normalised differences of all its words, of its most telling word and of its two most telling ones, with a constant; and its number of words.

    The whole is compared by pairs, the telling words by their continuation counts, as a pair met by chance tells nothing of its own. One word alone may be chance
    as well, and two are seldom; a text of one word counts as if the other told nothing.
    """
    diff, alone, doc = differences(model, values)
    n = np.bincount(doc, minlength=len(values))
    out = np.zeros((len(values), 4))
    out[:, 0] = C.per_doc(diff, doc, len(values)) / np.maximum(n, 1)
    order = np.lexsort((-alone, doc))
    first = (np.cumsum(n) - n)[n > 0]
    out[n > 0, 1] = alone[order[first]]
    out[:, 2] = out[:, 1] / 2
    out[n > 1, 2] += alone[order[(np.cumsum(n) - n)[n > 1] + 1]] / 2
    out[:, 3] = 1
    return out, n


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression, slightly drawn to 0: Newton steps, halved until they help; slopes are at least 0, the last coefficient is free."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 1e-3), 1e-5)

    def loss(b: np.ndarray) -> float:
        t = z @ b
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (ridge * b * b).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        grad = z.T @ (weight * (p - y)) + ridge * beta
        free = (beta > 0) | (grad < 0)
        free[-1] = True
        hess = (z[:, free] * (weight * p * (1 - p))[:, None]).T @ z[:, free] + np.diag(ridge[free])
        step, rate, now = np.linalg.solve(hess, grad[free]), 1.0, loss(beta)
        while rate > 1e-6:
            new = beta.copy()
            new[free] -= rate * step
            new[:-1] = np.maximum(new[:-1], 0)
            if loss(new) < now:
                break
            rate /= 2
        if rate <= 1e-6 or now - loss(new) < 1e-10 * max(now, 1):
            break
        beta = new
    return beta / scale


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> dict | None:
    """The models and the curve; None if a class has no documents to learn from."""
    truth = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learn = truth.filter(C.crc_mod("doc_id", options.hold_out) != 1)
    sizes = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    total, bound = sum(sizes.values()), options.max_docs
    rare = min(sizes, key=sizes.get)
    own = max(sizes[rare] * bound // total if total > bound else sizes[rare], min(sizes[rare], bound // 8))
    limits = {rare: min(own, sizes[rare]), 1 - rare: bound - min(own, sizes[rare])}
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [learn.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in limits.items()]
    use = chosen[0].unionByName(chosen[1])
    # a text that occurs again counts once
    sample = C.written(C.texts(docs).join(F.broadcast(use), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(options.curve_share)) == 0))
    pairs = C.written(sample.filter("not curve").select("text", "toxic").mapInArrow(_count, "u long, w long, c0 long, c1 long").groupBy("u", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    has = pairs.agg(F.max("c0").alias("c0"), F.max("c1").alias("c1")).first()
    if not has["c0"] or not has["c1"]:
        return None
    model = _model(pairs)
    sent = C.shared(docs.sparkSession, model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            x, _ = features(sent.value, t.column("text").to_pylist())
            yield pa.record_batch([t.column("toxic").combine_chunks(), pa.array(list(x))], ["toxic", "x"])

    seen = sample.filter("curve").select("text", "toxic").mapInArrow(evidence, "toxic int, x array<double>").toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    model["beta"] = np.zeros(4)
    if len(set(y)) == 2:
        share = sizes[1] / total
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model["beta"] = _fit(np.stack(seen.column("x").to_pylist()), y, weight)
    return model


def _scores(model: dict, values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, n = features(model, values)
    return 1 / (1 + np.exp(-np.clip(x @ model["beta"], -30, 30))), x[:, 0], n


def score(docs: DataFrame, model: dict | None, options: Options = Options()) -> DataFrame:
    """doc_id, score, predicted and the evidence per word of each document."""
    rows = C.texts(docs)
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("evidence"), F.lit(0).cast("long").alias("n_words"))
    sent = C.shared(docs.sparkSession, model)
    threshold = options.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            s, mean, n = _scores(sent.value, t.column("text").to_pylist())
            yield pa.record_batch([t.column("doc_id").combine_chunks(), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(mean), pa.array(n.astype(np.int64))], ["doc_id", "score", "predicted", "evidence", "n_words"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence double, n_words long")


def clean(docs: DataFrame, model: dict | None, options: Options = Options()) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    if model is None:
        return docs
    sent = C.shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            yield from t.filter(pa.array(_scores(sent.value, t.column("text").to_pylist())[0] < options.threshold)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """Score all documents with models fitted on the labelled ones."""
    C.tune(docs.sparkSession)
    return score(docs, fit(docs, labels, options), options)
