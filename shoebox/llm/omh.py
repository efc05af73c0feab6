"""Near-duplicate documents by Order MinHash and banded alignment.

A sketch of a text takes the few k-mers of words (Options.k) with the smallest hashes, each k-mer labelled with how many times it came
before, and keeps them in the order of the text; so it agrees for texts of small edit distance and not for texts
with the same words in another order. Texts that agree in one sketch are candidates, and an alignment of their words
within the band that the threshold allows decides.

Equal texts count once. In a bucket of texts with equal sketches each text is first compared with one centre, never with all others, which joins most of a large group of near copies
at one comparison for each text. Similarity is not transitive, so then all texts of a bucket that no chain of links joins yet meet in cells of at most DEALT texts on either side, as bags of hashed words.
Only those pairs leave a cell, to be aligned, that neither their bags nor the triangle inequality over their edits to the centre rule out: unlike texts with a passage or a line in common, however many,
are told by their bags. In a first round a text leaves a cell with a few such texts, then with all; a pair leaves only the first bucket in which it meets. Nothing is capped. Links are closed to classes by connected components.

Cases: null and empty texts are equal texts of one class; texts of fewer words than a k-mer are one k-mer; texts without
any word have only equal texts; a very long text is sketched whole, alone in its chunk, and aligned in bands that widen only as far as needed; rows with the same id and text are one document;
of a class the smallest id stays, ties go to the smaller hash of id and text; null ids rank last in their class; an empty table gives an empty one; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components


@dataclass(frozen=True)
class Options:
    k: int = 5
    #: More sketches find more of the pairs near the threshold, whose k-mers mostly differ; README has the shares.
    sketches: int = 64
    #: k-mers of a sketch.
    kept: int = 3
    #: Edit similarity of the words: 1 - edits / words of the longer text.
    threshold: float = 0.8


SKETCH = "doc_id long, row_key long, d1 long, d2 long, n_words long, keys array<long>"


def kmers(w: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-mer, the same labelled by its occurrence, and its document; short documents have one k-mer."""
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    count = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    of = np.repeat(np.arange(n), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    h = np.zeros(len(of), np.uint64)
    for j in range(k):
        there = at + j < (first + size)[of]
        h = h * np.uint64(0x9FB21C651E98DF25) + np.where(there, w[np.minimum(at + j, max(len(w) - 1, 0))], 0).astype(np.uint64)
    h = C.mix(h)
    order = np.argsort(h ^ C.mix(of.astype(np.uint64)), kind="stable")
    same = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])))[: len(order)]
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    label = np.empty_like(h)
    label[order] = C.mix(h[order] + run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, label, of


def sketches(values: list[str | None], o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and its sketches' hashes, texts x sketches; texts without words have zeros."""
    n = len(values)
    data, starts, ends, doc = C.words(values)
    w = C.hash_runs(data, starts, ends)
    out = np.zeros((n, o.sketches), np.uint64)
    h, label, of = kmers(w, doc, n, o.k)
    if len(h):
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        docs = of[begin]
        bits = np.uint64(max(int(len(h)).bit_length(), 1))
        mask = np.uint64((1 << int(bits)) - 1)
        place = np.arange(len(h), dtype=np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        for s in range(o.sketches):
            key = (label * C.BYTE[s % 256] * np.uint64(2 * (s // 256) + 1)) & ~mask | place
            found = np.empty((len(docs), o.kept), np.uint64)
            for j in range(o.kept):
                found[:, j] = np.minimum.reduceat(key, begin)
                if j + 1 < o.kept:
                    key[(found[:, j] & mask).astype(np.int64)[found[:, j] != full]] = full
            none = found == full  # texts of fewer k-mers
            at = np.sort(np.where(none, np.int64(1) << 62, (found & mask).astype(np.int64)), 1)
            total = np.full(len(docs), s + 1, np.uint64)
            for j in range(o.kept):
                total = C.mix(total * np.uint64(0x9FB21C651E98DF25) + np.where(at[:, j] < len(h), h[np.minimum(at[:, j], len(h) - 1)], np.uint64(0)))
            out[docs, s] = total
    return np.bincount(doc, minlength=n), out


def _sketch(o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches):
            n, keys = sketches(t.column("text").to_pylist(), o)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, o.sketches, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            cols = [t.column(c).combine_chunks() for c in ("doc_id", "row_key", "d1", "d2")]
            yield pa.record_batch([*cols, pa.array(n), flat], ["doc_id", "row_key", "d1", "d2", "n_words", "keys"])

    return run


#: Words that are compared at once on each diagonal.
STRIDE = 24
#: Edits that are looked for in a narrow band first.
NARROW = 12


def _slide(a: np.ndarray, b: np.ndarray, k: np.ndarray, i: np.ndarray) -> np.ndarray:
    """From the places i in a, the next mismatch or end on the diagonals where b is ahead by k."""
    n, m = len(a), len(b)
    if not n or not m:
        return i
    i, on = i.copy(), np.arange(len(i))
    step = np.arange(STRIDE)
    while len(on):
        x = i[on][:, None] + step
        y = x + k[on][:, None]
        equal = (x < n) & (y < m) & (a[np.minimum(x, n - 1)] == b[np.minimum(y, m - 1)])
        run = np.where(equal.all(1), STRIDE, equal.argmin(1))
        i[on] += run
        on = on[run == STRIDE]
    return i


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two bags share."""
    _, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    top = int(number.max(initial=-1)) + 1
    return int(np.minimum(np.bincount(number[: len(a)], minlength=top), np.bincount(number[len(a) :], minlength=top)).sum())


def compared(a: np.ndarray, b: np.ndarray, most: int) -> tuple[bool, int]:
    """Whether two word sequences have an edit distance of at most `most`, and the distance; if not, a number that it is not below.

    An edit changes one word and two pairs of words: sequences that share too few of either are not aligned. Others are aligned first in a narrow band, then in wider ones,
    so that few edits take little whatever the length; of those a distance up to twice the limit is told exactly.
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    long = max(len(a), len(b))
    low = long - _shared(a, b)
    if low <= most and long:
        low = max(low, -(-(long - 1 - _shared(a[:-1] << 32 | a[1:], b[:-1] << 32 | b[1:])) // 2))
    if low > most:
        return False, low
    width, last = min(most, NARROW), 2 * most
    found = _banded(a, b, width) if low <= width else None
    while found is None and width < last:
        width = min(max(width, 1) * 8, last)
        found = _columns(a.tolist(), b.tolist(), width)
    if found is None:
        return False, max(low, 2 * most + 1)
    return found <= most, found


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most `most`."""
    near, distance = compared(a, b, most)
    return distance if near else None


def _columns(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance if it is at most `most`, in a band of 2 * most + 1 diagonals: for each word of b the differences of neighbouring cells of the
    band are the bits of a few numbers, and the band moves one word of a further on. Time is len(b) times the band's width in machine words."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    width = 2 * most + 1
    full = (1 << width) - 1
    more = full >> most << most  # the cell below is larger by one: rows 1 and on; above the first row the cells grow upwards
    less = full ^ more
    score = abs(n - m)
    end = 1 << (most + n - m)  # the diagonal of the last cell
    places: dict[int, tuple[int, int]] = {}  # of a word: its bits in the band, and for which column
    for i, x in enumerate(a[:most]):  # the band's last row enters with its column
        bits, at = places.get(x, (0, 0))
        places[x] = bits | 1 << (i + 1 + most), 0
    for j, x in enumerate(b, 1):
        if not j % width:  # forget words that the band has passed
            places = {w: (bits >> (j - 1 - at), j - 1) for w, (bits, at) in places.items() if bits >> (j - 1 - at)}
        if (i := j + most - 1) < n:
            bits, at = places.get(a[i], (0, j))
            places[a[i]] = bits >> (j - at) | 1 << (2 * most), j
        bits, at = places.get(x, (0, j))
        equal = bits >> (j - at)
        diagonal = ((((equal & more) + more) ^ more) | equal | less) & full
        up, down = less | (full & ~(diagonal | more)), diagonal & more
        if j > m - n and not diagonal & end:
            score += 1
            if score > most:
                return None
        ahead = diagonal >> 1
        more, less = down | (full & ~(ahead | up)), ahead & up
    return score


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """By furthest reaching points on the diagonals of the band."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    k = np.arange(-most - 1, most + 2)  # a diagonal more on either side, never reached
    reach = np.full(len(k), -2, np.int64)
    goal = m - n + most + 1
    reach[most + 1] = _slide(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for e in range(most + 1):
        if reach[goal] >= n:
            return e
        lo, hi = max(most - e, most + 1 - n), min(most + 2 + e, most + 1 + m)  # diagonals after one more edit
        lo, hi = max(lo, 1), min(hi, len(k) - 2)
        own = slice(lo, hi + 1)
        i = np.maximum(np.maximum(reach[own] + 1, reach[lo - 1 : hi]), reach[lo + 1 : hi + 2] + 1)
        i = np.minimum(i, np.minimum(n, m - k[own]))
        good = i >= np.maximum(0, -k[own])
        new = np.full(len(k), -2, np.int64)
        at = np.flatnonzero(good)
        new[lo + at] = _slide(a, b, k[own][at], i[at])
        reach = new
    return None


#: Texts of more words have no bag; only their alignment tells.
LONG = 4096


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in C.chunks(batches):
        data, starts, ends, doc = C.words(t.column("text").to_pylist())
        w = (C.hash_runs(data, starts, ends) >> np.uint64(32)).astype("<u4")
        bag = (kmers(w.astype(np.uint64), doc, len(t), 1)[1] >> np.uint64(48)).astype("<u2")
        cut = np.searchsorted(doc, np.arange(len(t) + 1))
        runs = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        bags = [bag[a:b].tobytes() if b - a <= LONG else None for a, b in runs]
        yield pa.record_batch([t.column("node").combine_chunks(), pa.array([w[a:b].tobytes() for a, b in runs], pa.binary()), pa.array(bags, pa.binary())], ["node", "words", "bag"])


def _verify(o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                found.append(compared(a, b, int((1 - o.threshold) * max(len(a), len(b)) + 1e-9)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.bool_()), pa.array([n for _, n in found], pa.int64())], ["a", "b", "ok", "distance"])

    return run


def _tested(pairs: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    """a, b, ok, distance of each pair: whether the two texts are similar, and how many edits they are apart, at least if they are not; words: node and its words' hashes."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return C.written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(o), "a long, b long, ok boolean, distance long"))


#: Texts that a text leaves a cell with in the first round, and texts of a bucket on either side of a cell.
PART, DEALT = 16, 1024
CELL = ["band", "key", "i", "j"]


def _possible(n: np.ndarray, low: np.ndarray, up: np.ndarray, label: np.ndarray, order: np.ndarray, top: np.ndarray, keys: np.ndarray, bags: list[bytes | None], left: np.ndarray, right: np.ndarray, most: int, o: Options) -> Iterator[tuple[int, np.ndarray]]:
    """Of a cell's rows left those of right in other classes that can be similar to each, the first most of them; keys: those of sketches before the cell's, in which they must not agree. Of two rows outside of the largest class the later one is the left.

    A text has a token for each word and how many times it came before. An edit changes one, so similar texts share all tokens of the longer one but as many as there are edits. Tokens are
    known by 16 bits; those that are confused only make texts look more alike.
    """
    right = right[np.argsort(n[right], kind="stable")]
    size, unknown = n[right], np.array([bags[r] is None for r in right], bool)
    tokens = np.frombuffer(b"".join(bags[r] or b"" for r in right), "<u2").astype(np.int64)
    at = np.concatenate(([0], np.cumsum([len(bags[r] or b"") // 2 for r in right])))
    has = np.zeros(1 << 16, bool)
    for x in left:
        lo = int(np.searchsorted(size, o.threshold * n[x] - 1e-6))
        hi = int(np.searchsorted(size, n[x] / o.threshold + 1e-6, "right"))
        r = right[lo:hi]
        long = np.maximum(n[x], n[r])
        reach = (1 - o.threshold) * long + 1e-6
        ok = (label[r] != label[x]) & (top[r] | (order[x] > order[r])) & (low[x] - up[r] <= reach) & (low[r] - up[x] <= reach)
        if bags[x] is not None and ok.any():
            own = np.frombuffer(bags[x], "<u2")
            has[own] = True
            found = np.concatenate(([0], np.cumsum(has[tokens[at[lo] : at[hi]]])))
            has[own] = False
            ok &= unknown[lo:hi] | (found[at[lo + 1 : hi + 1] - at[lo]] - found[at[lo:hi] - at[lo]] >= long - reach)
        r = r[ok]
        r = r[~(keys[r] == keys[x]).any(1)]
        if len(r):
            yield x, r[np.argsort(order[r])[:most]]


def _cells(most: int, o: Options):
    def pairs(t: pa.Table) -> pa.RecordBatch:
        col = {c: t.column(c).to_numpy() for c in ("band", "key", "i", "j", "node", "rank", "n_words", "low", "up", "label", "side", "is_top")}
        bags = t.column("bag").to_pylist()
        keys = pc.list_flatten(t.column("keys")).to_numpy().reshape(len(t), -1)
        order = np.empty(len(t), np.int64)
        order[np.lexsort((col["node"], col["rank"]))] = np.arange(len(t))
        new = np.concatenate(([True], np.any([col[c][1:] != col[c][:-1] for c in CELL], 0), [True]))
        edge, a, b = np.flatnonzero(new), [], []
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            rows = np.arange(begin, end)
            side = col["side"][begin:end]
            for x, r in _possible(col["n_words"], col["low"], col["up"], col["label"], order, col["is_top"], keys[:, : col["band"][begin]], bags, rows[side == 0], rows[side == 1], most, o):
                a.append(np.where(order[r] > order[x], col["node"][r], col["node"][x]))
                b.append(np.where(order[r] > order[x], col["node"][x], col["node"][r]))
        both = [pa.array(np.concatenate([*v, np.zeros(0, np.int64)]), pa.int64()) for v in (a, b)]
        return pa.record_batch(both, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            differs = np.any([batch.column(c).to_numpy() != batch.column(c)[-1].as_py() for c in CELL], 0)
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # where this batch's last cell begins
            if not last and held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in CELL):
                yield pairs(pa.Table.from_batches(held))
                held = []
            elif last:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _met(own: DataFrame, top: DataFrame, bags: DataFrame, most: int, o: Options) -> DataFrame:
    """a, b: pairs in different classes of a bucket that can be similar, a the later one, at most so many for each text and cell."""
    # all have been compared with the bucket's centre; what has no edits to it has the same words
    own = own.join(top, ["band", "key"]).filter("up > 0").withColumn("is_top", F.col("label") == F.col("top")).join(bags, "node")
    spread = lambda n: F.pmod(F.xxhash64("node", "band"), F.col(n)).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    left, right = each("rights", lambda j: place(0, spread("lefts"), j)), each("lefts", lambda i: place(1, i, spread("rights")))
    dealt = own.withColumn("at", F.explode(F.when(F.col("is_top"), right).otherwise(F.concat(left, right))))
    cells = dealt.select("band", "key", "at.i", "at.j", "node", "rank", "n_words", "low", "up", "label", "at.side", "is_top", "keys", "bag")
    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_cells(most, o), "a long, b long")


def _closed(every: DataFrame, tested: DataFrame, nodes: DataFrame, words: DataFrame, o: Options) -> DataFrame:
    """node, label of all linked texts, once those of a bucket are in one class, have been compared, or cannot be similar; every: band (which sketch), key, node, rank, n_words, low, up of all crowded buckets.

    low and up bound the edits between a text and its bucket's first centre. Edit distances obey the triangle inequality: two texts whose distances to the centre differ by more edits than
    the threshold allows are not aligned. So a text far from a large group of near copies is aligned with none of them. Texts of a bucket's largest class need not meet each other.
    A first round with PART texts for each joins groups of near copies without the bucket's centre and most of what else belongs together; a second one compares all that is left. Classes so far are kept as stars.
    """
    links, bags = tested.filter("ok").select("a", "b"), C.written(words.select("node", "bag").join(nodes.select("node", "keys"), "node"))
    for most in (PART, sys.maxsize):
        C.release(every.sparkSession)
        label = components(links)
        star = label.filter("node != label").toDF("a", "b")
        own = C.written(every.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
        size = C.written(own.groupBy("band", "key", "label").agg(F.count("*").alias("size")))
        top = size.groupBy("band", "key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
        cells = lambda n: F.ceil(n / DEALT).cast("int")
        top = C.written(top.select("band", "key", F.col("top.label").alias("top"), cells(F.col("n") - F.col("top.size")).alias("lefts"), cells(F.col("n")).alias("rights")))
        if not top.limit(1).count():
            return label
        met = _met(own, top, bags, most, o).distinct()
        new = _tested(C.written(met.join(tested, ["a", "b"], "left_anti")), words, o)
        tested, links = tested.unionByName(new), star.unionByName(new.filter("ok").select("a", "b"))
    return components(links)


def _linked(nodes: DataFrame, rows: DataFrame, o: Options) -> DataFrame:
    """node, label of all texts that verified links join; nodes: node, rank, n_words, keys; rows: node, text."""
    members = nodes.filter("n_words > 0").select("node", "rank", "n_words", F.posexplode("keys").alias("band", "key"))
    order = F.struct("rank", "node", "n_words")
    crowd = members.groupBy("band", "key").agg(F.min(order).alias("c"), F.count("*").alias("n")).filter("n > 1")
    centre = C.written(crowd.select("band", "key", "c.*").toDF("band", "key", "c_rank", "centre", "c_words"))
    members = C.written(members.join(centre.select("band", "key"), ["band", "key"]))
    used = members.select("node").distinct()
    words = C.written(rows.join(used, "node", "left_semi").dropDuplicates(["node"]).select("node", "text").mapInArrow(_tokens, "node long, words binary, bag binary"))
    close = F.least("n_words", "c_words") >= o.threshold * F.greatest("n_words", "c_words") - 1e-6
    met = members.join(centre, ["band", "key"]).filter(F.expr("struct(rank, node) > struct(c_rank, centre)") & close)
    tested = _tested(C.written(met.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()), words, o)
    # what the centre of each bucket tells of its texts
    of = members.join(centre, ["band", "key"]).join(tested.select(F.col("a").alias("node"), F.col("b").alias("centre"), "ok", "distance"), ["node", "centre"], "left")
    own = F.col("node") == F.col("centre")
    low = F.when(own, 0).otherwise(F.coalesce("distance", F.abs(F.col("n_words") - F.col("c_words"))))
    up = F.when(own, 0).when(F.col("ok"), F.col("distance")).otherwise(F.greatest("n_words", "c_words"))
    return _closed(C.written(of.select("band", "key", "node", "rank", "n_words", low.cast("long").alias("low"), up.cast("long").alias("up"))), tested, nodes, words, o)


def classes(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows), kept of every row, with the columns C.KEYS."""
    C.tune(docs.sparkSession)
    rows, salt = C.keyed(docs), 0
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    while True:  # two different texts with one hash: all get another
        digests = rows.withColumn("d1", F.xxhash64(F.lit(salt), "text")).withColumn("d2", F.xxhash64(F.lit(1), F.reverse("text")))
        sketched = C.written(digests.mapInArrow(_sketch(o), SKETCH))
        nodes = C.written(
            sketched.groupBy("d1", "d2")
            .agg(F.min(F.struct(order.alias("rank"), "row_key", "n_words", "keys")).alias("x"), F.count("*").alias("n"))
            .select(F.col("d1").alias("node"), "d2", "n", "x.*")
        )
        if not C.unlike(nodes.select("node", "d2"), "node", "d2"):
            break
        salt += 1
    text = rows.select(F.xxhash64(F.lit(salt), "text").alias("node"), "text")
    label = _linked(nodes.select("node", "rank", "n_words", "keys"), text, o)
    own = C.written(nodes.join(label, "node", "left").select("node", "n", "rank", "row_key", F.coalesce("label", "node").alias("label")))
    whole = C.written(own.groupBy("label").agg(F.min(F.struct("rank", "row_key")).alias("first"), F.sum("n").alias("class_size")))
    found = C.written(own.join(whole, "label").select(F.col("node").alias("d1"), "first", "class_size"))
    class_id = F.when(F.col("first.rank") < (1 << 63) - 1, F.col("first.rank"))
    kept = F.struct(order.alias("rank"), "row_key") == F.col("first")
    return sketched.select("doc_id", "row_key", "d1").join(found, "d1").select("doc_id", class_id.alias("class_id"), "class_size", kept.alias("kept"), F.coalesce("doc_id", F.lit(0)).alias("row_id"), "row_key")


def representatives(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row of docs of each class, with all its columns; of rows with the same id and text one."""
    kept = C.written(classes(docs, o).filter("kept").groupBy(*C.KEYS).agg(F.count("*").alias("times")))
    own = C.unused(docs, C.KEYS)
    pick = lambda test: kept.filter(test).select(*(F.col(k).alias(n) for k, n in zip(C.KEYS, own, strict=True)))
    same = lambda one: docs.join(one, [k == F.col(n) for k, n in zip(C.row_keys(), own, strict=True)], "left_semi")
    out, more = same(pick("times = 1")), pick("times > 1")
    if more.limit(1).count():
        out = out.unionByName(same(more).dropDuplicates(["doc_id", "text"]))
    return out
