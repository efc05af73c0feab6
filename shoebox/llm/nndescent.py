"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from cells of random hyperplanes, several times over, large cells dealt to chunks by a hash. It is then refined through
joins of neighbours of neighbours: every vector's neighbours and those it is a neighbour of are compared with each other, and
each keeps the best it has met. Vectors of a cell are handled together, so a block of them gets each vector it
needs once. A list that is full of links is saturated and gets twice the room in the next round.

The links at the threshold close to components. What a list of bounded room could not hold is then made whole: within each component the
links of every vector are counted against all members, in tiles of bounded size and without emitting the pairs. An audit compares a sample of
vectors with all others and takes the mean share of their links that were found, each linked vector counting once; under Options.recall another attempt follows with more cells and longer lists. If recall is low after the last attempt, or links are so rare that even the largest sample holds
too few linked vectors to tell, all vectors are compared in blocks. Half of the sample is of vectors that have a neighbour near the threshold, so that it holds linked ones where links are rare.

Equal vectors are one node and are expanded only in the counts. Similarities are in double precision.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not link; rows with equal ids each
count as a vector; null ids are passed on and never name a component with others; equal similarities go to the smaller hash; an empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components


@dataclass(frozen=True)
class Options:
    threshold: float = 0.95
    #: Room of a neighbour list, and how often a saturated list is doubled.
    k: int = 10
    doublings: int = 2
    #: Sets of cells, vectors of a cell, rounds of refinement at most.
    trees: int = 6
    leaf: int = 400
    rounds: int = 4
    #: A round that changes a smaller share of the lists is the last.
    settled: float = 0.002
    tile: int = 512
    #: Vectors of the audit, at most in 16-fold for as many linked ones; recall to reach, attempts before all vectors are compared.
    audited: int = 128
    linked: int = 32
    #: The audit's vectors are drawn, half from all, half from those with a neighbour no further below the threshold than this.
    margin: float = 0.05
    recall: float = 0.99
    attempts: int = 3


def _units(vec: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vec), kind).astype(np.float64).reshape(len(vec), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(dim: int, tree: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, tree]).standard_normal((dim, bits))


LIST = "node long, ids binary, sims binary, star long"


def _best(ids: np.ndarray, sims: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The room best different neighbours; ties go to the smaller id."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:room]
    return ids[first], sims[first]


def _cells(o: Options, kind: str, bits: int, trees: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(1).to_pylist(), kind)
            weight = 1 << np.arange(bits, dtype=np.int64)
            for t in trees:
                cell = (x @ _planes(x.shape[1], t, bits) > 0) @ weight if bits else np.zeros(len(x), np.int64)
                yield pa.record_batch([batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(cell.astype(np.int64))], ["node", "tree", "cell"])

    return run


def _start(o: Options, kind: str, room: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        node, x = cell["node"].to_numpy(), _units(cell["vec"].tolist(), kind)
        sims = np.clip(x @ x.T, -1, 1)
        np.fill_diagonal(sims, -2)
        rows = []
        k = min(room, len(node) - 1)
        near = np.argpartition(-sims, k - 1, 1)[:, :k] if k else np.zeros((len(node), 0), int)
        order = np.argsort(node)
        linked = (sims >= o.threshold)[:, order]
        has = linked.any(1)
        star = node[order][linked.argmax(1)]
        for i, n in enumerate(node.tolist()):
            rows.append((n, node[near[i]].tobytes(), sims[i, near[i]].tobytes(), int(star[i]) if has[i] else n))
        return pd.DataFrame(rows, columns=["node", "ids", "sims", "star"])

    return run


GRAPH = "node long, ids binary, sims binary, fresh binary, room int, changed int"


def _merge(o: Options, start: int):
    """Of each node: its list so far (fresh is not null) and what it has met since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, parts, room in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                room = room or start
                ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
                sims = np.concatenate([np.frombuffer(p["sims"], np.float64) for p in parts])
                before = [np.frombuffer(p["ids"], np.int64) for p in parts if p["fresh"] is not None]
                old = before[0] if before else np.zeros(0, np.int64)
                other = ids != node
                ids, sims = _best(ids[other], sims[other], room)
                fresh = ~np.isin(ids, old)
                full = len(ids) == room and len(ids) and sims[-1] >= o.threshold
                grown = room * 2 if full and room < start << o.doublings else room
                out.append((node, ids.tobytes(), sims.tobytes(), fresh.tobytes(), grown, int(fresh.sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], [x.split()[0] for x in GRAPH.split(", ")])

    return run


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, other, fresh, sim of each neighbour."""
    for batch in batches:
        ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        sims = [np.frombuffer(x, np.float64) for x in batch.column(2).to_pylist()]
        fresh = [np.frombuffer(x, bool) for x in batch.column(3).to_pylist()]
        node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        yield pa.record_batch([pa.array(node), pa.array(cat(ids, np.int64)), pa.array(cat(fresh, bool)), pa.array(cat(sims, np.float64))], ["node", "other", "fresh", "sim"])


def _meet(o: Options, kind: str):
    """Neighbours of each node of a block meet; every vector gets the best it has met."""

    def run(edges: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(edges) or not len(vectors):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "ids": [], "sims": [], "star": pd.Series(dtype="int64")})
        vectors = vectors.sort_values("node")
        node, x = vectors["node"].to_numpy(), _units(vectors["vec"].tolist(), kind)
        worst, room = vectors["worst"].to_numpy(), vectors["room"].to_numpy()
        edges = edges.sort_values(["node", "part", "other"])
        at = np.searchsorted(node, edges["other"].to_numpy())
        fresh = edges["fresh"].to_numpy()
        own, part = edges["node"].to_numpy(), edges["part"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (part[1:] != part[:-1]), [True])))
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            p, f = at[a:b], fresh[a:b]
            if b - a < 2 or not f.any():
                continue
            new = np.flatnonzero(f)
            s = x[p[new]] @ x[p].T
            # pairs with a new one, better than what either has
            s[np.arange(len(new)), new] = -2
            i, j = np.nonzero((s > worst[p[new]][:, None]) | (s > worst[p][None, :]))
            if len(i):
                v = np.clip(s[i, j], -1, 1)
                met.append((np.concatenate((p[new[i]], p[j])), np.concatenate((p[j], p[new[i]])), np.concatenate((v, v))))
        if not met:
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "ids": [], "sims": [], "star": pd.Series(dtype="int64")})
        one, two, sim = (np.concatenate(c) for c in zip(*met, strict=True))
        keep = sim > worst[one]
        one, two, sim = one[keep], two[keep], sim[keep]
        order = np.lexsort((two, -sim, one))
        one, two, sim = one[order], two[order], sim[order]
        cut = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1], [True]))) if len(one) else np.zeros(1, int)
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            ids, sims = _best(node[two[a:b]], sim[a:b], int(room[one[a]]))
            rows.append((int(node[one[a]]), ids.tobytes(), sims.tobytes(), int(node[one[a]])))
        return pd.DataFrame(rows, columns=["node", "ids", "sims", "star"])

    return run


def _gather(lists: DataFrame, old: DataFrame | None, o: Options, room: int) -> DataFrame:
    part = lists.select("node", F.struct("ids", "sims", F.lit(None).cast("binary").alias("fresh")).alias("part"), F.lit(0).alias("room"))
    if old is not None:
        part = part.unionByName(old.select("node", F.struct("ids", "sims", "fresh").alias("part"), "room"))
    return C.written(part.groupBy("node").agg(F.collect_list("part").alias("parts"), F.max("room").alias("room")).mapInArrow(_merge(o, room), GRAPH))


def _refined(nodes: DataFrame, kind: str, o: Options, attempt: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that the graph holds after refinement, and the nodes (node) whose best neighbour is nearly at the threshold or beyond it."""
    trees, room = o.trees << attempt, o.k << attempt
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / o.leaf)))
    cells = C.written(nodes.select("node", "vec").mapInArrow(_cells(o, kind, bits, range(trees)), "node long, tree int, cell long").join(nodes.select("node", "dim"), "node"))
    size = C.written(cells.groupBy("tree", "cell", "dim").agg(F.count("*").alias("size")))
    chunk = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / (o.leaf * 2)))
    dealt = C.written(cells.join(size, ["tree", "cell", "dim"]).select("node", "tree", F.xxhash64("tree", "cell", "dim", chunk).alias("chunk")))
    lists = C.written(dealt.join(nodes.select("node", "vec"), "node").select("chunk", "node", "vec").groupBy("chunk").applyInPandas(_start(o, kind, room), LIST))
    stars = lists.filter("star != node").select(F.col("node").alias("a"), F.col("star").alias("b")).distinct()
    graph = _gather(lists, None, o, room)
    block = C.written(dealt.filter("tree = 0").select("node", F.col("chunk").alias("block")).dropDuplicates(["node"]))
    for turn in range(o.rounds):
        flat = C.written(graph.select("node", "ids", "sims", "fresh").mapInArrow(_unfold, "node long, other long, fresh boolean, sim double"))
        # a vector that very many have as a neighbour passes them on in parts, dealt anew in each round, each with its own neighbours
        many = flat.groupBy(F.col("other").alias("node")).agg(F.ceil(F.count("*") / (8 * room)).cast("int").alias("parts")).filter("parts > 1")
        own = flat.select("node", "other", "fresh").join(many, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        back = flat.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh").join(many, "node", "left").withColumn("part", F.pmod(F.xxhash64("node", "other", F.lit(turn)), F.coalesce("parts", F.lit(1))).cast("int"))
        around = own.unionByName(back).groupBy("node", "part", "other").agg(F.max("fresh").alias("fresh"))
        edges = C.written(around.join(block, "node").select(F.when(F.col("part") == 0, F.col("block")).otherwise(F.xxhash64("node", "part")).alias("block"), "node", "part", "other", "fresh"))
        need = edges.select(F.col("block").alias("at"), F.col("other").alias("node")).distinct()
        state = C.written(graph.select("node", "room", "ids", "sims").mapInArrow(_worst, "node long, room int, worst double").join(nodes.select("node", "vec"), "node"))
        vectors = need.join(state, "node")
        met = edges.groupBy("block").cogroup(vectors.groupBy("at")).applyInPandas(_meet(o, kind), LIST)
        graph = _gather(C.written(met), graph, o, room)
        changed = graph.agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("n")).first()["n"]
        if changed < o.settled * n * room:
            break
    flat = graph.select("node", "ids", "sims", "fresh").mapInArrow(_unfold, "node long, other long, fresh boolean, sim double")
    found = flat.filter(F.col("sim") >= o.threshold).select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(stars).distinct()
    return found, flat.filter(F.col("sim") >= o.threshold - o.margin).select("node").distinct()


def _worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How good a neighbour must be to get into the list."""
    for batch in batches:
        sims = [np.frombuffer(x, np.float64) for x in batch.column(3).to_pylist()]
        room = batch.column(1).to_pylist()
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([float(s[-1]) if len(s) >= r else -1.5 for s, r in zip(sims, room, strict=True)], pa.float64())], ["node", "room", "worst"])


def _counted(o: Options, kind: str):
    """Links of each member of one tile with the members of another of the same component."""

    def run(tiles: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, t in tiles.groupby("label", sort=False):
            left, right = t[t["side"] != 1], t[t["side"] != 0]
            if not len(left) or not len(right):
                continue
            linked = _units(left["vec"].tolist(), kind) @ _units(right["vec"].tolist(), kind).T >= o.threshold
            linked &= left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None, :]
            out.append(pd.DataFrame({"node": left["node"].to_numpy(), "links": linked @ right["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    return run


def _whole(nodes: DataFrame, label: DataFrame, kind: str, o: Options) -> DataFrame:
    """node, links: links of every node of a component with all other rows in it."""
    member = C.written(label.join(nodes.select("node", "vec", "n"), "node"))
    size = C.written(member.groupBy("label").agg(F.ceil(F.count("*") / o.tile).alias("tiles")))
    placed = member.join(size, "label").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    batches = member.count() // (8 * o.tile) + 1
    small = placed.filter("tiles = 1").withColumn("key", F.pmod(F.xxhash64("label"), F.lit(batches))).withColumn("side", F.lit(2))
    large = placed.filter("tiles > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
    # as the left side against every tile, as the right side for every tile; a tile against itself is both
    left = large.withColumn("side", F.when(F.col("tile") == F.col("with"), 2).otherwise(0)).withColumn("key", F.xxhash64("label", F.col("tile").cast("long"), F.col("with").cast("long")))
    right = large.filter(F.col("tile") != F.col("with")).withColumn("side", F.lit(1)).withColumn("key", F.xxhash64("label", F.col("with").cast("long"), F.col("tile").cast("long")))
    every = [x.select("key", "label", "node", "vec", "n", "side") for x in (small, left, right)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("key").applyInPandas(_counted(o, kind), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, links: DataFrame, kind: str, o: Options, near: DataFrame | None = None) -> tuple[float, bool]:
    """Mean share of the links found over the linked nodes of a sample, and whether it says anything: it holds enough of them, or all nodes. Without links it is 1 only if it held all nodes."""
    size, every = o.audited, nodes.count()
    while True:
        shares, n = _shares(nodes, links, kind, o, size, near)
        enough = len(shares) >= o.linked or n >= every
        if enough or size >= 16 * o.audited:
            return (sum(shares) / len(shares) if shares else float(n >= every)), enough
        size = 16 * o.audited


def _shares(nodes: DataFrame, links: DataFrame, kind: str, o: Options, size: int, near: DataFrame | None) -> tuple[list[float], int]:
    """Share of the links found of each linked node in a sample, and the sample's size; the sample meets all nodes in blocks."""
    first = lambda df, n: df.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(n).select("node", "vec", "dim").toArrow().to_pylist()
    sample = first(nodes, size if near is None else size // 2)
    if near is not None:  # and where too few have a near neighbour, more of all
        for source in (nodes.join(near, "node", "left_semi"), nodes):
            have = {s["node"] for s in sample}
            sample += [s for s in first(source, size) if s["node"] not in have][: size - len(sample)]
    if not sample:
        return [], 0
    sent = C.shared(nodes.sparkSession, sample)
    threshold = o.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n, node = _units(batch.column(1).to_pylist(), kind), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            same = [s for s in sent.value if s["dim"] == x.shape[1]]
            if same:
                linked = _units([s["vec"] for s in same], kind) @ x.T >= threshold
                linked &= np.array([s["node"] for s in same])[:, None] != node[None, :]
                for s, c in zip(same, (linked @ n).tolist(), strict=True):
                    total[s["node"]] = total.get(s["node"], 0) + c
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "links"])

    parts = nodes.groupBy("dim").agg(F.count("*")).count()
    source = nodes.select("node", "vec", "n", "dim")
    frames = [source] if parts == 1 else [source.filter(F.col("dim") == r["dim"]) for r in nodes.select("dim").distinct().collect()]
    truth: dict[int, int] = {}
    for f in frames:
        for r in f.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect():
            truth[r["node"]] = truth.get(r["node"], 0) + r["links"]
    found = {r["node"]: r["links"] for r in links.filter(F.col("node").isin([s["node"] for s in sample])).collect()}
    return [min(found.get(k, 0), v) / v for k, v in truth.items() if v], len(sample)


def _spanned(o: Options, kind: str):
    """Links that span what two blocks hold: each node with the smallest one that it reaches in them."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        left, right = (blocks[blocks["side"] == s] for s in (0, 1))
        out = [np.zeros((0, 2), np.int64)]
        if len(left):
            a, x = left["node"].to_numpy(), _units(left["vec"].tolist(), kind)
            b, y = (right["node"].to_numpy(), _units(right["vec"].tolist(), kind)) if len(right) else (a, x)
            i, j = np.nonzero(x @ y.T >= o.threshold)
            one, two = a[i], b[j]
            node, at = np.unique(np.concatenate((one, two)), return_inverse=True)
            i, j, label = at[: len(one)], at[len(one) :], np.arange(len(node))
            while True:
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            out.append(np.stack((node, node[label]), 1)[label != np.arange(len(node))])
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return run


#: Vectors of a block when all are compared.
BLOCK = 1024


def exact(nodes: DataFrame, kind: str, o: Options) -> DataFrame:
    """Links (a, b) with the components of all links: every block of vectors meets every other."""
    blocks = nodes.count() // BLOCK + 1
    placed = nodes.select("node", "vec", F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = (F.col("block") > F.col("with")).cast("int")
    placed = placed.select("node", "vec", side.alias("side"), F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    # a block against an empty one would meet itself, which its own pair does already
    return placed.groupBy("low", "high").applyInPandas(_spanned(o, kind), "a long, b long").distinct()


def link(vectors: DataFrame, o: Options = Options(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    C.tune(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    v = F.col("v") if kind == "<f4" else F.col("v").cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    salt = 0
    while True:  # two different vectors with one hash: all get another
        rows = rows.withColumn("node", F.when(good, F.xxhash64(F.lit(salt), "v")))
        packed = rows.filter("node is not null").groupBy("node", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        nodes = C.written(packed.select("node", v.alias("v"), "n", "first").mapInArrow(_pack(kind), "node long, vec binary, dim int, n long, first long"))
        if not C.unlike(nodes.select("node", "vec"), "node", "vec"):
            break
        salt += 1
    if nodes.select("dim").distinct().count() > 1:
        frames = [_linked(C.written(nodes.filter(F.col("dim") == r["dim"])), kind, o) for r in nodes.select("dim").distinct().orderBy("dim").collect()]
        linked = frames[0]
        for f in frames[1:]:
            linked = linked.unionByName(f)
    else:
        linked = _linked(nodes, kind, o)
    linked = C.written(linked)
    out = rows.join(linked, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.asarray(v, kind) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array([len(v) for v in vec], pa.int32()), batch.column(2), batch.column(3)], ["node", "vec", "dim", "n", "first"])

    return run


def _linked(nodes: DataFrame, kind: str, o: Options) -> DataFrame:
    """node, n_links, component_id of every node; all vectors have one length."""
    links, label, edges, recall, enough = None, None, None, 0.0, False
    for attempt in range(o.attempts):
        new, near = _refined(nodes, kind, o, attempt)
        new, near = C.written(new), C.written(near)
        edges = new if edges is None else C.written(edges.unionByName(new).distinct())
        label = components(edges)
        links = C.written(_whole(nodes, label, kind, o))
        recall, enough = audit(nodes, links, kind, o, near)
        if recall >= o.recall or not enough:
            break
    if recall < o.recall or not enough:  # links too rare to be measured by a sample are found by comparing all
        label = components(C.written(exact(nodes, kind, o)))
        links = C.written(_whole(nodes, label, kind, o))
    own = C.written(nodes.select("node", "n", "first").join(label, "node", "left").select("node", "n", "first", F.coalesce("label", "node").alias("label")))
    whole = C.written(own.groupBy("label").agg(F.min("first").alias("component_id")))
    return own.join(whole, "label").join(links, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
