"""Faces and people: nearest person, main subjects, clustering, names, and shots from behind.

cluster() follows an order through all faces, so it is one task by definition of its result; everything around it is set-based.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.vectors import cosine, unit
from .dedupe import by_cells, by_groups
from .library import CLUSTER_VERSION, FACE_MODEL, Marks, without_orphans

SAME_PERSON = 0.32
WINDOW_MS = 4 * 60 * 60 * 1000


#: Bytes of vectors in double precision that are sent to all tasks at once.
SENT = 64 << 20


def _matrix(rows: list, at: list[int], d: int) -> np.ndarray:
    return np.array([() if rows[i] is None else rows[i] for i in at], float).reshape(len(at), d)


def _vectors(rows: list, dims: dict[int, list[int]]) -> dict[int, np.ndarray]:
    return {d: _matrix(rows, at, d) for d, at in dims.items()}


def _by_length(values: list) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        out.setdefault(0 if v is None else len(v), []).append(i)
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every row of x with every row of y, over the common length; 0 with a row that is zero there."""
    n = min(x.shape[1], y.shape[1])
    return _unit_rows64(x[:, :n]) @ _unit_rows64(y[:, :n]).T


def _unit_rows64(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _arrays(column: pa.Array) -> list:
    """Vectors of a column of lists, None for null."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    return [v if ok else None for v, ok in zip(np.split(flat, ends[:-1]), column.is_valid().to_pylist(), strict=True)] if len(column) else []


#: Faces and people whose likeness a task computes at once.
FACES_TILE, PEOPLE_TILE = 1 << 9, 1 << 12


def _people(ids: np.ndarray, vectors: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of people, those of one length together."""
    at = _by_length(vectors)
    return [(ids[np.array(at[d], int)], m) for d, m in _vectors(vectors, at).items()]


def _best_of(faces: list, people: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each face the best of some people, the last of equals by id: places of the faces that have one, who, and how near. Tiles of faces meet tiles of people, so memory does not grow with either."""
    score, who = np.full(len(faces), -np.inf), np.zeros(len(faces), np.int64)
    for d, places in _by_length(faces).items():
        places = np.array(places, int)
        for a in range(0, len(places), FACES_TILE):
            at = places[a : a + FACES_TILE]
            x = _matrix(faces, at.tolist(), d)
            for ids, y in people:
                for b in range(0, len(ids), PEOPLE_TILE):
                    own = ids[b : b + PEOPLE_TILE]
                    s = _cosines(x, y[b : b + PEOPLE_TILE])
                    best = np.fmax.reduce(s, axis=1, initial=-np.inf)
                    rows = np.flatnonzero(best >= np.maximum(score[at], threshold))
                    named = np.where(s[rows] == best[rows, None], own, np.iinfo(np.int64).min).max(1)
                    better = (best[rows] > score[at[rows]]) | (named > who[at[rows]])
                    rows, named = rows[better], named[better]
                    score[at[rows]], who[at[rows]] = best[rows], named
    hit = np.flatnonzero(score >= threshold)
    return hit, who[hit], score[hit]


#: Rows of a block of faces.
FACES_BLOCK = 1 << 14


def in_blocks(left: DataFrame, right: DataFrame, lkey: str, rkey: str, lrows: int, rrows: int, f, schema: str) -> DataFrame:
    """f of every block of left and every block of right, each side dealt to blocks of about as many rows by a hash of its key: a task has two blocks at a time."""
    nl, nr = left.count() // lrows + 1, right.count() // rrows + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = left.withColumn("_l", F.pmod(F.xxhash64(lkey), F.lit(nl)).cast("int")).withColumn("_r", each(nr))
    r = right.withColumn("_r", F.pmod(F.xxhash64(rkey), F.lit(nr)).cast("int")).withColumn("_l", each(nl))
    return l.groupBy("_l", "_r").cogroup(r.groupBy("_l", "_r")).applyInPandas(f, schema)


def nearest(faces: DataFrame, people: DataFrame, threshold: float = SAME_PERSON, sent_bytes: int = SENT) -> DataFrame:
    """Of each face (id, embedding) the person (id, embedding) with the largest cosine of at least the threshold, the last of equals; null if none.

    Every face meets every person as blocks of matrices: people are few. As many as sent_bytes hold are sent to all tasks at once; more are dealt to blocks among the workers, every block of faces meets every block of people, and
    each face keeps the best.
    """
    f = faces.select(F.col("id").cast("bigint").alias("face_id"), F.col("embedding").alias("fe"))
    p = people.filter("embedding is not null").select(F.col("id").cast("bigint").alias("person_id"), F.col("embedding").alias("pe"))
    size, n = p.agg(F.coalesce(F.sum(F.size("pe") * 8 + 16), F.lit(0)), F.count("*")).first()
    schema = "face_id bigint, person_id bigint, score double"
    if size <= sent_bytes:
        rows = p.orderBy("person_id").toArrow()
        sent = faces.sparkSession.sparkContext.broadcast(_people(rows.column(0).to_numpy(), _arrays(rows.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit, who, score = _best_of(_arrays(batch.column(1)), sent.value, threshold)
                yield pa.record_batch([batch.column(0).take(pa.array(hit)), pa.array(who), pa.array(score)], ["face_id", "person_id", "score"])

        best = f.mapInArrow(run, schema)
    else:

        def meet(some: pd.DataFrame, whom: pd.DataFrame) -> pd.DataFrame:
            hit, who, score = _best_of(some["fe"].tolist(), _people(whom["person_id"].to_numpy(), whom["pe"].tolist()), threshold)
            return pd.DataFrame({"face_id": some["face_id"].to_numpy()[hit], "person_id": who, "score": score})

        each = in_blocks(f, p, "face_id", "person_id", FACES_BLOCK, max(1, n * sent_bytes // size), meet, schema)
        best = each.groupBy("face_id").agg(F.max_by("person_id", F.struct("score", "person_id")).alias("person_id"), F.max("score").alias("score"))
    return f.select("face_id").join(best, "face_id", "left")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """a, b, score: every vector of left (id, embedding) with every one of right whose cosine is at least the threshold, compared in blocks."""
    l, r = left.select(F.col("id").cast("bigint").alias("a"), F.col("embedding").alias("x")), right.select(F.col("id").cast("bigint").alias("b"), F.col("embedding").alias("y"))
    usable = lambda df, c: df.filter(F.col(c).isNotNull())

    def meet(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})]
        xs, ys = some["x"].tolist(), others["y"].tolist()
        for d, at in _by_length(xs).items():
            for e, to in _by_length(ys).items():
                s = _cosines(_matrix(xs, at, d), _matrix(ys, to, e))
                i, j = np.nonzero(s >= threshold)
                out.append(pd.DataFrame({"a": some["a"].to_numpy()[np.array(at, int)[i]], "b": others["b"].to_numpy()[np.array(to, int)[j]], "score": s[i, j]}))
        return pd.concat(out)

    return in_blocks(usable(l, "x"), usable(r, "y"), "a", "b", 1 << 12, 1 << 12, meet, "a bigint, b bigint, score double")


def best_name(faces: DataFrame, named: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """face_id and the name of the nearest named face; empty if none is near."""
    near = nearest(faces, named.filter("coalesce(name, '') <> ''"), threshold)
    return near.join(named.select(F.col("id").alias("person_id"), "name"), "person_id", "left").select("face_id", F.coalesce("name", F.lit("")).alias("name"))


def faces_to_rename(faces: DataFrame, target_id: int, name: str, threshold: float = SAME_PERSON) -> DataFrame:
    """id and new name of the faces that a renaming reaches: all near the target; with a blank name the target alone."""
    name = name.strip()
    if not name:
        return faces.filter(F.col("id") == target_id).select("id", F.lit("").alias("name"))
    target = faces.filter(F.col("id") == target_id).select(F.col("embedding").alias("te"))
    return faces.join(F.broadcast(target)).filter((F.col("id") == target_id) | (cosine("embedding", "te") >= threshold)).select("id", F.lit(name).alias("name"))


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    x, y = np.asarray(a[:n], float), np.asarray(b[:n], float)
    d = (x @ x) * (y @ y)
    return float(x @ y / np.sqrt(d)) if d else 0.0


#: Faces of a photo that meet those kept so far at once.
SUBJECTS_BLOCK = 256


def _kept_subjects(vectors: list, threshold: float) -> list[int]:
    """Places of the faces, in the order given, that are not like an earlier one that is kept. Vectors of different lengths meet over their common length."""
    dims: dict[int, list[np.ndarray]] = {d: [] for d in sorted({len(v) for v in vectors})}  # of each length the kept vectors, as blocks
    kept: list[int] = []
    for begin in range(0, len(vectors), SUBJECTS_BLOCK):
        block = [np.asarray(v, float) for v in vectors[begin : begin + SUBJECTS_BLOCK]]
        by = _by_length(block)
        met = np.zeros(len(block), bool)
        for d, at in by.items():
            x = _matrix(block, at, d)
            for blocks in dims.values():
                for y in blocks:
                    met[at] |= (_cosines(x, y) >= threshold).any(1)
        free = np.flatnonzero(~met).tolist()
        fresh: list[int] = []
        near = np.zeros((len(free), len(free)), bool)
        for d, at in _by_length([block[i] for i in free]).items():
            for e, to in _by_length([block[i] for i in free]).items():
                near[np.ix_(at, to)] = _cosines(_matrix([block[i] for i in free], at, d), _matrix([block[i] for i in free], to, e)) >= threshold
        for i in range(len(free)):
            if not near[i, fresh].any():
                fresh.append(i)
        for d, at in _by_length([block[free[i]] for i in fresh]).items():
            dims[d].append(_matrix([block[free[i]] for i in fresh], at, d))
        kept += [begin + free[i] for i in fresh]
    return kept


def main_subjects(faces: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """Of each photo the faces by falling area, without those like a larger one that stays. Columns path, embedding, area, ord."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["embedding"].map(lambda e: e is not None and len(e) > 0)]
        rows = rows.assign(area=rows["area"].fillna(0)).sort_values(["area", "ord"], ascending=[False, True], kind="stable")
        return rows.iloc[_kept_subjects(rows["embedding"].tolist(), threshold)]

    return by_groups(faces.select("path", "embedding", "area", "ord"), ["path"], run, "path string, embedding array<float>, area double, ord bigint")


class _Cluster:
    def __init__(self, i: int, v: np.ndarray):
        self.members, self.sum, self.center = [i], v.astype(np.float64), v.astype(np.float32)

    def take(self, members: list[int], total: np.ndarray) -> None:
        self.members += members
        self.sum = self.sum + total
        self.recenter()

    def recenter(self) -> None:
        mean = self.sum / len(self.members)
        self.center = (mean / (np.sqrt((mean**2).sum()) or 1)).astype(np.float32)


def cluster(vectors: np.ndarray, large_at: int = 80, high: float = 0.5, low: float = SAME_PERSON, floor: float = 0.48) -> list[list[int]]:
    """Positions of each person's faces: leaders in order, then the best pair merged while one is near enough, then large clusters' far members clustered on their own.

    A cluster of large_at faces asks for `high`, a smaller one for `low`.
    """
    return _clustered(vectors, list(range(len(vectors))), large_at, high, low, floor)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)


#: Likenesses of faces and clusters that are held at once.
LIKENESSES = 1 << 20


def _merged(found: list[_Cluster], large_at: int, high: float, low: float) -> list[_Cluster]:
    """While a pair of clusters is near enough the best one, the first of equals, becomes one, in the first's place.

    Of each cluster only the best later one is kept, not the table of all pairs: what a merge changes is one cluster's likeness to the others, and the best of those whose best was one of the two.
    """
    n = len(found)
    if n < 2:
        return found
    c = _unit_rows(np.stack([x.center for x in found]))
    large, there = np.array([len(x.members) >= large_at for x in found]), np.ones(n, bool)
    best, whom = np.full(n, -2.0), np.zeros(n, np.int64)

    def look(rows: np.ndarray) -> None:
        for some in np.array_split(rows, len(rows) * n // LIKENESSES + 1):
            if len(some):
                start = int(some.min())
                s = c[some] @ c[start:].T
                s[~(there[start:] & (np.arange(start, n) > some[:, None])) | (s < np.where(large[some][:, None] | large[start:], high, low))] = -2
                whom[some] = start + s.argmax(1)
                best[some] = s[np.arange(len(some)), whom[some] - start]

    look(np.arange(n))
    while True:
        a = int(best.argmax())
        if best[a] <= -1:
            return [x for x, k in zip(found, there.tolist(), strict=True) if k]
        b = int(whom[a])
        found[a].take(found[b].members, found[b].sum)
        there[b], best[b] = False, -2
        c[a], large[a] = _unit_rows(found[a].center[None])[0], len(found[a].members) >= large_at
        s = c[:a] @ c[a]
        s[~there[:a] | (s < np.where(large[:a] | large[a], high, low))] = -2
        stale = (best > -2) & ((whom == a) | (whom == b))
        stale[a] = True
        closer = np.flatnonzero(~stale[:a] & ((s > best[:a]) | ((s == best[:a]) & (s > -2) & (a < whom[:a]))))
        best[closer], whom[closer] = s[closer], a
        look(np.flatnonzero(stale))


def _leaders(vectors: np.ndarray, faces: list[int], large_at: int, high: float, low: float) -> list[_Cluster]:
    """Each face in turn joins the nearest cluster of those near enough, the first of equals, or begins one. A block of faces meets all clusters as one product, of which only the columns of clusters that change are made anew."""
    found: list[_Cluster] = []
    centers, need = np.zeros((16, vectors.shape[1] if vectors.ndim == 2 else 0)), np.zeros(16)
    at = 0
    while at < len(faces):
        block = faces[at : at + max(8, min(256, LIKENESSES // (len(found) + 1)))]
        at += len(block)
        if len(centers) < len(found) + len(block):
            more = len(centers) + len(block)
            centers, need = np.concatenate((centers, np.zeros((more, centers.shape[1])))), np.concatenate((need, np.zeros(more)))
        units = _unit_rows(vectors[block])
        s = np.full((len(block), len(found) + len(block)), -2.0)
        near = units @ centers[: len(found)].T
        np.copyto(s[:, : len(found)], near, where=near >= need[: len(found)])
        for j, i in enumerate(block):
            k = int(s[j].argmax())
            if s[j, k] <= -1:
                k = len(found)
                found.append(_Cluster(i, vectors[i]))
            else:
                found[k].take([i], vectors[i].astype(np.float64))
            centers[k], need[k] = _unit_rows(found[k].center[None])[0], high if len(found[k].members) >= large_at else low
            new = units[j + 1 :] @ centers[k]
            s[j + 1 :, k] = np.where(new >= need[k], new, -2)
    return found


def _clustered(vectors: np.ndarray, faces: list[int], large_at: int, high: float, low: float, floor: float) -> list[list[int]]:
    found = _leaders(vectors, faces, large_at, high, low)
    found = _merged(found, large_at, high, low)
    if floor > 0:
        loose: list[int] = []
        for k in range(len(found) - 1, -1, -1):
            x = found[k]
            if len(x.members) < 8:
                continue
            near = [_cos(vectors[i], x.center) >= floor for i in x.members]
            if all(near):
                continue
            loose += [i for i, ok in zip(x.members, near, strict=True) if not ok]
            x.members = [i for i, ok in zip(x.members, near, strict=True) if ok]
            if not x.members:
                del found[k]
                continue
            x.sum = vectors[x.members].astype(np.float64).sum(0)
            x.recenter()
        if loose:
            return [x.members for x in found] + _clustered(vectors, loose, large_at, max(high, floor), floor, 0)
    return [x.members for x in found]


def rebuild(faces: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """People found anew from all faces in order of id: faces with person_id, and people with the name most of their faces have (the first to
    reach that number of equals) and the unit vector of their mean as exemplar."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        groups = cluster(np.stack(rows["embedding"].map(lambda e: np.asarray(e, np.float32))), **options)
        person = np.zeros(len(rows), np.int64)
        for k, g in enumerate(groups, 1):
            person[g] = k
        return rows.assign(person_id=person)

    base = faces.select("id", "path", "embedding", "name")
    out = base.filter("size(embedding) > 0").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda r: run(r.drop(columns="_all")), "id bigint, path string, embedding array<float>, name string, person_id bigint")
    w = Window.partitionBy("person_id", "name").orderBy("id")
    nth = out.filter("coalesce(name, '') <> ''").withColumn("_n", F.row_number().over(w))
    # of the names with the largest count, the one whose last face comes first
    name = nth.groupBy("person_id").agg(F.max_by("name", F.struct("_n", -F.col("id"))).alias("name"))
    parts = out.select("person_id", F.posexplode("embedding").alias("i", "x")).groupBy("person_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    people = mean.join(name, "person_id", "left").select(F.col("person_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), unit("mean").cast("array<float>").alias("exemplar"))
    return out, people


def attach_loose(faces: DataFrame, people: DataFrame, threshold: float = SAME_PERSON, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces without a person, in the order of id or of the given columns, get the nearest one, with their name, or become a new person whom later faces may be near; faces and people with the new ones.

    Who is new depends on all faces before, so the loose faces, and they alone, are folded in one task.
    """
    known = people.filter("exemplar is not null").select("id", F.col("exemplar").alias("embedding"))
    loose = faces.filter("person_id = 0")
    near = nearest(loose, known, threshold).select(F.col("face_id").alias("id"), F.col("person_id").alias("_near"), F.col("score").alias("_score"))
    top = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]

    places = [f"_o{i}" for i in range(len(order or ["id"]))]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(places).reset_index(drop=True)
        leaders: list[tuple[int, np.ndarray]] = []
        who, fresh = [], []
        for e, person, score in zip(rows["embedding"], rows["_near"], rows["_score"], strict=True):
            person, score = (int(person), score) if score == score and score is not None else (0, threshold)
            for n, x in leaders:
                c = _cos(e, x)
                if c >= score:
                    person, score = n, c
            fresh.append(not person)
            if not person:
                person = top + len(leaders) + 1
                leaders.append((person, np.asarray(e, float)))
            who.append(person)
        return pd.DataFrame({"id": rows["id"], "_who": who, "_fresh": fresh, "_embedding": rows["embedding"]})

    folded = loose.select("id", "embedding", *(F.col(c).alias(p) for c, p in zip(order or ["id"], places, strict=True))).join(near, "id").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda r: fold(r.drop(columns="_all")), "id bigint, _who bigint, _fresh boolean, _embedding array<float>")
    joined = faces.join(folded, "id", "left")
    own = loose.select("id", F.coalesce("name", F.lit("")).alias("name"))
    new = folded.filter("_fresh").join(own, "id").select(F.col("_who").alias("id"), "name", F.col("_embedding").alias("exemplar"))
    everyone = people.select("id", "name", "exemplar").unionByName(new)
    named = everyone.select(F.col("id").alias("_who"), F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).alias("_name"))
    out = joined.join(named, "_who", "left")
    name = F.when(F.col("_who").isNotNull(), F.coalesce("_name", "name", F.lit(""))).otherwise(F.col("name"))
    return out.select(*(name.alias(c) if c == "name" else F.coalesce("_who", "person_id").alias(c) if c == "person_id" else F.col(c) for c in faces.columns)), everyone


def recognized_labels(items: DataFrame) -> DataFrame:
    """path, label from a recogniser's items (path, faces, labels): a face makes a person; where a person is, there is no landscape."""
    some = F.size("faces") > 0
    labels = F.when(some, F.array_union("labels", F.array(F.lit("person")))).otherwise(F.col("labels"))
    labels = F.when(F.array_contains(labels, "person"), F.array_except(labels, F.array(F.lit("landscape")))).otherwise(labels)
    return items.select("path", F.explode(F.array_distinct(labels)).alias("label")).filter(F.col("label").isin("person", "animal", "landscape"))


def shots(photos: DataFrame, m: Marks) -> DataFrame:
    """path, capture_ms, person_ids, body of every photo: who is seen, and whether anybody is."""
    ids = m.faces.filter("person_id > 0").groupBy("path").agg(F.sort_array(F.collect_set("person_id")).alias("person_ids"))
    body = m.labels.filter("label = 'person'").select("path", F.lit(True).alias("body")).distinct()
    return photos.filter("kind = 'photo'").select("path", "capture_ms").join(ids, "path", "left").join(body, "path", "left").select("path", "capture_ms", F.coalesce("person_ids", F.array().cast("array<bigint>")).alias("person_ids"), F.coalesce("body", F.lit(False)).alias("body"))


def within(left: DataFrame, right: DataFrame, lms: str, rms: str, window_ms: int) -> DataFrame:
    """Pairs of rows whose times are at most the window apart, through bins of the window's width: an equi-join."""
    width = max(1, window_ms)
    l = left.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(lms) - window_ms) / width), F.floor((F.col(lms) + window_ms) / width))))
    r = right.withColumn("_bin", F.floor(F.col(rms) / width))
    return l.join(r, "_bin").filter(F.abs(F.col(lms) - F.col(rms)) <= window_ms).drop("_bin")


#: A panel of time is as many windows wide. A panel with more faces is dealt to parts by person, so a task has about as many rows at once.
PANEL_WINDOWS, PANEL_ROWS = 8, 1 << 18
#: Pairs of a shot and a face around it that a task counts at once.
PAIRS_BLOCK = 1 << 20


def _in_panels(shots: DataFrame, faces: DataFrame, window_ms: int, f, schema: str, both_sides: bool = False) -> DataFrame:
    """f over the panels of time, each a table of shots (path, ms) and of faces (person_id, ms) that has every face in reach of its shots; with both_sides every shot in reach as well, `own` telling the panel's.

    Only rows travel, each to the panels that its window touches, mostly one; what f makes of a panel stays where it is made.
    """
    width = PANEL_WINDOWS * max(1, window_ms)
    panel = lambda ms: F.floor(ms / F.lit(width))
    reached = F.explode(F.sequence(panel(F.col("ms") - window_ms), panel(F.col("ms") + window_ms))).alias("_panel")
    points = faces.select("ms", "person_id", reached)
    crowded = points.groupBy("_panel").agg(F.count("*").alias("_n")).filter(F.col("_n") > PANEL_ROWS).select("_panel", F.ceil(F.col("_n") / PANEL_ROWS).cast("int").alias("_parts"))
    dealt = lambda df: df.join(F.broadcast(crowded), "_panel", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    asked = shots.select("ms", "path", reached if both_sides else panel(F.col("ms")).alias("_panel"))
    l = dealt(asked).select("_panel", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_parts", "ms", F.lit(None).cast("bigint").alias("person_id"), "path", (panel(F.col("ms")) == F.col("_panel")).alias("own"))
    r = dealt(points).select("_panel", F.pmod(F.xxhash64("person_id"), "_parts").cast("int").alias("_part"), "_parts", "ms", "person_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("own"))

    return by_cells(l.unionByName(r), ("_panel", "_part"), f, schema)


def _panel_sides(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    """Shots, and of the faces in the order of time the times, the persons as numbers, and who these are."""
    is_shot = pc.is_valid(rows.column("own"))
    faces = rows.filter(pc.invert(is_shot)).sort_by("ms")
    who = faces.column("person_id").combine_chunks().dictionary_encode("encode")
    return rows.filter(is_shot), faces.column("ms").to_numpy(), who.indices.to_numpy(zero_copy_only=False).astype(np.int64), who.dictionary


def _reach(times: np.ndarray, ms: np.ndarray, window_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the window around each time begins and ends among sorted times."""
    return np.searchsorted(ms, times - window_ms, "left"), np.searchsorted(ms, times + window_ms, "right")


def persons_within(shots: DataFrame, faces: DataFrame, window_ms: int) -> DataFrame:
    """path, person_id, n: how often each person of faces (person_id, ms) is seen at most the window away from the shots (path, ms) of a path.

    Pairs are counted panel by panel where they meet, once for each different time, and never travel; only if a path has several shots its counts are added up.
    """
    timed = shots.filter("ms is not null").select("path", "ms")

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, ms, who, names = _panel_sides(rows)
        asked = asked.sort_by("ms")
        paths = asked.column("path").combine_chunks()
        times, first, shots_at = np.unique(asked.column("ms").to_numpy(), return_index=True, return_counts=True)
        lo, hi = _reach(times, ms, window_ms)
        upto = np.concatenate(([0], np.cumsum(hi - lo)))
        a = 0
        while a < len(times):
            b = max(int(np.searchsorted(upto, upto[a] + PAIRS_BLOCK, "right")) - 1, a + 1)
            pairs = int(upto[b] - upto[a])
            if pairs:
                row = np.repeat(np.arange(b - a), hi[a:b] - lo[a:b])
                face = np.arange(pairs) - np.repeat(upto[a:b] - upto[a] - lo[a:b], hi[a:b] - lo[a:b])
                seen, own = np.unique(who[lo[a] : hi[b - 1]], return_inverse=True)
                key = row * len(seen) + own[face - lo[a]]
                if (b - a) * len(seen) <= 8 * pairs:
                    n = np.bincount(key)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                row, person = a + key // len(seen), seen[key % len(seen)]
                for c, d in _slices(shots_at[row]):
                    copies = shots_at[row[c:d]]
                    path = np.repeat(first[row[c:d]], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    yield pa.record_batch([paths.take(pa.array(path)), names.take(pa.array(np.repeat(person[c:d], copies))), pa.array(np.repeat(n[c:d], copies))], ["path", "person_id", "n"])
            a = b

    out = _in_panels(timed, faces.filter("ms is not null"), window_ms, run, "path string, person_id bigint, n bigint")
    if timed.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").first():
        out = out.groupBy("path", "person_id").agg(F.sum("n").alias("n"))
    return out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose sizes add up to about a block."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(int(np.searchsorted(upto, upto[a] + PAIRS_BLOCK, "right")) - 1, a + 1)
        yield a, b
        a = b


def _counts_around(asked: DataFrame, points: DataFrame, window_ms: int, *by: str) -> DataFrame:
    """Of each asked (by, t) how many points (by, ms, n) are at most the window away in time: (by, t, around).

    In bins of the window's width the window around t covers the whole of t's own bin, the end of the one before and the beginning of the one after: three look-ups in running counts within bins, whatever the number of points.
    """
    width = max(1, window_ms)
    own = F.floor(F.col("t") / width)
    looks = F.array(
        F.struct((own - 1).alias("_bin"), (F.col("t") - window_ms - 1).alias("ms"), F.lit("after").alias("look")),
        F.struct(own.alias("_bin"), F.col("t").alias("ms"), F.lit("all").alias("look")),
        F.struct((own + 1).alias("_bin"), (F.col("t") + window_ms).alias("ms"), F.lit("upto").alias("look")),
    )
    look = asked.select(*by, "t", F.explode(looks).alias("l")).select(*by, "t", "l.*", F.lit(0).cast("long").alias("n"))
    seen = points.select(*by, F.lit(None).cast("long").alias("t"), F.floor(F.col("ms") / width).alias("_bin"), "ms", F.lit(None).cast("string").alias("look"), F.col("n").cast("long").alias("n"))
    w = Window.partitionBy(*by, "_bin")
    both = look.unionByName(seen).withColumn("_upto", F.sum("n").over(w.orderBy("ms"))).withColumn("_all", F.sum("n").over(w)).filter("look is not null")
    part = F.when(F.col("look") == "upto", F.col("_upto")).when(F.col("look") == "all", F.col("_all")).otherwise(F.col("_all") - F.col("_upto"))
    return both.groupBy(*by, "t").agg(F.sum(part).alias("around"))


def counts_within(left: DataFrame, right: DataFrame, lms: str, rms: str, window_ms: int) -> DataFrame:
    """Columns of left + around: how many rows of right are at most the window away in time.

    Counted once for each different time of left and joined back by that time: no pair is made, so a burst of shots costs no more than its rows, and no row needs a number of its own.
    """
    points = right.filter(F.col(rms).isNotNull()).groupBy(F.col(rms).alias("ms")).agg(F.count("*").alias("n"))
    asked = left.filter(F.col(lms).isNotNull()).select(F.col(lms).alias("t")).distinct()
    found = _counts_around(asked, points, window_ms).select(F.col("t").alias("_t"), "around")
    return left.join(found, F.col(lms) == F.col("_t"), "left").withColumn("around", F.coalesce("around", F.lit(0).cast("long"))).drop("_t")


def _main_persons(times: np.ndarray, ms: np.ndarray, who: np.ndarray, window_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each time how many faces are around it, who more than half of them are (any number if nobody), and how many that one has.

    Running counts of each bit of the persons' numbers: the bits that most faces around have are those of whom most show.
    """
    lo, hi = _reach(times, ms, window_ms)
    total, most = hi - lo, np.zeros(len(times), np.int64)
    for bit in range(int(who.max(initial=0)).bit_length()):
        upto = np.concatenate(([0], np.cumsum(who >> bit & 1)))
        most |= (2 * (upto[hi] - upto[lo]) > total).astype(np.int64) << bit
    # places of each person's faces, one person behind the other
    order = np.argsort(who, kind="stable")
    place = who[order] * (len(ms) + 1) + order
    return total, most, np.searchsorted(place, most * (len(ms) + 1) + hi) - np.searchsorted(place, most * (len(ms) + 1) + lo)


def link_back_views(shots: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """path, person_id of shots with a body and no face that belong to whom the faces around them show.

    The most frequent person must be seen at least as often as there are faceless shots around, and be the only one, or seen twice or more and four times in five.

    Whoever is shown four times in five is shown by more than half of the faces, so one person is asked for at each time, in running counts inside panels of time: neither pairs of shots nor the people around a shot become rows.
    """
    timed = shots.filter("capture_ms is not null").withColumnRenamed("capture_ms", "ms")
    faces = timed.filter(F.size("person_ids") > 0).select("ms", F.explode(F.array_distinct("person_ids")).alias("person_id"))
    blank = timed.filter((F.size("person_ids") == 0) & F.col("body")).select("path", "ms")

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asked, ms, who, names = _panel_sides(rows)
        mine = asked.filter(asked.column("own"))
        if not len(ms) or not mine.num_rows:
            return
        times = mine.column("ms").to_numpy()
        total, most, top = _main_persons(times, ms, who, window_ms)
        lo, hi = _reach(times, np.sort(asked.column("ms").to_numpy()), window_ms)
        # where the panel is in parts, others may know more
        told = np.flatnonzero((total > 0) & ((rows.column("_parts")[0].as_py() > 1) | _surely(top, np.maximum(total, 1), hi - lo)))
        person = names.take(pa.array(np.minimum(most[told], len(names) - 1)))
        columns = [mine.column("path").combine_chunks().take(pa.array(told)), pa.array(times[told]), person, pa.array(top[told]), pa.array(total[told]), pa.array((hi - lo)[told])]
        yield pa.record_batch(columns, ["path", "ms", "person_id", "top", "total", "faceless"])

    parts = _in_panels(blank, faces, window_ms, run, "path string, ms bigint, person_id bigint, top bigint, total bigint, faceless bigint", both_sides=True)
    whole = parts.distinct().groupBy("path", "ms", "faceless").agg(F.max_by("person_id", "top").alias("person_id"), F.max("top").alias("top"), F.sum("total").alias("total"))
    return whole.filter(_surely(F.col("top"), F.col("total"), F.col("faceless"))).select("path", "person_id")


def _surely(top, total, faceless):
    """Whether a person shown so often among so many faces is whom the faceless shots show; columns or arrays."""
    return (top >= faceless) & ((top == total) | ((top >= 2) & (top / total >= 0.8)))


def relinked(shots_: DataFrame, m: Marks, window_ms: int = WINDOW_MS) -> DataFrame:
    """Appearances that a face supports, and those that shots from behind add."""
    own = m.appearances.join(m.faces.select("path", "person_id").distinct(), ["path", "person_id"], "left_semi")
    return own.select("path", "person_id").union(link_back_views(shots_, window_ms)).dropDuplicates(["path", "person_id"])


#: Characters of a person's name (a fixed value).
NAME_LENGTH = 40


def renamed_count(m: Marks, person_id: int) -> DataFrame:
    """One row: the person and how many faces a new name reaches; no row if there is no such person."""
    faces = m.faces.filter(F.col("person_id") == person_id).agg(F.count("*").alias("count"))
    return m.people.filter(F.col("id") == person_id).select(F.col("id").alias("person_id")).limit(1).crossJoin(faces)


def renamed_face(m: Marks, face_id: int, name: str) -> tuple[Marks, DataFrame]:
    """A new name for the person whose face it is, and the person with the number of faces that it reaches; nothing changes for a face that is not there or belongs to nobody."""
    owner = m.faces.filter((F.col("id") == face_id) & (F.col("person_id") > 0)).select("person_id").first()
    person = owner["person_id"] if owner else 0
    return renamed(m, person, name) if person else m, renamed_count(m, person)


def renamed(m: Marks, person_id: int, name: str) -> Marks:
    """A person's new name, trimmed and at most 40 characters, also on their faces."""
    name = name.strip()[:NAME_LENGTH]
    put = lambda df, c: df.withColumn("name", F.when(F.col(c) == person_id, F.lit(name)).otherwise(F.col("name")))
    return Marks(put(m.faces, "person_id"), m.labels, m.appearances, put(m.people, "id"))


def prepared(m: Marks, model: str | None, version: str | None) -> tuple[Marks, bool]:
    """Nothing of another face model, or of one that is not known, is kept; whether people must be found anew."""
    if model != FACE_MODEL:
        m = Marks(*(df.filter(F.lit(False)) for df in (m.faces, m.labels, m.appearances, m.people)))
    return m, model != FACE_MODEL or version != CLUSTER_VERSION


def recognized(items: DataFrame, known: DataFrame, threshold: float = SAME_PERSON) -> tuple[DataFrame, DataFrame]:
    """Faces (path, ord, embedding, person_id) and labels (path, label) from a recogniser's items: the main subjects of each photo, each with
    the nearest known person, 0 for nobody. Who is new is found by the next rebuild."""
    found = items.select("path", F.posexplode("faces").alias("ord", "f")).select("path", F.col("ord").cast("bigint").alias("ord"), F.col("f.embedding").alias("embedding"), F.col("f.area").alias("area"))
    main = main_subjects(found, threshold).withColumn("id", F.xxhash64("path", "ord"))
    near = nearest(main.select("id", "embedding"), known.filter("exemplar is not null").select("id", F.col("exemplar").alias("embedding")), threshold)
    faces = main.join(near.select(F.col("face_id").alias("id"), "person_id"), "id").select("path", "ord", "embedding", F.coalesce("person_id", F.lit(0)).alias("person_id"))
    return faces, recognized_labels(items)


def save_recognition(items: DataFrame, m: Marks, photos: DataFrame, threshold: float = SAME_PERSON) -> Marks:
    """Marks after a recogniser's items (seq, path, faces, labels) are saved in the order of seq: what a photo had before is replaced.

    Each main subject gets the nearest known person with their name, or becomes a new person without one, whom later faces may be near. A photo appears under the persons of its faces. People without a name, a face and an
    appearance go. New ids follow the largest one; ids of faces are hashes of path and place. An item without faces and labels empties its photo's marks.

    Who is new depends on the items before, so the items' faces, and they alone, are folded in one task.
    """
    found = items.select("seq", "path", F.posexplode("faces").alias("ord", "f")).select("seq", "path", F.col("ord").cast("bigint").alias("ord"), F.col("f.embedding").alias("embedding"), F.col("f.area").alias("area"))
    main = main_subjects(found, threshold).join(items.select("path", "seq"), "path")
    loose = main.select(F.xxhash64("path", "ord").alias("id"), "path", "embedding", F.lit("").alias("name"), F.lit(0).cast("bigint").alias("person_id"), "seq", "area", "ord")
    # within a photo the larger face comes first
    attached, everyone = attach_loose(loose.withColumn("_less", -F.col("area")), m.people, threshold, ["seq", "_less", "ord"])
    fresh = attached.select("id", "path", "embedding", "name", "person_id")
    untouched = lambda df: df.join(items.select("path"), "path", "left_anti").select(*df.columns)
    faces = untouched(m.faces).unionByName(fresh)
    labels = untouched(m.labels).unionByName(recognized_labels(items))
    appearances = untouched(m.appearances).unionByName(fresh.select("path", "person_id").distinct())
    saved = without_orphans(photos, Marks(faces, labels, appearances, everyone))
    return Marks(faces, labels, appearances, saved.people)
