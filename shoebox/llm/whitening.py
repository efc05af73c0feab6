"""Whitening of embeddings: principal components of the whole table, each scaled to variance one.

Every task folds its batches to a count, exact integer sums, a local mean and a centred scatter matrix; Chan's pairwise formula merges two of
these, first batch by batch inside a task and then in a tree over the tasks. The driver sees one such triple and takes its eigenvectors; its size depends on the
number of dimensions alone. A second pass over the table measures how far the covariance of the whitened vectors is from the identity.

Cases: vectors that are null, or hold null or non-finite entries, are dropped, and so are empty ones; of vectors of several lengths those of the most frequent length (of equally frequent ones the longer) are whitened and the
others dropped; repeated rows count as often as they stand there; a null id is kept; entries beyond 2^47 count as 2^47; a direction without variance has no scale, so its values are null; deviations that no long holds are
null; an empty table gives an empty one. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Steps of one unit of an entry, what is added to each, and the largest entry that counts.
STEPS, SHIFT, LARGEST = 64, 1_000_000, 2.0**47
#: Eigenvalues below this share of the largest are rounding, not variance.
FLAT = 1e-13


@dataclass
class Moments:
    """Of a list of vectors: how many, their exact sums (Python integers), their mean and their centred scatter."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(0, dtype=np.float64)
        away = x - mean
        sums = [int(s) for s in x.sum(0)] if x.dtype.kind == "i" else []
        # the mean is rounded, so what is left of the centred rows is taken off again
        rest = away.mean(0)
        return Moments(len(x), sums, mean + rest, away.T @ away - len(x) * np.outer(rest, rest))

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, with the distance of the two means on top."""
        n = self.n + other.n
        away = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + away * (other.n / n), scatter)


@dataclass(frozen=True)
class Whitener:
    """The table's moments in the integer steps of vectors, and the components by falling eigenvalue, one in each column of axes."""

    moments: Moments
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.moments.mean)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the numerator n*x - S is formed in integers where they hold it."""
        n, top = self.moments.n, max((abs(s) for s in self.moments.sums), default=0)
        if n * (int(np.abs(x).max(initial=0)) + 1) + top < 2**63:
            return (x * n - np.array(self.moments.sums, np.int64)) / n
        whole = np.array([s // n for s in self.moments.sums], np.int64)
        return (x - whole) - np.array([s % n / n for s in self.moments.sums])

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened values of each row; NaN along a component without variance."""
        e = self.values[:k]
        flat = e <= FLAT * max(self.values.max(initial=0), 0)
        return self.centred(x) @ self.axes[:, :k] / np.where(flat, np.nan, np.sqrt(np.where(flat, 1, e)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The exact sums over dimensions of (n*x - S)^2; -1 where no long holds one."""
        n, sums = self.moments.n, self.moments.sums
        reach = max((max(abs(n * int(x[:, j].max()) - s), abs(n * int(x[:, j].min()) - s)) for j, s in enumerate(sums)), default=0) if len(x) else 0
        if n * int(np.abs(x).max(initial=0)) < 2**62 and reach * reach * max(len(sums), 1) < 2**63:
            away = x * n - np.array(sums, np.int64)
            return (away * away).sum(1)
        exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
        return np.array([d if d < 2**63 else -1 for d in exact], np.int64)


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vectors can be whitened, but for their lengths."""
    off = F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(~off)


def _steps(column: pa.Array, dims: int) -> np.ndarray:
    values = pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(np.clip(values * STEPS, -LARGEST, LARGEST)).astype(np.int64).reshape(-1, dims) + SHIFT


def _folded(rows: DataFrame, measure) -> Moments:
    """The moments of all rows, which must not be none, of what measure makes of a batch's vectors: folded in each task, merged in a tree."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                part = Moments.of(measure(batch.column(0)))
                own = part if own is None else own.merge(part)
        if own is not None:
            d = len(own.mean)
            yield pa.record_batch(
                [pa.array([own.n], pa.int64()), pa.array([[str(s) for s in own.sums]], pa.list_(pa.string())), pa.array([own.mean.tobytes()]), pa.array([own.scatter.reshape(d * d).tobytes()])], ["n", "sums", "mean", "scatter"]
            )

    def decoded(r) -> Moments:
        mean = np.frombuffer(bytes(r["mean"]))
        return Moments(r["n"], [int(s) for s in r["sums"]], mean, np.frombuffer(bytes(r["scatter"])).reshape(len(mean), -1))

    return rows.mapInArrow(fold, "n long, sums array<string>, mean binary, scatter binary").rdd.map(decoded).treeReduce(Moments.merge)


def fit(vectors: DataFrame, column: str = "embedding") -> tuple[Whitener | None, DataFrame]:
    """The whitening of all vectors, and the rows that have one."""
    rows = usable(vectors, column)
    lengths = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None, rows.limit(0)
    dims = lengths["d"]
    rows = rows.filter(F.size(column) == dims)
    moments = _folded(rows.select(column), partial(_steps, dims=dims))
    covariance = moments.scatter / moments.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    return Whitener(moments, np.maximum(values[::-1], 0), axes[:, ::-1].copy(), float(np.trace(covariance))), rows


def identity_error(rows: DataFrame, w: Whitener, k: int, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the first k whitened values minus the identity, over all rows; components without variance are left out."""
    rich = np.flatnonzero(w.values[:k] > FLAT * w.values.max(initial=0))
    if not len(rich):
        return 0.0
    m = _folded(rows.select(column), lambda c: w.project(_steps(c, w.dims), k)[:, rich])
    return float(np.abs(m.scatter / m.n - np.eye(len(rich))).max())


def whitened(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector: its id, n, deviation, the first k whitened values, the share of the variance that each component explains, and identity_error."""
    C.tune(vectors.sparkSession)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    w, rows = fit(own)
    if w is None:
        return own.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])))
    k = min(k, w.dims)
    error = identity_error(rows, w, k)
    share = (w.values[:k] / w.trace).tolist() if w.trace else [0.0] * k

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _steps(batch.column(1), w.dims)
            flat = w.project(x, k).reshape(-1)
            deviation = w.deviations(x)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, m * k + 1, k), pa.int32()), v)
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(np.full(m, w.moments.n)), pa.array(deviation, mask=deviation < 0), lists(pa.array(flat, mask=np.isnan(flat))), lists(pa.array(np.tile(share, m))), pa.array(np.full(m, error)),
                ],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "embedding").mapInArrow(apply, schema)


def by_component(rows: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1, of what whitened() returns."""
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
