"""Lloyd's K-means over a table of vectors.

An iteration is one job with one shuffle: tasks assign their rows and return one
partial sum, an array, for each cluster they have; a cluster's are added in the task
they meet in, and K means, one row each, reach the driver. It ships the new
centroids. The start is deterministic: the rows with the smallest
MD5 of their id. A cluster that gets no row takes the next row in that order, as
long as there is one. The loop stops before replacing the centroids once no
centroid moves more than ``tol`` (L2, for either metric), so the assignments
returned always belong to centroids that were used; when iterations run out, the
centroids are one update newer than the assignments.

Defined results: rows without a vector, or with a NaN or null element, belong to
no cluster and are left out everywhere; vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.sources.vectors import list_array, matrix

METRICS = ("l2", "cosine")


def clusterable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows with a vector of numbers."""
    numbers = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v))
    return vectors.where(F.col(vector_col).isNotNull() & numbers)


def start_rows(vectors: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """``(cid, id, embedding...)`` of the first k rows by MD5 of the id, then id."""
    few = vectors.withColumn("__key", F.md5(F.col(id_col).cast("string"))).orderBy("__key", id_col).limit(k)
    order = Window.orderBy("__key", id_col)
    return few.withColumn("cid", (F.row_number().over(order) - 1).cast("int")).drop("__key")


def nearest_centroid(rows: np.ndarray, centroids: np.ndarray, metric: str, digits: int | None = None) -> np.ndarray:
    """Position of each row's nearest centroid; ties go to the first. With ``digits``,
    distances (squared ones for l2) that are equal when rounded to so many are ties."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    product = rows @ centroids.T
    if metric == "l2":  # the row's own square changes no order
        value = (centroids**2).sum(axis=1) - 2 * product
    else:
        scale = np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(centroids, axis=1))
        value = 1 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    found = np.argmin(value, axis=1)
    if digits is not None and len(rows):
        least = value[np.arange(len(rows)), found]
        slack = 10.0**-digits + 1e-12 * (np.abs(value).max(axis=1) + (rows**2).sum(axis=1))
        for i in np.flatnonzero((value <= (least + slack)[:, None]).sum(axis=1) > 1):
            exact = ((centroids - rows[i]) ** 2).sum(axis=1) if metric == "l2" else value[i]
            found[i] = np.argmin(np.round(exact, digits))
    return found


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """``(id, cid)`` of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest_centroid(matrix(batch.column(1)), shared.value, metric, digits) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=[id_col, "cid"])

    some = clusterable(vectors, vector_col).select(id_col, vector_col)
    return some.mapInArrow(run, some.select(id_col).schema.add("cid", T.IntegerType()))


def update(assigned: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``(cid, mean, n)``: the mean vector and size of each cluster of
    ``assigned(cid, embedding)``, from per-task partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            total.add(batch.column(0).to_numpy(), matrix(batch.column(1)))
        yield from total.batches()

    some = clusterable(assigned, vector_col).where("cid is not null").select(F.col("cid").cast("int"), vector_col)
    return _means(some.mapInArrow(run, _SUMS))


_SUMS = "cid int, sums array<double>, n long"


class _Sums:
    """Sums and sizes of clusters."""

    def __init__(self) -> None:
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}

    def add(self, cids: np.ndarray, rows: np.ndarray, sizes: np.ndarray | None = None) -> None:
        """Rows of clusters; ``sizes`` if each is the sum of so many."""
        if not len(cids):
            return
        order = np.argsort(cids, kind="stable")
        own, first = np.unique(cids[order], return_index=True)
        counts = np.add.reduceat(np.ones(len(cids), np.int64) if sizes is None else sizes[order], first)
        for c, n, total in zip(own.tolist(), counts.tolist(), np.add.reduceat(rows[order], first)):
            self.sums[c] = self.sums[c] + total if c in self.sums else total
            self.counts[c] = self.counts.get(c, 0) + n

    def batches(self) -> Iterator[pa.RecordBatch]:
        if keys := sorted(self.sums):
            columns = [pa.array(keys, pa.int32()), list_array(np.array([self.sums[c] for c in keys])), pa.array([self.counts[c] for c in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "sums", "n"])


def _means(parts: DataFrame) -> DataFrame:
    """Partial sums to means: a cluster's meet in one task, which adds them as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                total.add(some.column(0).to_numpy(), matrix(some.column(1)), some.column(2).to_numpy())
        yield from total.batches()

    whole = parts.repartition("cid").mapInArrow(run, _SUMS)
    return whole.select("cid", F.transform("sums", lambda v: v / F.col("n")).alias("mean"), "n")


def repair(assigned_rows: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """``(cid, id)``: the row that each of the k clusters without a row takes, next
    in the MD5 order after the first k."""
    held = {r["cid"] for r in assigned_rows.select("cid").distinct().collect()}
    empty = [c for c in range(k) if c not in held]
    order = start_rows(vectors.select(id_col), k + len(empty), id_col)
    takes = F.create_map(*[F.lit(x) for j, c in enumerate(empty) for x in (k + j, c)]) if empty else F.create_map(F.lit(-1), F.lit(-1))
    return order.where(F.col("cid") >= k).select(takes[F.col("cid")].alias("cid"), id_col)


def shift(old: np.ndarray, new: np.ndarray) -> float:
    """The largest L2 move of a centroid."""
    return float(np.sqrt(((old - new) ** 2).sum(axis=1)).max(initial=0.0))


class _Order:
    """The vectors in the order of their ids' MD5, fetched as far as they are asked for."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str):
        self.vectors, self.id_col, self.vector_col = vectors, id_col, vector_col
        self.rows: list[list[float]] = []
        self.ended = False

    def row(self, i: int) -> list[float] | None:
        while i >= len(self.rows) and not self.ended:
            asked = max(16, 2 * (i + 1))
            found = start_rows(self.vectors, asked, self.id_col).orderBy("cid").select(self.vector_col).collect()
            self.rows, self.ended = [list(r[0]) for r in found], len(found) < asked
        return self.rows[i] if i < len(self.rows) else None


@dataclass
class KMeans:
    centroids: np.ndarray
    assignments: DataFrame
    iterations: int
    sizes: dict[int, int]


def fit(vectors: DataFrame, k: int, max_iters: int = 100, tol: float = 1e-4, metric: str = "l2", start: np.ndarray | None = None, id_col: str = "vec_id", vector_col: str = "embedding", reseed: bool = True, digits: int | None = None) -> KMeans:
    """Clusters of ``vectors``; ``start`` replaces the deterministic first centroids.
    Without ``reseed`` a cluster that gets no row stays where it is."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    vectors = clusterable(vectors, vector_col)
    order = _Order(vectors, id_col, vector_col)
    if start is None:
        centroids, used_rows = np.array([order.row(i) for i in range(k) if order.row(i) is not None], float), k
    else:
        centroids, used_rows = np.array(start, float), 0
    if not len(centroids):
        raise ValueError("no vectors to cluster")
    used, sizes, done = centroids, {}, 0
    for done in range(1, max_iters + 1):
        used = centroids
        means = _means(_assigned_sums(vectors, used, metric, vector_col, digits)).toArrow().combine_chunks()
        new, sizes = np.full_like(used, np.nan), {}
        if means.num_rows:
            cids = means.column("cid").to_numpy()
            new[cids] = matrix(means.column("mean").combine_chunks())
            sizes = dict(zip(cids.tolist(), means.column("n").to_pylist()))
        for c in np.flatnonzero(np.isnan(new).any(axis=1)):
            row = order.row(used_rows) if reseed else None
            used_rows += 1
            new[c] = used[c] if row is None else row
        if shift(used, new) <= tol:
            break
        centroids = new
    return KMeans(centroids, assign(vectors, used, metric, id_col, vector_col, digits), done, sizes)


def _assigned_sums(vectors: DataFrame, centroids: np.ndarray, metric: str, vector_col: str, digits: int | None = None) -> DataFrame:
    """Partial sums of the clusters that the vectors are nearest to."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0))
                total.add(nearest_centroid(rows, shared.value, metric, digits), rows)
        yield from total.batches()

    return vectors.select(vector_col).mapInArrow(run, _SUMS)


def assigned(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", vector_col: str = "embedding") -> DataFrame:
    """``(cid, embedding)`` of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest_centroid(matrix(batch.column(0)), shared.value, metric) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column(0)], names=["cid", vector_col])

    some = clusterable(vectors, vector_col).select(vector_col)
    return some.mapInArrow(run, T.StructType([T.StructField("cid", T.IntegerType()), *some.schema]))
