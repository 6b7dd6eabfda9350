"""Exact k nearest neighbours, for one query vector or a table of queries.

A search is one pass over the vectors: each task scores its blocks of rows
against the queries in NumPy and keeps k rows per query, so what is shuffled is
k rows per query and task, whatever the number of vectors. Queries are sent to
the executors in blocks of at most ``query_bytes``; a larger query table makes
further passes. Distances are rounded to ``digits`` (if given) before ranking,
and ties go to the smaller id; ``k`` beyond the rows gives all rows.

Defined results: rows without an id or a vector are left out; a distance that is
NaN, from a NaN or null element, ranks after all numbers; a null query vector, a
query without k, and vectors of different lengths are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import distances
from vectide.operators.topk import top_k_per_group
from vectide.sources.vectors import matrix

ROW_BYTES = 32 << 20
#: So many queries are taken in one job, if they fit in a block; others are counted first.
FEW = 1024


def _ascending(metric: str, order: str | None) -> bool:
    if order not in (None, "asc", "desc"):
        raise ValueError(f"unknown order {order!r}")
    return distances.nearest_first(metric) if order is None else order == "asc"


def scores(metric: str, rows: np.ndarray, queries: np.ndarray, digits: int | None) -> np.ndarray:
    found = distances.block(metric, rows, queries)
    return found if digits is None else np.round(found, digits) + 0.0


class Nearest:
    """The k best rows so far of each of a block of queries.

    Rows are offered in blocks. What can't be among a query's best, by the k-th of
    those kept or of the block, is dropped by one comparison of matrices; the rest
    is held and now and then sorted, all queries at once. NaN comes last.
    """

    def __init__(self, metric: str, points: np.ndarray, ks: np.ndarray, ascending: bool, digits: int | None):
        self.metric, self.points, self.ks, self.digits = metric, points, ks, digits
        self.sign = 1.0 if ascending else -1.0
        self.most = int(ks.max(initial=0))
        self.bar = np.full(len(ks), np.nan)  # the k-th best, by sign; NaN while there are fewer numbers
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, id, keyed value
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.limit = max(1 << 20, 4 * int(ks.sum()))

    def offer(self, ids: np.ndarray, rows: np.ndarray, some: np.ndarray | None = None) -> None:
        """Rows for all queries, or for ``some`` of them (positions)."""
        if self.most < 1 or not len(rows):
            return
        points, bar = (self.points, self.bar) if some is None else (self.points[some], self.bar[some])
        refined = self.metric in ("l2", "l2_squared") and self.sign > 0
        if refined:
            values, off = distances.l2_bounds(rows, points)
            low, high = values - off, values + off
        else:
            low = high = self.sign * scores(self.metric, rows, points, self.digits)
        edge = self._squared(bar) if refined else bar
        if len(rows) >= self.most and np.isnan(bar).any():
            best = np.partition(high, self.most - 1, axis=0)[self.most - 1]
            edge = np.fmin(edge, self._squared(self._unsquared(best)) if refined else best)
        i, j = np.nonzero((low <= edge) | np.isnan(edge))
        if refined:
            kept = distances.pairs(self.metric, rows, points, i, j)
            kept = kept if self.digits is None else np.round(kept, self.digits) + 0.0
        else:
            kept = low[i, j]
        self.waiting.append((j if some is None else some[j], ids[i], kept))
        self.size += len(i)
        if self.size > self.limit or self.size >= self.ks.sum() and np.isnan(self.bar).any():
            self._trim()

    def _unsquared(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(x, 0)) if self.metric == "l2" else x

    def _squared(self, bar: np.ndarray) -> np.ndarray:
        """A bound on squares under which lies whatever rounds to the bar or less."""
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        bar = (bar + slack) * (1 + 1e-12)
        return bar * bar if self.metric == "l2" else bar

    def _trim(self) -> None:
        query, ids, keyed = (np.concatenate([h, *[w[c] for w in self.waiting]]) for c, h in enumerate(self.held))
        order = np.lexsort((ids, keyed, query))
        query, ids, keyed = query[order], ids[order], keyed[order]
        first = np.searchsorted(query, np.arange(len(self.ks)))
        rank = np.arange(len(query)) - first[query]
        full = rank == self.ks[query] - 1
        self.bar[query[full]] = keyed[full]
        kept = rank < self.ks[query]
        self.held = [query[kept], ids[kept], keyed[kept]]
        self.waiting, self.size = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, distance) of what is kept."""
        self._trim()
        query, ids, keyed = self.held
        return query, ids, self.sign * keyed + 0.0

    def batches(self, qids: np.ndarray, id_col: str) -> Iterator[pa.RecordBatch]:
        query, ids, values = self.result()
        for at in range(0, len(query), 100_000):
            q = query[at : at + 100_000]
            columns = [qids[q], ids[at : at + 100_000], values[at : at + 100_000], self.ks[q].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", id_col, "dist", "k"])


def _query_blocks(queries: DataFrame, query_bytes: int, more: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, vectors, k, further columns) of the queries, in blocks of bounded size:
    by their vectors, the rows that are kept for them and the ``more`` bytes of the
    further columns of a query."""
    row_bytes = lambda d, k: 8 * (d or 0) + 24 * (k or 0) + 16 + more
    few = queries.limit(FEW + 1).toArrow()
    if few.num_rows <= FEW and few.num_rows * row_bytes(pc.max(pc.list_value_length(few.column(1))).as_py(), pc.max(few.column(2)).as_py()) <= query_bytes:
        if few.num_rows:
            yield _query_block(few)
        return
    queries = queries.persist()  # read more than once; what is lost is computed again
    try:
        size = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d"), F.max("k").alias("k")).first()
        count = max(1, -(-size["n"] * row_bytes(size["d"], size["k"]) // query_bytes))
        for block in range(count):
            rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == block).toArrow()
            if rows.num_rows:
                yield _query_block(rows)
    finally:
        queries.unpersist()


def _query_block(rows: pa.Table) -> tuple[np.ndarray, ...]:
    table = rows.sort_by("qid").combine_chunks().to_batches()[0]
    if table.column(2).null_count:
        raise ValueError("a query needs k")
    return table.column(0).to_numpy(), matrix(table.column(1)), table.column(2).to_numpy(), *(c.to_pylist() for c in table.columns[3:])


def _with_vectors(vectors: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    held = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    return held.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col), *others)


def search(vectors: DataFrame, queries: DataFrame, metric: str = "l2", k: int | None = None, order: str | None = None, digits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = 64 << 20) -> DataFrame:
    """``(qid, rank, id, dist)`` of the nearest rows of ``vectors`` to each row of
    ``queries(qid, q[, k])``; without an own k a query has the one given."""
    ascending = _ascending(metric, order)
    own_k = F.coalesce(F.col("k"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    plain = queries.select(F.col("qid").cast("long"), F.col("q").cast("array<double>"), own_k.cast("int").alias("k"))
    spark = vectors.sparkSession
    base = _with_vectors(vectors, id_col, vector_col)
    out = None
    for block in _query_blocks(plain, query_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, points, ks = shared.value
            best = Nearest(metric, points, ks, ascending, digits)
            step = max(1, ROW_BYTES // (8 * max(points.shape[1], len(qids))))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    best.offer(part.column(0).to_numpy(), matrix(part.column(1)))
            yield from best.batches(qids, id_col)

        part = base.mapInArrow(run, f"qid long, `{id_col}` long, dist double, k int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid long, `{id_col}` long, dist double, k int")
    ranked = top_k_per_group(out, "qid", "dist", id_col, F.col("k"), "asc" if ascending else "desc")
    return ranked.select("qid", "rank", id_col, "dist")


def nearest(vectors: DataFrame, query, k: int, metric: str = "l2", order: str | None = None, digits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(rank, id, dist)`` for one query vector."""
    one = vectors.sparkSession.createDataFrame([(0, [float(v) for v in query])], "qid long, q array<double>")
    return search(vectors, one, metric, k, order, digits, id_col, vector_col).drop("qid")


def distances_to(vectors: DataFrame, queries: DataFrame, metric: str, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = 64 << 20) -> DataFrame:
    """Every distance, ``(qid, id, dist)``: a stated query set against all rows, the
    set in blocks of bounded size as in ``search``."""
    distances.nearest_first(metric)
    plain = queries.select(F.col("qid").cast("long"), F.col("q").cast("array<double>"), F.lit(0).alias("k"))
    spark = vectors.sparkSession
    base = _with_vectors(vectors, id_col, vector_col)
    schema = f"qid long, `{id_col}` long, dist double"
    out = None
    for block in _query_blocks(plain, query_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, points, _ = shared.value
            step = max(1, ROW_BYTES // (8 * max(points.shape[1], len(qids))))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    found = distances.block(metric, matrix(part.column(1)), points)
                    ids = np.repeat(part.column(0).to_numpy(), len(qids))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, part.num_rows)), pa.array(ids), pa.array(found.ravel())], names=["qid", id_col, "dist"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
