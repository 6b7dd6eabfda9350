"""Distance metrics between vectors, twice: as Column expressions over array
columns, and as block kernels over NumPy matrices for searches.

Elements are taken as doubles. A zero vector has cosine distance 1 to everything.
``dot`` is the product itself, so larger is nearer; the others are distances.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKS = 32


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(_double(x), _double(y), lambda a, b: a * b))


def l2_squared(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(_double(x), _double(y), lambda a, b: (a - b) * (a - b)))


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(l2_squared(x, y))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(_double(x), _double(y), lambda a, b: F.abs(a - b)))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(x), lambda a: a * a)))


def cosine(x: Column, y: Column) -> Column:
    """1 - cosine similarity; 1 where either vector is zero."""
    return 1 - F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))


def cosine_chunked(x: Column, y: Column, dimensions: int) -> Column:
    """The sum of the cosine distances of successive chunks, a metric of its own."""
    width = chunk_width(dimensions)
    starts = F.array(*[F.lit(i) for i in range(1, dimensions + 1, width)])
    return _sum(F.transform(starts, lambda i: cosine(F.slice(x, i, width), F.slice(y, i, width))))


def chunk_width(dimensions: int) -> int:
    """One chunk up to 32 dimensions, else 32 equal chunks."""
    if dimensions <= CHUNKS:
        return dimensions
    if dimensions % CHUNKS:
        raise ValueError(f"chunked cosine needs a multiple of {CHUNKS} dimensions, not {dimensions}")
    return dimensions // CHUNKS


def normalize(x: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(x)
    return F.transform(_double(x), lambda a: a / F.when(n == 0, F.lit(1.0)).otherwise(n))


def part(x: Column, start: int, length: int) -> Column:
    """``length`` elements from the 0-based ``start``."""
    return F.slice(x, start + 1, length)


_COLUMNS: dict[str, Callable[..., Column]] = {"l2": l2, "l2_squared": l2_squared, "manhattan": manhattan, "dot": dot, "cosine": cosine}
METRICS = (*_COLUMNS, "cosine_chunked")


def _known(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return metric


def column(metric: str, x: Column, y: Column, dimensions: int | None = None) -> Column:
    """The metric by name as a Column; chunked cosine needs the dimensions."""
    if _known(metric) == "cosine_chunked":
        if dimensions is None:
            raise ValueError("cosine_chunked needs the number of dimensions")
        return cosine_chunked(x, y, dimensions)
    return _COLUMNS[metric](x, y)


def nearest_first(metric: str) -> bool:
    """Whether smaller values are nearer."""
    return _known(metric) != "dot"


# ---- block kernels: rows x queries ----

#: Differences that a kernel holds at once.
_GAPS = 1 << 20


def _block_cosine(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    scale = np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1))
    product = rows @ queries.T
    return 1 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)


def block(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of every row (n x D) to every query (m x D), as n x m doubles.

    L2 is taken from differences, not from expanded squares, so that small
    distances keep their digits.
    """
    _known(metric)
    rows, queries = rows.astype(np.float64, copy=False), queries.astype(np.float64, copy=False)
    if metric == "dot":
        return rows @ queries.T
    if metric == "cosine":
        return _block_cosine(rows, queries)
    if metric == "cosine_chunked":
        width = chunk_width(rows.shape[1])
        return sum(_block_cosine(rows[:, i : i + width], queries[:, i : i + width]) for i in range(0, rows.shape[1], width))
    out = np.empty((len(rows), len(queries)))
    step = max(1, _GAPS // max(1, rows.size))
    for j in range(0, len(queries), step):
        gaps = rows[:, None, :] - queries[None, j : j + step, :]
        out[:, j : j + step] = np.abs(gaps).sum(axis=2) if metric == "manhattan" else np.einsum("ijk,ijk->ij", gaps, gaps)
    return np.sqrt(out) if metric == "l2" else out


def pairs(metric: str, rows: np.ndarray, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """L2 distances, squared or not, of the rows ``i`` to the queries ``j`` beside them."""
    out = np.empty(len(i))
    step = max(1, _GAPS // max(1, rows.shape[1]))
    for at in range(0, len(i), step):
        gaps = rows[i[at : at + step]] - queries[j[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", gaps, gaps)
    return np.sqrt(out) if metric == "l2" else out


def l2_bounds(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared L2 distances from products, and by how much each may be off."""
    a, b = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", queries, queries)
    total = a[:, None] + b
    return total - 2 * (rows @ queries.T), total * (8 * (rows.shape[1] + 2) * np.finfo(float).eps)
