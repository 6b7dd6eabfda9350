"""Approximate nearest neighbours over clusters (an inverted file, flat inside).

An index is the vectors with their cluster ``cid`` and a table of centroids. A
search takes the ``probes`` nearest centroids of each query, keeps the vectors
of those clusters (a semi join; on an index written by ``write_index`` the
cluster filter prunes whole directories) and searches them exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions import distances
from vectide.operators import kmeans, knn
from vectide.operators.topk import top_k_per_group
from vectide.sources.vectors import matrix

Search = Callable[..., DataFrame]
#: Clusters that a filter lists; beyond, rows of clusters not probed are skipped as read.
MOST_LISTED = 10_000


@dataclass
class Index:
    vectors: DataFrame  # id, embedding, cid
    centroids: DataFrame  # cid, centroid


def default_clusters(n: int) -> int:
    return max(1, round(n**0.5))


def from_assignments(vectors: DataFrame, cid_col: str, vector_col: str = "embedding") -> Index:
    """Index of vectors whose clusters are known; centroids are the means."""
    own = vectors.withColumn("cid", F.col(cid_col).cast("int"))
    return Index(own, kmeans.update(own, vector_col).select("cid", F.col("mean").alias("centroid")))


def build(vectors: DataFrame, clusters: int | None = None, fit: Callable[..., kmeans.KMeans] = kmeans.fit, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> Index:
    """Index with ``clusters`` (by default about the root of the row count) from ``fit``."""
    model = fit(vectors, clusters or default_clusters(vectors.count()), id_col=id_col, vector_col=vector_col, **options)
    rows = [(c, [float(v) for v in x]) for c, x in enumerate(model.centroids)]
    centroids = vectors.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")
    return Index(vectors.join(model.assignments, id_col), centroids)


def write_index(index: Index, path: str) -> Index:
    """The index as Parquet, vectors partitioned by cluster."""
    spark = index.vectors.sparkSession
    index.vectors.write.partitionBy("cid").parquet(f"{path}/vectors")
    index.centroids.write.parquet(f"{path}/centroids")
    return Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids"))


def probe(index: Index, queries: DataFrame, probes: int, metric: str = "l2", digits: int | None = None, search: Search = knn.search) -> DataFrame:
    """``(qid, rank, cid, dist)``: the nearest centroids of each query."""
    return search(index.centroids, queries.drop("k"), metric, probes, digits=digits, id_col="cid", vector_col="centroid").withColumn("cid", F.col("cid").cast("int"))


def candidates(index: Index, probed: DataFrame) -> DataFrame:
    """The vectors of the probed clusters of one query."""
    return index.vectors.join(probed.select("cid").distinct(), "cid", "left_semi")


def search_one(index: Index, query, k: int, probes: int, metric: str = "l2", digits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", search: Search = knn.search) -> DataFrame:
    """``(rank, id, dist)`` for one query vector."""
    one = index.vectors.sparkSession.createDataFrame([(0, [float(v) for v in query])], "qid long, q array<double>")
    some = candidates(index, probe(index, one, probes, metric, digits, search))
    return search(some, one, metric, k, digits=digits, id_col=id_col, vector_col=vector_col).drop("qid")


def search_batch(index: Index, queries: DataFrame, k: int, probes: int, metric: str = "l2", digits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = 64 << 20) -> DataFrame:
    """``(qid, rank, id, dist)`` for a table of queries, each against the clusters
    it probes.

    Queries and the clusters they probe are sent in blocks of at most ``query_bytes``,
    by count, dimensions and probes; a larger set makes further passes over the
    probed clusters. A task scores each cluster's rows against the queries that
    probe it and keeps k rows a query, so no vector is shuffled and a large
    cluster may lie in any number of tasks.
    """
    ascending = distances.nearest_first(metric)
    spark = index.vectors.sparkSession
    probed = probe(index, queries, probes, metric, digits).groupBy("qid").agg(F.collect_list("cid").alias("cids"))
    plain = queries.select(F.col("qid").cast("long"), F.col("q").cast("array<double>")).join(probed, "qid").withColumn("k", F.lit(k))
    columns = f"qid long, `{id_col}` long, dist double, k int"
    out = None
    for block in knn._query_blocks(plain.select("qid", "q", "k", "cids"), query_bytes, 4 * probes):
        cids = block[3]
        owner = np.repeat(np.arange(len(cids)), [len(c) for c in cids])
        cids = np.concatenate([np.asarray(c, np.int64) for c in cids]) if len(cids) else np.zeros(0, np.int64)
        probing = {int(c): owner[cids == c] for c in np.unique(cids)}
        shared = spark.sparkContext.broadcast((*block[:3], probing))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, points, ks, probing = shared.value
            best = knn.Nearest(metric, points, ks, ascending, digits)
            for batch in batches:
                held, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                rows = matrix(batch.column(2))
                for c in np.unique(held):
                    asking = probing.get(int(c))
                    if asking is None:
                        continue
                    mine = np.flatnonzero(held == c)
                    step = max(1, knn.ROW_BYTES // (8 * max(points.shape[1], len(asking))))
                    for start in range(0, len(mine), step):
                        some = mine[start : start + step]
                        best.offer(ids[some], rows[some], asking)
            yield from best.batches(qids, id_col)

        rows = knn._with_vectors(index.vectors, id_col, vector_col, "cid").where("cid is not null")
        if len(probing) <= MOST_LISTED:  # prunes the folders of a written index
            rows = rows.where(F.col("cid").isin(list(probing)))
        part = rows.select("cid", id_col, vector_col).mapInArrow(run, columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], columns)
    ranked = top_k_per_group(out, "qid", "dist", id_col, k, "asc" if ascending else "desc")
    return ranked.select("qid", "rank", id_col, "dist")


def recall(exact: DataFrame, approximate: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """``(qid, recall)``: the share of the exact neighbours that were found."""
    hits = approximate.select("qid", id_col).withColumn("hit", F.lit(1))
    return exact.join(hits, ["qid", id_col], "left").groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def choose_probes(index: Index, queries: DataFrame, exact: DataFrame, least: float = 0.9, metric: str = "l2", digits: int | None = None, id_col: str = "vec_id") -> int:
    """The fewest probes whose mean recall of the queries' ``exact`` neighbours is
    at least ``least``: one pass, by the rank of each neighbour's cluster."""
    clusters = index.centroids.count()
    ranks = probe(index, queries, clusters, metric, digits).select("qid", "cid", "rank")
    own = exact.select("qid", id_col).join(index.vectors.select(id_col, "cid"), id_col)
    counts = {r["rank"]: r["count"] for r in own.join(ranks, ["qid", "cid"]).groupBy("rank").count().collect()}
    total, found = sum(counts.values()), 0
    for rank in sorted(counts):
        found += counts[rank]
        if found >= least * total:
            return rank
    return clusters


def vector_of(vectors: DataFrame, key: int, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    row = vectors.where(F.col(id_col) == key).select(vector_col).first()
    if row is None:
        raise ValueError(f"no vector {key}")
    return np.array(row[0], float)
