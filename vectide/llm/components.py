"""Connected components of a link table, by alternating star contraction.

Each round is two joins with a per-node minimum; the minimum is a partial
aggregate and the join is one that adaptive execution can split, so a hub with
a third of all links does not land in one task. Rounds are written tables, so
lineage stays short. Only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.sources.tables import remove, written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``pairs(a, b)``, a > b, each pair once.

    Large: every node's larger neighbours move to its smallest neighbour.
    Small: every node's smaller neighbours, and it, move to the smallest.
    """
    if large:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        moved = pairs.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(own)
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every linked node but the roots; root is the smallest
    node reachable. Self links and rows with nulls are ignored."""
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("p"), F.col(b).alias("q"))
    pairs = written(pairs.where("p <> q").select("a", "b").distinct(), "links", narrow=True)
    state = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or state == (now["n"], now["h"]):
            out = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.written_to = pairs.written_to  # for ``remove``
            return out
        state = (now["n"], now["h"])
        before, pairs = pairs, written(_star(_star(pairs, large=True), large=False), "stars", narrow=True)
        remove(before)
