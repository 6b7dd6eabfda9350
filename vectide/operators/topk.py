"""Deterministic top-k: global and per group, smallest, largest or nearest zero.

Ties go to the smaller id, k beyond the rows gives all rows; NaN comes after all
numbers in every order, and null after NaN. Both forms keep k rows in each task
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = ("asc", "desc", "abs")


def _keys(df: DataFrame, value: str, tie: str, order: str) -> list[Column]:
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; one of {', '.join(ORDERS)}")
    v = F.col(value)
    keys = [{"asc": v.asc_nulls_last(), "desc": v.desc_nulls_last(), "abs": F.abs(v).asc_nulls_last()}[order], F.col(tie).asc()]
    if order == "desc" and dict(df.dtypes)[value] in ("float", "double"):  # Spark holds NaN for the largest number
        keys.insert(0, F.isnan(v).asc())
    return keys


def top_k(df: DataFrame, value: str, tie: str, k: int, order: str = "asc") -> DataFrame:
    """The first k rows by ``value`` (then ``tie``), with their ``rank`` from 1."""
    keys = _keys(df, value, tie, order)
    few = df.orderBy(*keys).limit(k)  # at most k rows: they may be ranked in one task
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def top_k_per_group(df: DataFrame, group: str | list[str], value: str, tie: str, k: int | Column, order: str = "asc") -> DataFrame:
    """The first k rows of each group, with ``rank``; k may be a column."""
    groups = [group] if isinstance(group, str) else group
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*_keys(df, value, tie, order))))
    return ranked.where(F.col("rank") <= k)


def gather(ranked: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The ranked rows with the source's other columns, by id."""
    return ranked.join(source, key)
