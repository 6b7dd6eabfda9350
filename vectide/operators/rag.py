"""Retrieval-augmented text: embed, retrieve, build a prompt, generate."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.embed import Embedder, embed
from vectide.operators import knn

DEFAULT_K = 2


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoGenerator:
    """A deterministic stand-in for a model: the prompt and a mark."""

    def __init__(self, mark: str = " [no model]"):
        self.mark = mark

    def generate(self, prompts: list[str]) -> list[str]:
        return [p + self.mark for p in prompts]


def requests(df: DataFrame) -> DataFrame:
    """Validated requests ``(qid, query, k)``: a missing k is 2; a missing query or
    a k that is not positive fails."""
    query = F.coalesce("query", F.raise_error("a request needs a query").cast("string"))
    k = F.coalesce(F.col("k").cast("int"), F.lit(DEFAULT_K)) if "k" in df.columns else F.lit(DEFAULT_K)
    positive = F.when(k > 0, k).otherwise(F.raise_error("k must be positive").cast("int"))
    return df.select(F.col("qid").cast("long"), query.alias("query"), positive.alias("k"))


def retrieve(documents: DataFrame, queries: DataFrame, order: str = "desc", digits: int | None = None) -> DataFrame:
    """``(qid, rank, doc_id, sim)``: of ``documents(doc_id, embedding)`` those most
    similar (dot product) to each of ``queries(qid, q, k)``; ``asc`` the least."""
    found = knn.search(documents, queries, "dot", DEFAULT_K, order, digits, id_col="doc_id")
    return found.withColumnRenamed("dist", "sim")


def prompts(retrieved: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, prompt)`` from ``queries(qid, query)`` and the retrieved texts by rank.
    A query's texts are its k at most, so its group is bounded."""
    return _prompted(retrieved, documents, queries).select("qid", "prompt")


def _prompted(retrieved: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` with their ``prompt``."""
    texts = retrieved.join(documents.select("doc_id", "text"), "doc_id")
    context = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("docs"))
    joined = F.array_join(F.transform(F.coalesce("docs", F.array().cast("array<struct<rank:int,text:string>>")), lambda d: d["text"]), "\n")
    prompt = F.concat(F.lit("Question: "), "query", F.lit("\nContext:\n"), joined, F.lit("\nAnswer:"))
    return queries.join(context, "qid", "left").withColumn("prompt", prompt)


def generate(df: DataFrame, generator: Generator, prompt_col: str = "prompt", into: str = "result") -> DataFrame:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(generator.generate(list(part)), dtype=object)

    return df.withColumn(into, run(F.col(prompt_col)))


def answer(documents: DataFrame, asked: DataFrame, embedder: Embedder, generator: Generator, order: str = "desc", digits: int | None = None) -> DataFrame:
    """``(qid, query, result)`` for requests ``asked(qid, query[, k])``, over
    ``documents(doc_id, text, embedding)``."""
    valid = requests(asked)
    vectors = embed(valid.withColumn("text", F.col("query")), embedder, into="q").select("qid", "q", "k")
    filled = _prompted(retrieve(documents, vectors, order, digits), documents, valid)
    return generate(filled, generator).select("qid", "query", "result")
