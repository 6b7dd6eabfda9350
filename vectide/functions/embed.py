"""Text embedders: anything with ``dimensions`` and ``embed(texts) -> matrix``."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Token counts in ``dimensions`` buckets by MD5, scaled to unit length.

    Tokens are runs of ASCII letters and digits of the lower-cased text. A text's
    vector does not depend on what else is in the batch; no tokens give zeros.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self._bucket: dict[str, int] = {}

    def bucket(self, token: str) -> int:
        found = self._bucket.get(token)
        if found is None:
            if len(self._bucket) > 500_000:
                self._bucket.clear()
            found = self._bucket[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for token, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
                row[self.bucket(token)] += n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", into: str = "embedding") -> DataFrame:
    """``df`` with the embedding of each text (null: the empty text)."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(embedder.embed([t or "" for t in texts])), dtype=object)

    return df.withColumn(into, run(F.col(text_col)))


def as_column(values) -> Column:
    """A vector as an array literal."""
    return F.array(*[F.lit(float(v)) for v in values])
