import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import types as T

from vectide.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("word", "string").add("ids", "string").add("block", "string")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def official(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(rng):
    parts = ["the", "The", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "'s", "'ll", "é", "日本", "١٢", "12345", "!!", "🙂", "ß", "<|endoftext|>", "x" * rng.randint(1, 300), "\r\n", "​", "ab1c"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_words_as_the_library(ranks, official):
    rng = random.Random(1)
    find = regex.compile(public_tokenizers.PATTERN).findall
    tokens = bpe.token_bytes(ranks)
    for _ in range(400):
        text = odd_text(rng)
        got = [i for w in find(text) for i in bpe.encode_word(w.encode(), ranks)]
        assert got == official.encode_ordinary(text), repr(text)
        assert bpe.decode(got, tokens) == text.encode()


def test_corpus_round_trip(spark, official):
    rng = random.Random(2)
    rows = [(i, odd_text(rng)) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "no id"), (62, "word " * 50_000), (63, "q" * 5_000)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).repartition(3)
    got = bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for k, t in rows:
        ids = official.encode_ordinary(t or "")
        expected.append((k, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0
