import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from vectide.llm import simhash

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("fp", "string").add("root", "string").add("n", "string")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: component} of [(id, print)], by union-find over all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[find(i)] = min(k, least.get(find(i), k))
    return {(k, p): least[find(i)] for i, (k, p) in enumerate(prints)}


def test_fingerprint_matches_definition():
    for text in ["", "  \n", "One", "two words", "A b C d e É ß ı", "x\x1cy\x85z\xa0w q r", "dup dup dup dup dup", "ab cd " * 40_000]:
        assert simhash.fingerprint(text.encode()) % 2**64 == brute_print(text), text[:20]


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=4))
    base = [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(i, base[i % 30] if i % 3 else base[i % 30] + " " + word()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "a"), (203, "a"), (204, "long " * 30_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    got = {(r["id"], r["fp"] % 2**64): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == brute_components([(k, brute_print(t)) for k, t in rows])


@pytest.mark.parametrize("dense", [2, 32, 10_000])
def test_links_of_clustered_prints(spark, dense):
    """Chains, a dense ball and scattered values; all ways of linking agree."""
    rng = np.random.default_rng(2)
    values = {int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)}
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(64)}
    chain = int(rng.integers(0, 2**64, dtype=np.uint64))
    for i in range(20):
        values.add(chain := chain ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    from vectide.llm.components import connected_components

    root = {r["node"]: r["root"] for r in connected_components(simhash.near_links(df, 2, dense), "a", "b").collect()}
    expected = brute_components(list(zip(signed, values)))
    assert {v: root.get(v, v) for v in signed} == {k: c for (k, _), c in expected.items()}


def test_keep_one(spark):
    rows = [(3, "same text here now"), (1, "same text here now"), (1, "same text here now"), (9, None), (8, ""), (None, "alone in this group"), (5, "quite another text of words")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == [(-1, "alone in this group"), (1, "same text here now"), (5, "quite another text of words"), (8, "")]


def test_keep_one_tells_rows_with_nulls_apart(spark):
    kind = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("__row", "string").add("__n", "string")
    rows = [(1, "the same text", None, "x", "p", None), (1, "the same text", "x", None, "p", None), (1, "the same text", "x", None, None, "p")]
    for order in (rows, rows[::-1], rows + rows):
        got = simhash.keep_one(spark.createDataFrame(order, kind))
        assert got.columns == kind.names and [tuple(r) for r in got.collect()][0] in rows and got.count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_thresholds_are_optimal():
    costs = [{-1: 0, 0: 5, 1: 50, 2: 500}, {-1: 0, 0: 9, 1: 10, 2: 400}, {-1: 0, 0: 6, 1: 70, 2: 900}]
    assert simhash.plan_thresholds(costs, 0) == (15, [0, 1, -1])
