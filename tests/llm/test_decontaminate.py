import random
import re
import time

import pytest
from pyspark.sql import types as T

from vectide.llm import decontaminate as D

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("items", "string").add("hits", "string")
ITEMS = T.StructType().add("item_id", "string").add("text", "string").add("n_words", "string")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        size = min(len(v), window)
        for i in range(len(v) - size + 1) if v else ():
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name or "")
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("window, blocks", [(4, 400_000), (3, 12), (10, 400_000)])
def test_against_brute_force(spark, window, blocks):
    rng = random.Random(window)
    some = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    items = [(f"i{k}", some(rng.randint(1, 14), "ab cde".replace(" ", ""))) for k in range(14)]
    items += [("i3", "a b"), ("short", "É-x"), (None, "zz yy xx"), ("none", None), ("blank", "!?"), ("i0", items[0][1])]
    rows = [(k, some(rng.randint(0, 60), "abcdefé")) for k in range(60)] + [(70, None), (71, ""), (71, "zz, YY; xx"), (72, "x é X É-X."), (73, "a b " * 4000)]
    rows += [(80 + k, "q " + items[k][1].upper() + " q " + items[k + 1][1]) for k in range(10)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    bench = spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    got = {}
    for r in D.scan(docs, bench, window=window, block_words=blocks).collect():
        got[r["doc_id"], r["text"]] = (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["items"])
    for k, t in rows:
        if k != 73:
            assert got[k, t] == brute(t, items, window), (k, t)


def test_removal(spark):
    bench = spark.createDataFrame([("i", "one two three four five six", "")], ITEMS)
    rows = [(1, "Keep this, please; and all of that: One, two THREE four five six! And go on."), (2, "one two three four five six end"), (3, "clean  text\n"), (4, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = D.decontaminate(docs, bench, window=6)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Keep this, please; and all of that: ! And go on.", 3: "clean  text\n", 4: None}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.scan(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "some text", "", "")], DOCS)
    assert [(r["n_words"], r["hits"], r["items"]) for r in D.scan(one, bench).collect()] == [(2, [], [])]


def test_many_short_items_take_linear_time():
    words = [b"w%d" % i for i in range(20_000)]
    automaton = D.Automaton([(str(i), [w]) for i, w in enumerate(words)] + [(f"same{i}", [b"again"]) for i in range(2_000)])
    began = time.perf_counter()
    spans, items = automaton.match(words + [b"again", b"x"] * 20_000)
    assert time.perf_counter() - began < 10
    assert len(items) == 22_000 and sum(b - a for a, b in spans) == 40_000


def test_clashing_columns_in_several_blocks(spark):
    kind = T.StructType().add("doc_id", "long").add("text", "string").add("__hash", "string").add("__hits", "string").add("__spans", "string")
    docs = spark.createDataFrame([(1, "b one two three four b", "p", "q", "r"), (1, "b one two three four b", "p", "q", "r"), (2, None, None, None, None), (3, "five six seven eight", "p", None, "r")], kind)
    bench = spark.createDataFrame([("i", "one two three", ""), ("j", "five six seven eight", ""), ("k", "three four", "")], ITEMS)
    got = D.decontaminate(docs, bench, most_coverage=0.7, block_words=4)
    assert got.columns == kind.names
    assert sorted((r["doc_id"], r["text"], r["__hash"], r["__hits"]) for r in got.collect()) == [(1, "b  b", "p", "q"), (1, "b  b", "p", "q"), (2, None, None, None)]
    found = D.scan(docs, bench, block_words=4).collect()
    assert sorted((r["doc_id"], r["n_words"], r["items"], r["__spans"] or "") for r in found) == [(1, 6, ["i", "k"], "r"), (1, 6, ["i", "k"], "r"), (2, 0, [], ""), (3, 4, ["j"], "r")]
