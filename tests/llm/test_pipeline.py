import hashlib
import itertools
import random
import re

import public_tokenizers
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline as P
from vectide.llm import bpe, langid

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("root", "string").add("hits", "string")


def corpus():
    rng = random.Random(6)
    syllables = {"xx": ["ka", "lo", "mi", "ré"], "yy": ["str", "ung", "ße", "lich"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang := rng.choice(["xx", "yy"]), rng.randint(5, 80)), lang) for i in range(80)]
    passage = make("xx", 14)
    rows += [(100, rows[3][1], "xx"), (100, rows[3][1], "xx"), (101, "".join(c.upper() if c.isascii() else c for c in rows[5][1]), None)]
    rows += [(110, make("xx", 30) + " " + passage + " " + make("xx", 30), "xx"), (111, passage, "xx")]
    rows += [(120, make("yy", 20) + " mail jo@x.example.com, +1 (566) 555-5977. " + make("yy", 9), "yy")]
    rows += [(130, None, None), (131, "", None), (132, "12 34 !", "xx"), (None, make("xx", 12), "xx")]
    return [(k, t, lang, "s", len(t or ""), "r", "h") for k, t, lang in rows], passage


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def without_passage(text, passage):
    """The text without ten-word windows of the passage, or None if most of it goes."""
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    words, item = [lower(m[0]) for m in find(text)], [lower(m[0]) for m in find(passage)]
    hit = [False] * len(words)
    for i in range(len(words) - 9):
        if any(words[i : i + 10] == item[j : j + 10] for j in range(len(item) - 9)):
            hit[i : i + 10] = [True] * 10
    if sum(hit) > 0.5 * len(words):
        return None
    out, at = "", 0
    for k, m in enumerate(find(text)):
        if hit[k] and not (k and hit[k - 1]):
            out += text[at : m.start()]
        if hit[k]:
            at = m.end()
    return out + text[at:]


def brute(rows, passage):
    """What the five stages keep, by plain loops that share no code with them. The
    corpus has two languages, and personal data of the base patterns only."""
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    owned = [shingles(r[1]) for r in kept]
    root = list(range(len(kept)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(kept)), 2):
        if len(owned[i] & owned[j]) >= 0.8 * len(owned[i] | owned[j]):
            root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(find(i), []).append(r)
    official = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for group in groups.values():
        r = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        text = without_passage(r[1], passage)
        if text is not None:
            text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text)
            text = re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[PHONE]", text)
            out.append((r[0], official.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_stages_and_run(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("1", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = docs
    for name, f in P.STAGES[:-1]:
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), DOCS)
        assert stage.columns == docs.columns, name
        assert all(r["n_chars"] == len(r["text"] or "") for r in stage.collect())
    ids = {r["doc_id"] for r in stage.collect()}
    assert {None, 110, 120} <= ids and not {100, 101, 111, 130, 131, 132} & ids
    text = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert passage not in text[110] and "[EMAIL]" in text[120] and "[PHONE]" in text[120]
    got = P.run(spark, str(tmp_path)).collect()
    assert {r["lang"] for r in got} == {"xx", "yy"}  # documents without one are labelled
    order = lambda r: (r[0] is None, r[0])
    assert sorted([(r["doc_id"], r["ids"], r["decoded_sha256"]) for r in got], key=order) == sorted(brute(rows, passage), key=order)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_what_no_language_claims(spark, tmp_path):
    rows = [r for r in corpus()[0] if r[1] and langid.has_letter(r[1])]
    foreign = [(900, "Это документ на незнакомом языке, который должен уйти", None, "s", 9, "r", "h"), (901, "xqzv jkwq zzxv qqjk vbxz wkqj", None, "s", 9, "r", "h")]
    short = [(910, "kalomi", None, "s", 6, "r", "h"), (911, "strungße lichung", None, "s", 9, "r", "h")]
    kept = P.identify_language(spark, spark.createDataFrame(rows + foreign + short, DOCS), str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r[0]) for r in rows + short)
