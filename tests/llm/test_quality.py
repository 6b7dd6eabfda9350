import random
import re
from collections import Counter

from pyspark.sql import types as T

from vectide.llm import quality

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("n_words", "string").add("kept", "string")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, total = len(words), sum(map(len, words))
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    seen, dup, dup_chars, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            chars += len(line.encode())
            if line in seen:
                dup += 1
                dup_chars += len(line.encode())
            seen.add(line)
    shares = []
    for width in quality.LIMITS:
        before, covered = set(), set()
        for i in range(n - width + 1):
            w = tuple(words[i : i + width])
            if w in before:
                covered |= set(range(i, i + width))
            before.add(w)
        shares.append(sum(len(words[i]) for i in covered) / total if total else 0.0)
    base = (n, total, len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
    failed = n < 50 or 100 * len(repeated) > 50 * n
    line = dup_chars / chars if chars else 0.0
    kept = not failed and line <= 0.2 and all(s <= m for s, m in zip(shares, quality.LIMITS.values())) and base[2] <= 0.1 * n
    return (*base, failed, kept), shares, line


def test_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n, k: " ".join(str(rng.randrange(k)) for _ in range(n))
    line = some(20, 10**6) + " # é\n"
    rows = [(i, some(rng.randint(0, 200), rng.choice([3, 30, 10**6]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a"), (103, "a"), (104, "x y z " * 20_000), (105, line * 4), (106, line + some(400, 10**6) + "\n" + line), (109, " ".join(f"#{i}" for i in range(100))), (107, "| a | b " * 30), (108, "É\x1cß\x85ı a b c a b c\n\n \n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = {(r["doc_id"], r["n_words"]): r for r in quality.score(df).collect()}
    verdicts = set()
    for k, t in rows:
        base, shares, line_share = brute(t) if k != 104 else (None, None, None)
        if base:
            r = got[k, base[0]]
            assert (*[r[c] for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]], r["base_failed"], r["kept"]) == base, (k, t)
            assert all(abs(a - b) < 1e-12 for a, b in zip(r["window_shares"], shares)) and abs(r["line_share"] - line_share) < 1e-12
            verdicts.add(base[-2:])
    assert verdicts == {(True, False), (False, True), (False, False)}
    assert got[104, 60_000]["n_repeat_words"] == 60_000


def test_empty(spark):
    assert quality.score(spark.createDataFrame([], DOCS)).count() == 0
