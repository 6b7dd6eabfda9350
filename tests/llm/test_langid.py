import random

import numpy as np
import pytest
from pyspark.sql import types as T

from vectide.llm import langid

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("score", "string")
SYLLABLES = {"xx": ["ka", "lo", "mi", "ré"], "yy": ["str", "ung", "ße", "lich"], "zz": ["日", "本", "語"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    make = lambda lang: " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(rng.randint(3, 60)))
    return [(i, make(lang := rng.choice(sorted(SYLLABLES))), lang, "s") for i in range(n)]


def test_held_out_accuracy_and_edges(spark):
    data = rows(300) + [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "123 !?", "yy", "s"), (None, "kalomi", None, "s"), (1003, "kalo " * 300_000, None, "s"), (1003, "kalo " * 300_000, None, "s")]
    df = spark.createDataFrame(data, DOCS)
    found = langid.identify(df, langid.train(df, per_language=40, landmarks=12)).withColumn("held", langid.held_out()).collect()
    assert len(found) == len(data)
    known = [r for r in found if r["lang"] and r["held"] and langid.has_letter(r["text"])]
    assert len(known) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in known]) > 0.97
    for r in found:
        assert 0 <= r["score"] <= 1
        if not langid.has_letter(r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (None, 1003)} == {"xx"}


def test_kernel_is_the_blended_presence_kernel():
    texts = [t for _, t, _, _ in rows(12, seed=4)]
    model = langid.fit([(lang, t) for _, t, lang, _ in rows(30)], landmarks=6)
    grams = lambda t: {tuple(c[i : i + n]) for c in [model.table[[ord(x) for x in t]].tolist()] for n in (1, 2, 3) for i in range(len(c) - n + 1)}
    chosen = [t for lang in sorted(SYLLABLES) for t in [t for _, t, own, _ in rows(30) if own == lang][:2]]
    expected = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in chosen] for a in texts]
    assert np.allclose(model.kernel(texts), expected, atol=1e-6)


def test_model_does_not_see_held_out_rows(spark):
    df = spark.createDataFrame(rows(200), DOCS)
    held = {r["text"] for r in df.where(langid.held_out()).collect()}
    assert held and not held & {t for _, t in langid.sample(df, "doc_id", "text", "lang", 1000)}


@pytest.mark.parametrize("data", [[], [(1, "abc", None, "s")]])
def test_nothing_to_learn(spark, data):
    df = spark.createDataFrame(data, DOCS)
    assert [r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()] == ["und"] * len(data)


def test_a_text_in_no_learned_language_is_not_claimed(spark):
    model = langid.fit([(lang, t) for _, t, lang, _ in rows(300) if lang != "zz"])
    clean = [t for _, t, lang, _ in rows(200, seed=9) if lang != "zz"]
    short = [" ".join(t.split()[:n]) for t in clean for n in (1, 2)]
    foreign = ["Это документ на незнакомом языке", "日本語", "xqzv jkwq zzxv qqjk vbxz wkqj", "Ten dokument jest napisany w języku, którego nikt nie zna"]
    assert all(claimed for _, _, claimed in model.judge(clean + short))
    assert not any(claimed for _, _, claimed in model.judge(foreign + ["12", "", None]))
    assert all(score >= 1 / 2 for _, score in model.predict(foreign))  # the score can't tell


def scripts(letters, seed, texts):
    rng = random.Random(seed)
    own = {f"l{k}": [chr(0x4E00 + 400 * k + i) for i in range(letters)] for k in range(4)}
    return [(lang, " ".join("".join(rng.choices(own[lang], k=2)) for _ in range(25))) for lang in own for _ in range(texts)]


@pytest.mark.parametrize("letters", [8, 60, 300])
def test_languages_with_hundreds_of_letters(letters):
    model = langid.fit(scripts(letters, 1, 100))
    fresh = scripts(letters, 2, 50)
    found = model.predict([t for _, t in fresh])
    assert np.mean([lang == own for (own, _), (lang, _) in zip(fresh, found)]) >= 0.95


def test_weights_solve_the_ridge_regression():
    """On the Nyström features the gradient of the penalised squares is zero, and the
    features' products are the kernel on the landmarks."""
    data = [(lang, t) for _, t, lang, _ in rows(60, seed=3)]
    ridge = 1e-3
    model = langid.fit(data, landmarks=9, ridge=ridge)
    texts = [t for _, t in data]
    block = model.kernel(texts)
    chosen = [t for lang in sorted(SYLLABLES) for t in [t for own, t in data if own == lang][:3]]
    values, vectors = np.linalg.eigh(model.kernel(chosen))
    x = block @ (vectors / np.sqrt(values))
    z = model.kernel(chosen) @ (vectors / np.sqrt(values))
    assert np.allclose(z @ z.T, model.kernel(chosen), atol=1e-6)
    w = np.linalg.lstsq(vectors / np.sqrt(values), model.weights, rcond=None)[0]
    y = np.array([[1.0 if lang == own else -1.0 for own in model.languages] for lang, _ in data])
    off = x @ w + model.bias - y
    assert np.allclose(off.sum(axis=0), 0, atol=1e-6)
    assert np.allclose(x.T @ off + ridge * len(data) * w, 0, atol=1e-5)


def test_sample_is_bounded_in_bytes(spark):
    data = [(i, "kalo " * (2000 if i % 2 else 10), "xx", "s") for i in range(200)] + [(1000 + i, "strung " * 5000, "yy", "s") for i in range(9)]
    df = spark.createDataFrame(data, DOCS)
    found = langid.sample(df, "doc_id", "text", "lang", 50, language_bytes=20_000)
    size = {lang: sum(len(t) for own, t in found if own == lang) for lang in ("xx", "yy")}
    assert size["xx"] <= 20_000 and size["yy"] == 35_000  # one row at least
    assert all(len(t) == 50 for lang, t in found if lang == "xx")
