import random

from pyspark.sql import types as T

from vectide.llm import licenses as L
from vectide.llm.license_texts import TEXTS, WHOLE, full_texts

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("license", "string").add("end", "string")


def brute_align(own, words):
    """Best of the plain local alignment, without a band."""
    best = (0, 0)
    table = {}
    for i in range(len(own)):
        for j in range(len(words)):
            options = [0]
            if own[i] == words[j]:
                options.append(table.get((i - 1, j - 1), 0) + 1)
            options += [table.get((i - 1, j), 0) - 1, table.get((i, j - 1), 0) - 1]
            table[i, j] = max(options)
            best = max(best, (table[i, j], 0))
    return best[0]


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(200):
        own = [rng.choice("abc").encode() for _ in range(rng.randint(1, 12))]
        words = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 14))]
        found = L.align(own, words, -20, 20, 1)
        assert max((aligned - misses for aligned, misses, _, _ in found), default=0) == brute_align(own, words)
        assert all(0 <= first < end <= len(words) and words[end - 1] in own for _, _, first, end in found)


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(200):
        shared = [rng.randrange(1000) for _ in range(L.WINNOW)]
        a = [rng.randrange(1000, 2000) for _ in range(rng.randint(0, 5))] + shared + [rng.randrange(1000, 2000) for _ in range(4)]
        b = [None] * rng.randint(0, 4) + shared + [None] * 2
        assert {a[i] for i in L.winnow(a)} & {b[i] for i in L.winnow(b)}


def test_documents(spark):
    mit = TEXTS["MIT"]
    edited = mit.replace("free of charge, ", "").replace("publish", "print").replace("and/or sell", "and sell")
    far = "ordinary words without any notice " * 30
    rows = [
        (1, "Étude. Licensed under CC BY-NC 4.0.\nThe text."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, far + "Released under the MIT License. " + far),
        (4, "Licensed under the Apache License, Version 2.0."),
        (5, far + edited + far + "licensed under cc by 4.0"),
        (6, far), (7, None), (8, ""), (9, "released the license under mit"), (10, "x " * 200_000 + "Released under the MIT License."),
        (11, TEXTS["Apache-2.0"]), (4, "Licensed under the Apache License, Version 2.0."), (12, "the software of the license " * 5_000),
        (13, "Released under the MIT License.\n" * 300 + far + "Licensed under CC BY 4.0. Licensed under CC BY 4.0."),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    shown = {k: [r["license"] for r in v] for k, v in got.items()}
    assert shown == {1: ["CC-BY-NC-4.0"], 2: ["GPL-3.0"], 3: ["MIT"], 4: ["Apache-2.0"] * 2, 5: ["MIT", "CC-BY-4.0"], 10: ["MIT"], 11: ["Apache-2.0"], 13: ["MIT"] * 300 + ["CC-BY-4.0"] * 2}
    text = dict(rows)
    spans = {k: text[k][v[0]["start"] : v[0]["end"]] for k, v in got.items()}
    assert spans[1] == "Licensed under CC BY-NC 4.0" and spans[3] == "Released under the MIT License" and spans[10] == spans[3]
    assert spans[5].startswith("Permission is") and spans[5].endswith("of the Software") and 0.8 <= got[5][0]["coverage"] < 1
    assert got[11][0]["template"] == "Apache-2.0 text" and got[11][0]["coverage"] == 1
    assert L.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_texts_end_at_their_ends():
    index = L.Index()
    for spdx, text in WHOLE.items():
        n = len(text.encode().translate(L._FOLD).split())
        found = index.reports(f"ordinary words before it {text} and other ones".encode())
        assert [(licence, name, coverage, end - first) for licence, name, coverage, first, end in found] == [(spdx, f"{spdx} whole text", 1.0, n)]
    for spdx in WHOLE.keys() & TEXTS.keys():  # a text cut before its end is not the whole text
        assert [(r[0], r[1]) for r in index.reports(TEXTS[spdx].encode())] == [(spdx, f"{spdx} text")]


def test_names_versions_and_denials():
    index = L.Index()
    said = {
        "SPDX-License-Identifier: MIT": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "Licensed under Apache-2.0.": "Apache-2.0",
        "is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "released under GPLv3": "GPL-3.0",
        "Licensed under the GNU GPL version 1": "GPL-1.0",
        "licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0",
        "released under the BSD 4-Clause License": "BSD-4-Clause",
        "distributed under the terms of the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "made available to all under the Mozilla Public License, v. 2.0": "MPL-2.0",
    }
    for text, licence in said.items():
        assert [r[0] for r in index.reports(f"One. {text} and more".encode())] == [licence], text
    for text in ("not licensed under the MIT License", "published under the MIT Press", "licensed under GPL version 2.1", "the GNU General Public License, version 3", "licensed under the Apache License, version 7.0", "they aren't available under CC BY 4.0"):
        assert index.reports(text.encode()) == [], text
    gpl = TEXTS["GPL-3.0"]
    assert [r[0] for r in index.reports(gpl.encode())] == ["GPL-3.0"]
    assert index.reports(gpl.replace("version 3", "version 9").encode()) == []
    assert [r[0] for r in index.reports(gpl.replace("version 3", "version 1").replace("either version 1 of the License", "either version 1").encode())] == ["GPL-1.0"]


def test_long_licences_by_passages():
    index = L.Index()
    for spdx, text in full_texts().items():
        n = len(L._folded(text))
        assert [(r[0], r[1], r[2], r[4] - r[3]) for r in index.reports(f"ordinary words {text} other ones".encode())] == [(spdx, f"{spdx} full text", 1.0, n)]
    text = full_texts()["Apache-2.0"]
    (start,) = index.reports(text[: len(text) // 4].encode())
    assert start[0] == "Apache-2.0" and 0.15 < start[2] <= 0.26
    words = text.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 40)
    (found,) = index.reports(edited.encode())
    assert found[0] == "Apache-2.0" and 0.9 < found[2] < 1
    missing = " ".join(words[:500] + words[700:])  # two passages and parts of others are gone
    (found,) = index.reports(missing.encode())
    assert found[0] == "Apache-2.0" and 0.75 < found[2] < 0.95


def test_against_a_plain_scan():
    """No index, no band, no bound: every template is aligned with the whole text."""
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(25)]
    source = [(f"s{k} text", f"s{k}", "text", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))) for k in range(6)]
    index = L.Index(source)
    reported = 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(source)[3].split()
            own = [w for w in own if rng.random() > 0.06]
            if own and rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), rng.choice(vocabulary))
            words += [rng.choice([*vocabulary, "z"]) for _ in range(rng.randint(0, 5))] + own
        coded = [w.encode() for w in words]
        found = []
        for name, licence, _, text in source:
            own = text.encode().split()
            for aligned, misses, first, end in L.align(own, coded, -len(own), len(coded), L.LEAST * len(own)):
                found.append((misses - aligned, first, name, end, licence, aligned / len(own)))
        kept = []
        for _, first, name, end, licence, coverage in sorted(found):
            if all(end <= a or b <= first for _, _, _, a, b in kept):
                kept.append((licence, name, coverage, first, end))
        want = sorted(kept, key=lambda r: r[3])
        # What the index can't see: alignments without three words in a row in common.
        got = index.reports(" ".join(words).encode())
        seen = lambda r: any(coded[i : i + 3] == own[j : j + 3] for own in [next(s[3] for s in source if s[0] == r[1]).encode().split()] for i in range(r[3], r[4] - 2) for j in range(len(own) - 2))
        assert got == [r for r in want if seen(r)]
        reported += len(got)
    assert reported > 100
