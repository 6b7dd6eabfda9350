"""Language identification by a string kernel.

The kernel of two texts is the number of distinct n-grams (lengths 1 to 3,
blended) that both hold, over the root of the product of their own numbers.
Every letter counts, case folded, and all other characters alike. N-grams of the
62 most frequent letters have a slot each in a table of flags; those with any other
letter, of which a text in one script has few or a text in a large script many,
are sorted as numbers. Both are exact. Nyström landmarks, a bounded share of a
bounded labelled sample (at least one of each language), give the feature map;
one-versus-rest kernel ridge regression is solved on it in closed form; scoring
a block of documents is two matrix products: presence times landmark presence,
and the normalised kernel block times the weights.

The sample is ``per_language`` rows of each language, those with the smallest
row hash, as far as they have ``language_bytes`` together (texts over a tenth of
that come last, and one row is always taken), so the same rows give the same model
at any partitioning. Everything else, prediction above all, works on whole texts
of all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any labelled row all are ``und``; ties go to the first language in
order; repeated rows are predicted alike (and count once in the sample).

The scores of a text sum to a constant over the languages, so the best of them
cannot say that a text is in none. What can is the share of its distinct n-grams
that any landmark holds: a text is claimed unless that share is under what the
landmarks hold of each other, less a margin for short texts. Landmarks of all
languages count, so that a text in two of them is claimed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import slices

CLASSES = 64
SLOTS = CLASSES + CLASSES**2 + CLASSES**3
CHUNK = 1 << 20
UND = "und"
#: Texts are claimed down to this part of the landmarks' median share, less so many
#: standard deviations of a share of the text's n-grams.
USUAL, MARGIN = 0.85, 3.0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _alphabet(texts: list[str]) -> np.ndarray:
    """Number of each code point: 0 no letter, below CLASSES a frequent letter, else
    a letter of its own."""
    counts: Counter[str] = Counter()
    for t in texts:
        counts.update(t.lower())
    letters = sorted((c for c in counts if c.isalpha()), key=lambda c: (-counts[c], c))[: CLASSES - 2]
    classes = {c: k for k, c in enumerate(letters, 2)}
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = classes.get(low, CLASSES + ord(low[0]))
    return table


def _mark(text: str, table: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Set the flag of every n-gram of frequent letters; the sorted numbers of the others."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    rare = [np.zeros(0, np.int64)]
    for start in range(0, len(points), CHUNK):
        one = table[points[start : start + CHUNK + 2]].astype(np.int64)
        two = one[:-1] * CLASSES + one[1:]
        three = two[:-1] * CLASSES + one[2:]
        large = one >= CLASSES
        if not large.any():
            flags[one] = True
            flags[two + CLASSES] = True
            flags[three + CLASSES + CLASSES**2] = True
            continue
        large2 = large[:-1] | large[1:]
        large3 = large2[:-1] | large[2:]
        flags[one[~large]] = True
        flags[two[~large2] + CLASSES] = True
        flags[three[~large3] + CLASSES + CLASSES**2] = True
        own = one + 1
        pairs = (own[:-1] << 21) | own[1:]
        rare += [np.unique(x) for x in (own[large], pairs[large2], ((pairs[:-1] << 21) | own[2:])[large3])]
    return np.unique(np.concatenate(rare))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    slots: np.ndarray  # n-grams of frequent letters that any landmark holds
    others: np.ndarray  # the other n-grams that any landmark holds, sorted
    landmarks: np.ndarray  # slots and others x landmarks, presence
    sizes: np.ndarray  # distinct n-grams of each landmark
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    usual: float  # least usual share of a text's n-grams that any landmark holds

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the slots in each text, and each text's distinct n-grams."""
        flags = np.zeros(SLOTS, bool)
        frequent = len(self.slots)
        presence = np.zeros((len(texts), frequent + len(self.others)), np.float32)
        sizes = np.ones(len(texts))
        for k, t in enumerate(texts):
            flags[:] = False
            rare = _mark(t, self.table, flags)
            presence[k, :frequent] = flags[self.slots]
            if len(rare) and len(self.others):
                at = np.minimum(np.searchsorted(self.others, rare), len(self.others) - 1)
                presence[k, frequent + at[self.others[at] == rare]] = 1
            sizes[k] = max(1, np.count_nonzero(flags) + len(rare))
        return presence, sizes

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel block of the texts (rows) and the landmarks."""
        return self._kernel(*self.presence(texts))

    def _kernel(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (presence @ self.landmarks) / np.sqrt(np.outer(sizes, self.sizes))

    def predict(self, texts: list[str | None], block: int = 128) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts, block)]

    def judge(self, texts: list[str | None], block: int = 128) -> list[tuple[str, float, bool]]:
        """Language, score, and whether any language claims the text."""
        out: list[tuple[str, float, bool]] = [(UND, 0.0, False)] * len(texts)
        rows = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        for start in range(0, len(rows), block):
            part = rows[start : start + block]
            presence, sizes = self.presence([texts[k] for k in part])
            values = self._kernel(presence, sizes) @ self.weights + self.bias
            best = values.argmax(axis=1)
            known = presence.sum(axis=1) / sizes
            least = self.usual - MARGIN * np.sqrt(self.usual * (1 - self.usual) / sizes)
            claimed = known > np.maximum(0, least)
            for k, b, v, c in zip(part, best, values[np.arange(len(part)), best], claimed):
                out[k] = (self.languages[b], float(min(1.0, max(0.0, (v + 1) / 2))), bool(c))
        return out


def fit(rows: list[tuple[str, str]], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Model of ``(language, text)`` rows; the first rows of each language serve
    as its share of the landmarks."""
    rows = [(lang, t) for lang, t in rows if has_letter(t)]
    languages = sorted({lang for lang, _ in rows})
    table = _alphabet([t for _, t in rows])
    if not languages:
        return Model([], table, np.zeros(0, int), np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    share = max(1, landmarks // len(languages))
    chosen = [t for lang in languages for t in [t for own, t in rows if own == lang][:share]]
    held, others = np.zeros(SLOTS, bool), []
    for t in chosen:
        others.append(_mark(t, table, held))
    slots, others = np.flatnonzero(held), np.unique(np.concatenate(others))
    model = Model(languages, table, slots, others, np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    presence, sizes = model.presence(chosen)
    # Each landmark against the others.
    usual = USUAL * float(np.median(presence @ (presence.sum(axis=0) > 1) / sizes))
    model = Model(languages, table, slots, others, presence.T, sizes, np.zeros((len(chosen), len(languages))), np.zeros(len(languages)), usual)

    values, vectors = np.linalg.eigh(model.kernel(chosen))
    good = values > 1e-6 * values.max()
    feature_map = vectors[:, good] / np.sqrt(values[good])
    texts = [t for _, t in rows]
    features = np.vstack([model.kernel(texts[i : i + 128]) for i in range(0, len(texts), 128)]) @ feature_map
    targets = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang, _ in rows])
    centre, mean = features.mean(axis=0), targets.mean(axis=0)
    x, y = features - centre, targets - mean
    solved = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ y)
    model.weights, model.bias = feature_map @ solved, mean - centre @ solved
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 by 4.
    A null id counts as not held out, and isn't learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, language_bytes: int = 4 << 20) -> list[tuple[str, str]]:
    """The bounded labelled sample, smallest row hashes first."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull() & ~held_out(id_col))
    hashed = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text"))
    order = [F.col("size") > language_bytes // 10, F.col("h")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = hashed.select("lang", "h", "size").withColumn("r", rank).where(F.col("r") <= per_language)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("total", total).where((F.col("total") <= language_bytes) | (F.col("r") == 1)).select("lang", "h").distinct()
    # At most per_language hashes a language: a size bound for the broadcast.
    rows = hashed.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, landmarks: int = 128, language_bytes: int = 4 << 20) -> Model:
    return fit(sample(docs, id_col, text_col, lang_col, per_language, language_bytes), landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, or as named by ``into``; columns
    so named are replaced. A third name adds whether any language claims the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*into)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.judge(batch.column(at).to_pylist())
            added = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            columns = [*batch.columns, *added[: len(into)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *into])

    schema = T.StructType(list(docs.schema))
    for name, kind in zip(into, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
