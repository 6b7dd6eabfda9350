"""Licence scans: winnowed fingerprints, an inverted index, banded alignment.

Texts are words of ASCII letters and digits, case folded. Windows of three words
of the templates are hashed; of every ``WINNOW`` successive hashes the smallest is
a fingerprint (in templates under ``SHORT`` words every one), and these are an
inverted index. All windows of a document are looked up in it, so that any run of
``GRAM + WINNOW - 1`` words that a document shares with a template is found; where
a fifth of a template's words are missing, such a run is left. A hit gives a template
and a diagonal; hits on close diagonals are one candidate, and the candidate is
aligned with the document inside a band around its diagonals. What is reported:

* texts and headers of which the aligned words cover enough; in headers, digits and
  the words that tell the GNU licences apart must be the template's, in order;
* names of licences, word for word, after a phrase such as ``released under`` that
  isn't denied, and SPDX tags. Names and versions that aren't known have no report;
* long licences by passages of 100 words: passages found in order are one report,
  from the first to the last, and its coverage is of the whole licence.

Where reports overlap, the one with most aligned words less misses stays.

The index is as large as the templates, which are part of this package and are
sent to the executors. Words that no template has end every window at once, so
only the places where template words run together cost anything; all of every
text is looked at.

Defined results: a null or empty text has no report; repeated rows give
repeated reports; of equally good overlapping reports the first by start, then
template name, stays; offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices, texts
from vectide.llm.license_texts import PASSAGE, templates
from vectide.sources.tables import fresh

GRAM, WINNOW, BAND, LEAST = 3, 2, 8, 0.8
#: Templates of fewer words have all their windows as fingerprints.
SHORT = 30
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def winnow(hashes: list[int | None]) -> list[int]:
    """Positions of the fingerprints; None is larger than any hash. Of equal
    hashes the last counts, and texts shorter than a window have their smallest."""
    out: list[int] = []
    for i in range(max(1, len(hashes) - WINNOW + 1)):
        window = [(h, -k) for k, h in enumerate(hashes[i : i + WINNOW], i) if h is not None]
        if window and (not out or out[-1] != -min(window)[1]):
            out.append(-min(window)[1])
    return out


#: Words that tell headers apart, beside those with a digit.
_TELLING = frozenset(b"affero lesser library".split())
# The phrases of notices, and what denies them.
_VERBS = frozenset(b"licensed licenced released distributed redistributed available published provided offered issued shared covered use used".split())
_DENIED = frozenset(b"not never isn aren wasn weren cannot neither nor longer".split())
_EMPTY = np.uint64((1 << 64) - 1)


def _folded(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _telling(words: list[bytes]) -> list[bytes]:
    return [w for w in words if w in _TELLING or any(48 <= c <= 57 for c in w)]


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, source: list[tuple[str, str, str, str]] | None = None):
        self.templates: list[tuple[str, str, str, list[bytes]]] = []
        self.full: dict[str, int] = {}  # words of each long licence
        for name, licence, kind, text in source or templates():
            words = _folded(text)
            if kind == "full":
                self.full[name] = len(words)
                cuts = range(0, max(1, len(words) - PASSAGE // 2), PASSAGE)
                self.templates += [(name, licence, f"full {k}", words[c : c + PASSAGE] if c != cuts[-1] else words[c:]) for k, c in enumerate(cuts)]
            elif kind == "notice" and len(words) < GRAM:
                leads = [[b"under"], [b"under", b"the"]] if len(words) > 1 else [[v, b"under", *the] for v in (b"licensed", b"released", b"distributed", b"available") for the in ([], [b"the"])]
                self.templates += [(name, licence, kind, [*lead, *words]) for lead in leads]
            else:
                self.templates.append((name, licence, kind, words))
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in self.templates for w in t[3]))}
        self.coded = [np.fromiter(map(self.vocabulary.__getitem__, t[3]), np.int64, len(t[3])) for t in self.templates]
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.coded):
            hashes = self._hashes(ids).tolist()
            for at in winnow(hashes) if len(ids) >= SHORT else range(len(hashes)):
                postings[hashes[at]].append((t, at))
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]

    @staticmethod
    def _hashes(ids: np.ndarray) -> np.ndarray:
        """A hash of each window of three words; windows with an unknown word have none."""
        if len(ids) < GRAM:
            return np.zeros(0, np.uint64)
        x = ids.astype(np.uint64)
        mixed = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD) + x[2:] * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where((ids[:-2] < 0) | (ids[1:-1] < 0) | (ids[2:] < 0), _EMPTY, mixed >> np.uint64(1))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first diagonal, last diagonal), where a diagonal is a document
        position less a template position."""
        hashes = self._hashes(ids)
        places = np.flatnonzero(hashes != _EMPTY)
        slots = np.searchsorted(self.keys, hashes[places])
        hit = slots < len(self.keys)
        places, slots = places[hit], slots[hit]
        hit = self.keys[slots] == hashes[places]
        found: dict[int, set[int]] = defaultdict(set)
        for at, slot in zip(places[hit].tolist(), slots[hit].tolist()):
            for t, own in self.postings[slot]:
                found[t].add(at - own)
        out = []
        for t, diagonals in found.items():
            ordered = sorted(diagonals)
            start = last = ordered[0]
            for d in ordered[1:]:
                if d - last > BAND:
                    out.append((t, start, last))
                    start = d
                last = d
            out.append((t, start, last))
        return out

    def _same(self, own: np.ndarray, ids: np.ndarray, at: int) -> bool:
        return 0 <= at <= len(ids) - len(own) and bool((ids[at : at + len(own)] == own).all())

    def _aligned(self, t: int, words: list[bytes], ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
        own, coded = self.templates[t][3], self.coded[t]
        if low == high and self._same(coded, ids, low):
            return [(n, 0, low, low + n) for n in range(math.ceil(LEAST * len(own)), len(own) + 1)]
        low, high = low - BAND, high + BAND
        if self._reach(coded, ids, low, high) < LEAST * len(own):
            return []
        return align(own, words, low, high, LEAST * len(own))

    @staticmethod
    def _reach(own: np.ndarray, ids: np.ndarray, low: int, high: int) -> int:
        """How many template words are in the document inside the band: no alignment has more."""
        width = high - low + 1
        part = ids[max(0, low) : max(0, high + len(own))]
        if width > 256:
            return int(np.isin(own, part).sum())
        padded = np.full(len(own) + width - 1, -2, np.int64)
        padded[max(0, -low) : max(0, -low) + len(part)] = part
        return int((np.lib.stride_tricks.sliding_window_view(padded, width) == own[:, None]).any(axis=1).sum())

    def _notice(self, own: list[bytes], words: list[bytes], at: int) -> int | None:
        """Where a notice begins that has a name at ``at``, or None if none does."""
        end = at + len(own)
        if own[-1].isdigit() and end < len(words) and words[end].isdigit() and len(words[end]) <= 2:
            return None  # another version
        if words[max(0, at - 3) : at] == [b"spdx", b"license", b"identifier"]:
            return at - 3
        before = at + (own.index(b"under") if b"under" in own else 0)
        if b"under" not in own:
            before = next((k for k in range(at - 1, max(-1, at - 7), -1) if words[k] == b"under"), -1)
        for k in range(before - 1, max(-1, before - 5), -1):
            if words[k] in _VERBS:
                return None if _DENIED.intersection(words[max(0, k - 2) : k]) else k
        return None

    def reports(self, text: bytes) -> list[tuple[str, str, float, int, int]]:
        """(licence, template, coverage, first word, word after the last) found, by start."""
        words = text.translate(_FOLD).split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        found = []
        passages: dict[str, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for t, low, high in self.candidates(ids):
            name, licence, kind, own = self.templates[t]
            if kind in ("notice", "tag"):
                for at in range(low, high + 1):
                    if self._same(self.coded[t], ids, at):
                        start = at if kind == "tag" else self._notice(own, words, at)
                        if start is not None:
                            found.append((-len(own), start, name, at + len(own), licence, 1.0))
                continue
            for aligned, misses, first, end in self._aligned(t, words, ids, low, high):
                if kind.startswith("full"):
                    passages[name].append((first, int(kind[5:]), end, aligned, misses))
                elif kind != "header" or _telling(words[first:end]) == _telling(own):
                    found.append((misses - aligned, first, name, end, licence, aligned / len(own)))
        for name, some in passages.items():
            licence = name.removesuffix(" full text")
            for first, end, aligned, misses in _runs(sorted(some)):
                found.append((misses - aligned, first, name, end, licence, aligned / self.full[name]))
        kept: list[tuple[int, int, str, str, float]] = []
        for _, first, name, end, licence, coverage in sorted(found):
            k = bisect(kept, (first,))
            if (k == len(kept) or end <= kept[k][0]) and (k == 0 or kept[k - 1][1] <= first):
                kept.insert(k, (first, end, licence, name, coverage))
        return [(licence, name, coverage, first, end) for first, end, licence, name, coverage in kept]


def _runs(passages: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, end, aligned, misses) of passages ``(first, number, end, aligned,
    misses)`` that follow each other in a licence, passages left out between them
    aside. Of alignments of one passage that overlap, the best is meant."""
    best: list[tuple[int, int, int, int, int]] = []
    for p in passages:
        if best and best[-1][1] == p[1] and p[0] < best[-1][2]:
            if (p[3] - p[4], -p[0]) > (best[-1][3] - best[-1][4], -best[-1][0]):
                best[-1] = p
        else:
            best.append(p)
    out: list[list[int]] = []
    number = -1
    for first, k, end, aligned, misses in best:
        if out and k > number and 0 <= first - out[-1][1] + BAND and first - out[-1][1] <= (k - number) * PASSAGE:
            out[-1] = [out[-1][0], max(end, out[-1][1]), out[-1][2] + aligned, out[-1][3] + misses]
        else:
            out.append([first, end, aligned, misses])
        number = k
    return [tuple(r) for r in out]


def align(own: list[bytes], words: list[bytes], low: int, high: int, least: float) -> list[tuple[int, int, int, int]]:
    """Local alignments of a template in the document positions within a band of
    diagonals, with ``least`` aligned words: (aligned words, misses inside, first
    word, word after the last), the best for each end.

    A miss is an unaligned word of either side between aligned ones; the score is
    aligned words less misses, and fewer misses win among equal scores.
    """
    none = (0, 0, 0, -1)  # score, -misses, aligned, first
    ends: dict[int, tuple[int, int, int, int]] = {}
    before: dict[int, tuple[int, int, int, int]] = {}
    for i, word in enumerate(own):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            cell = none
            matched = word == words[j]
            if matched:
                s = before.get(j - 1, none)
                cell = (s[0] + 1, s[1], s[2] + 1, s[3] if s[0] else j)
            for s in (before.get(j, none), row.get(j - 1, none)):
                if s[0] > 1 and (s[0] - 1, s[1] - 1) > cell[:2]:
                    cell = (s[0] - 1, s[1] - 1, s[2], s[3])
                    matched = False
            if cell[0] > 0:
                row[j] = cell
                if matched and cell[2] >= least and cell[:2] > ends.get(j, none)[:2]:
                    ends[j] = cell
        before = row
    return [(aligned, -misses, first, j + 1) for j, (_, misses, aligned, first) in sorted(ends.items())]


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Code-point offsets of the words."""
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[m.start()]), int(lead[m.end()])) for m in _WORD.finditer(text.translate(_FOLD))]


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), source: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """A row per report: ``keep``, ``license``, ``template``, ``coverage``, ``start``,
    ``end``. ``source`` replaces the templates, as ``templates`` gives them."""
    some = docs.select(*keep, F.col(f"`{text_col}`").alias(fresh("__text", docs)))
    schema = some.drop(some.columns[-1]).schema
    for name, kind in (("license", "string"), ("template", "string"), ("coverage", "double"), ("start", "long"), ("end", "long")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(source or templates())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in slices(batches):
            last = batch.num_columns - 1
            rows, found = [], []
            for k, text in enumerate(texts(batch.column(last))):
                if reports := index.reports(text):
                    offsets = word_offsets(text)
                    for licence, name, coverage, first, end in reports:
                        rows.append(k)
                        found.append((licence, name, coverage, offsets[first][0], offsets[end - 1][1]))
            kept = batch.select(list(range(last))).take(pa.array(rows, pa.int64()))
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=schema.fieldNames())

    return some.mapInArrow(run, schema)
