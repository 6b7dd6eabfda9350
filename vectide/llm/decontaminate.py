"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all benchmark items (ASCII case
folded, words of ASCII letters and digits and everything beyond ASCII). A
document's words are streamed through it; the state after each word gives the
longest run of words, ending there, that occurs in some item. A run that
reaches the window length, or that is a whole shorter item, is a hit.

Automata are built for blocks of at most ``block_words`` item words, so that
what is sent to the executors is bounded, once in each Python worker. A larger
benchmark makes a pass over the texts for each block; a pass writes only the hits
of the texts that have any, under a hash of the text, and these are joined to the
documents at the end. No pass writes a document.

Defined results: null has no words; an item without words has no window; an
item that is repeated, or whose id is null, hits like any other, and ids count
once, null as the empty string; repeated documents are scored alike.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import slices, texts
from vectide.sources.tables import fresh, written

WINDOW = 10
#: Maps A-Z to a-z and every byte that is no part of a word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        # The windows: their states, and there their lengths and items.
        windows: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, ids in coded:
            size, state = min(len(ids), window), 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    windows[state][size].add(name)
        self.windows = {s: sorted(w.items()) for s, w in windows.items()}
        # Nearest state with a window, on the way up from each state.
        self.nearest = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.windows else self.nearest[self.link[s]] if self.link[s] > 0 else -1

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest run and c, split off from a longer one if needed."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        made, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c)
        return made

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans (start, end) of window occurrences, and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        occurring: set[tuple[int, int]] = set()
        n = len(words)
        if not self.shortest or n < self.shortest:
            return spans, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        gaps = np.concatenate(([-1], np.flatnonzero(ids < 0), [n]))
        long_enough = np.flatnonzero(np.diff(gaps) > self.shortest)
        moves, link, length, nearest, windows = self.next, self.link, self.length, self.nearest, self.windows
        for g in long_enough:
            first = int(gaps[g]) + 1
            state = depth = 0
            for at, c in enumerate(ids[first : gaps[g + 1]].tolist(), first + 1):
                following = moves[state].get(c)
                while following is None:
                    state = link[state]
                    if state < 0:
                        break
                    depth = length[state]
                    following = moves[state].get(c)
                if following is None:
                    state = depth = 0
                    continue
                state, depth = following, depth + 1
                found = nearest[state]
                while found > 0:
                    for size, _ in windows[found]:
                        if size <= depth:
                            occurring.add((found, size))
                            if spans and spans[-1][1] >= at - size:
                                spans[-1] = (min(spans[-1][0], at - size), at)
                            else:
                                spans.append((at - size, at))
                    found = nearest[link[found]] if link[found] > 0 else -1
        for state in {state for state, _ in occurring}:
            for size, names in windows[state]:
                if (state, size) in occurring:
                    items |= names
        return _merged(spans), items


_BUILT: dict[str, Automaton] = {}
_RELEASE: list[threading.Timer] = []
#: Seconds that an idle Python worker keeps an automaton.
HELD_SECONDS = 20.0


def _built(key: str, block: Broadcast, window: int) -> Automaton:
    """The automaton of a block, kept in this Python worker for its next tasks."""
    for timer in _RELEASE:
        timer.cancel()
    _RELEASE[:] = [threading.Timer(HELD_SECONDS, _BUILT.clear)]
    _RELEASE[0].daemon = True
    _RELEASE[0].start()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(block.value, window)
    return _BUILT[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _block_count(items: DataFrame, text_col: str, block_words: int) -> int:
    size = items.agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit(""))) / 4 + 1)).first()[0] or 0
    return max(1, -(-int(size) // block_words))


def _blocks(items: DataFrame, id_col: str, text_col: str, count: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks by a hash of their text, one collected at a time."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    for k in range(count):
        part = named.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).orderBy("name", "text").collect()
        yield [(r["name"], words_of(r["text"].encode())) for r in part]


_SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW_NAMES = pa.list_(pa.string())


def _as_spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in spans] for spans in found], _ARROW_SPANS)


Finish = Callable[[pa.RecordBatch, list[int], list[list[tuple[int, int]]], list[list[str]]], pa.RecordBatch]


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = 150_000, into: tuple[str, str, str] = ("n_words", "hits", "items")) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (array of word spans, merged) and
    ``items`` (sorted ids), or as named by ``into``; columns so named are replaced."""
    state = docs.drop(*into)
    schema = T.StructType(list(state.schema)).add(into[0], "long").add(into[1], _SPANS).add(into[2], T.ArrayType(T.StringType()))

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list[list[tuple[int, int]]], names: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), _as_spans(spans), pa.array(names, _ARROW_NAMES)], names=schema.fieldNames())

    return _matched(state, items, text_col, item_id, item_text, window, block_words, schema, finish)


def _matched(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_words: int, schema: T.StructType, finish: Finish) -> DataFrame:
    """What ``finish`` makes of each batch of ``docs`` and its word counts, spans and items."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    count = _block_count(items, item_text, block_words)
    blocks = ((uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in _blocks(items, item_id, item_text, count))
    if count == 1:
        key, shared = next(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _built(key, shared, window)
            for batch in slices(batches):
                words = [words_of(t) for t in texts(batch.column(at))]
                found = [automaton.match(w) for w in words]
                yield finish(batch, list(map(len, words)), [spans for spans, _ in found], [sorted(ids) for _, ids in found])

        return docs.mapInArrow(run, schema)

    found = _hits_by_text(docs, text_col, blocks, window)
    hashed, spans, names = (fresh(c, docs) for c in ("__hash", "__spans", "__names"))
    found = found.select(F.col("hash").alias(hashed), F.col("hits").alias(spans), F.col("items").alias(names))
    joined = docs.withColumn(hashed, _text_hash(text_col)).join(found, hashed, "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans, names)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [len(words_of(t)) for t in texts(batch.column(at))]
            merged = [_merged([(x["start"], x["end"]) for part in h or () for x in part]) for h in batch.column(batch.num_columns - 2).to_pylist()]
            ids = [sorted({x for part in n or () for x in part}) for n in batch.column(batch.num_columns - 1).to_pylist()]
            yield finish(batch.select(list(range(batch.num_columns - 2))), counts, merged, ids)

    return joined.mapInArrow(run_joined, schema)


def _text_hash(text_col: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)


def _hits_by_text(docs: DataFrame, text_col: str, blocks: Iterator[tuple[str, Broadcast]], window: int) -> DataFrame:
    """``(hash, hits, items)``: for each text with hits, those of every block, one list a block."""
    some = docs.select(_text_hash(text_col).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    parts = []
    for key, shared in blocks:

        def run(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _built(key, shared, window)
            for batch in slices(batches):
                rows, spans, names = [], [], []
                for k, text in enumerate(texts(batch.column(1))):
                    found, ids = automaton.match(words_of(text))
                    if found:
                        rows.append(k)
                        spans.append(found)
                        names.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), _as_spans(spans), pa.array(names, _ARROW_NAMES)], names=["hash", "hits", "items"])

        schema = T.StructType().add("hash", "string").add("hits", _SPANS).add("items", T.ArrayType(T.StringType()))
        # Copies of a text have the same hits: one of them is enough.
        parts.append(written(some.mapInArrow(run, schema).dropDuplicates(["hash"]), "hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("hash").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def remove_hits(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, nor what lies between them."""
    data = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = 150_000, most_coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans in the text; documents of which more than
    ``most_coverage`` of the words are hit go. Documents without a hit are unchanged.
    Texts are matched and cut in one pass, in one Python worker a task."""
    at = docs.columns.index(text_col)

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list[list[tuple[int, int]]], names: list[list[str]]) -> pa.RecordBatch:
        if not any(spans):
            return batch
        kept = [k for k, s in enumerate(spans) if sum(b - a for a, b in s) <= most_coverage * counts[k]]
        batch = batch.take(pa.array(kept, pa.int64()))
        columns = list(batch.columns)
        columns[at] = pa.array([remove_hits(t, spans[k]) if spans[k] else t for k, t in zip(kept, columns[at].to_pylist())], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return _matched(docs, items, text_col, item_id, item_text, window, block_words, docs.schema, finish)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The query of op4 in SQL: windows of both sides as joined words, matched by equality.
SQL = f"""
with docs as materialized (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
items as (select coalesce(item_id::varchar, '') as item, {_SQL_WORDS} as w from benchmark),
item_windows as materialized (
  select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select item, w, least(len(w), {WINDOW}) as size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from items where len(w) > 0)
), doc_windows as (
  select r, i, size, array_to_string(w[i:i + size - 1], ' ') as g
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from item_windows) where len(w) >= size)
), hits as materialized (select r, i, size, item from doc_windows join item_windows using (size, g)),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hits) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (r) left join hit_items using (r)
"""
