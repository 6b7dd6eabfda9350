"""Repetition coverage of whole texts, and a verdict.

Words are numbered within a text; rolling hashes over those numbers give, in
numpy, the hash of every window of each length, and sorting them finds the
windows seen before. What counts for a length is the share of the text's word
characters that lie inside windows seen before (the first occurrence is free),
and likewise for whole lines seen before. The limits are the published ones for
web text: the longer the window, the less of it may repeat.

Defined results: a null text has no words; an empty one too; lines without a
word are no lines here; repeated rows are measured alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm.common import slices, texts

#: Most share of characters in repeated windows, by window length.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
SYMBOL_LIMIT = 0.10
_SYMBOLS = b"#*$%&|<>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether another equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    later[order[1:][same]] = True
    return shared, later


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside the windows that begin where ``starts`` is set."""
    edge = np.zeros(n + 1, np.int64)
    edge[: len(starts)] += starts
    edge[width : width + len(starts)] -= starts
    return np.cumsum(edge[:n]) > 0


def _triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """One exact key for each three-word window."""
    if distinct < 1 << 21:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    _, pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    return pairs[:-1] * distinct + ids[2:]


def measure(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    share of characters in repeated windows by length, and in repeated lines)."""
    words = text.split()
    n, symbols = len(words), len(text) - len(text.translate(None, _SYMBOLS))
    if not n:
        return 0, 0, symbols, 0, 0, [0.0] * len(LIMITS), 0.0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    lengths = np.fromiter((len(w.decode()) for w in number), np.int64, len(number))[ids]
    total = int(lengths.sum())

    seen: set[bytes] = set()
    dup_lines = line_chars = dup_chars = 0
    for line in text.split(b"\n"):
        if line.strip():
            size = len(line)
            line_chars += size
            if line in seen:
                dup_lines += 1
                dup_chars += size
            seen.add(line)

    repeat_words, shares = 0, []
    if n >= 3 and len(number) < n:
        shared, _ = _runs(_triples(ids, len(number)))
        repeat_words = int(_covered(shared, 3, n).sum()) if shared.any() else 0
    if repeat_words:  # a longer window that repeats holds a repeated triple
        base = rolled = _mixed(ids)
        for width in range(2, max(LIMITS) + 1):
            if n < width:
                rolled = rolled[:0]
            else:
                rolled = rolled[:-1] * _MULTIPLIER + base[width - 1 :]
            if width in LIMITS:
                _, later = _runs(rolled) if len(rolled) else (None, np.zeros(0, bool))
                shares.append(float(lengths[_covered(later, width, n)].sum() / total) if later.any() else 0.0)
    return n, total, symbols, dup_lines, repeat_words, shares or [0.0] * len(LIMITS), dup_chars / line_chars


def score(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the base counts, ``window_shares`` (by length, in the
    order of LIMITS), ``line_share``, ``base_failed`` and ``kept``."""
    some = docs.select(*keep, F.col(text_col).alias("__text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = some.drop("__text").schema
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("window_shares", T.ArrayType(T.DoubleType())).add("line_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last = batch.num_columns - 1
            found = list(zip(*map(measure, texts(batch.column(last))))) or [[]] * 7
            made = [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(found[5], pa.list_(pa.float64())), pa.array(found[6], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *made], names=schema.fieldNames())

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = [F.col("window_shares")[k] <= limit for k, limit in enumerate(LIMITS.values())]
    verdict = F.col("line_share") <= LINE_LIMIT
    for w in within:
        verdict &= w
    verdict &= F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words")
    return some.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


_SQL_LIMITS = ", ".join(f"({width}, {limit})" for width, limit in LIMITS.items())

_SQL_LEADS = ", ".join(f"lead(word, {k}) over o as l{k}" for k in range(1, max(LIMITS)))
_SQL_WINDOWS = " union all ".join(
    f"select r, {n} as size, p as i, row_number() over (partition by r, {', '.join(f'l{k}' for k in range(n))} order by p) as k from following where l{n - 1} is not null"
    for n in LIMITS
)

#: The query of op7 in SQL: windows by the words that follow, positions by unnesting.
SQL = rf"""
with docs as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), words as materialized (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
totals as (select r, cast(sum(length(word)) as bigint) as word_chars from words group by r),
lines as (
  select r, cast(count(*) - count(distinct line) as bigint) as n_dup_lines,
         (sum(strlen(line)) - sum(strlen(line)) filter (where k = 1)) / sum(strlen(line)) as line_share
  from (select r, line, row_number() over (partition by r, line) as k from (select r, unnest(string_split(text, chr(10))) as line from docs)
        where regexp_matches(line, '[^\x20\x09-\x0D]')) group by r
), following as materialized (
  select r, p, word as l0, {_SQL_LEADS} from words window o as (partition by r order by p)
), triples as (
  select r, p as i, count(*) over (partition by r, l0, l1, l2) as n from following where l2 is not null
), repeats as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 3)) as p from triples where n > 1) group by r),
limits(size, most) as (values {_SQL_LIMITS}),
windows as (
  {_SQL_WINDOWS}
), inside as (select distinct r, size, p from (select r, size, unnest(range(i, i + size)) as p from windows where k > 1)),
shares as (
  select i.r, i.size, sum(length(word)) / any_value(word_chars) as share from inside i join words using (r, p) join totals on totals.r = i.r group by i.r, i.size
), over_limit as (select distinct r from shares join limits using (size) where share > most),
counted as (
  select docs.r, doc_id, cast(len(w) as bigint) as n_words, coalesce(word_chars, 0) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(line_share, 0) as line_share
  from docs left join totals using (r) left join lines using (r) left join repeats using (r)
), judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and line_share <= {LINE_LIMIT} and n_symbols <= {SYMBOL_LIMIT} * n_words and r not in (select r from over_limit) as kept
from judged
"""
