"""Byte-level BPE over a whole corpus by a global shuffle of distinct words.

1. Documents are cut into pre-tokens in blocks of some MB. A block is one row:
   its distinct words, and for each document the word number at each position.
   This is a written table, bucketed by block, as both later steps read it.
2. The blocks' words are exploded and shuffled by word. All rows of a word meet
   as one run; it is encoded once, and its ids go to each of its (block, word
   number) rows. A word occurs at most once a block, so no word is hot.
3. The ids go back to their blocks, many words to a row, and documents are reassembled by position.
   Decoding looks every id up in the token-byte table, of the size of the rank
   file.

Defined results: a null text is empty; an empty text has no ids and the digest
of nothing; repeated rows and ids are kept as they are; further columns are
carried only where asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from vectide.sources.tables import written_by

BLOCK_CHARS = 32 << 20
PACK_ROWS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _encode_long(parts, ranks)
    get, top = ranks.get, len(ranks) + 1
    pairs = [get(a + b, top) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == top:
            break
        k = pairs.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = get(parts[k] + parts[k + 1], top)
        if k:
            pairs[k - 1] = get(parts[k - 1] + parts[k], top)
    return [ranks[p] for p in parts]


def _encode_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for very long pre-tokens."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
    return [ranks[p] for p in parts if p]


def _packed(*arrays) -> bytes:
    """Arrays of small numbers by byte plane, which packs them well."""
    arrays = [np.asarray(x, "<u4") for x in arrays]
    packer = zstandard.ZstdCompressor(level=1).compressobj()
    out = [packer.compress(np.array([len(arrays), *map(len, arrays)], "<u4").tobytes())]
    for x in arrays:
        for k in range(4):
            out.append(packer.compress(x.view(np.uint8)[k::4].tobytes()))
    return b"".join([*out, packer.flush()])


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), np.uint8)
    sizes = raw[4 : 4 + 4 * int(raw[:4].view("<u4")[0])].view("<u4")
    out, at = [], 4 + 4 * len(sizes)
    for n in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<u4").ravel())
        at += 4 * n
    return out


def blocks_of(docs: DataFrame, pattern: str, text_col: str, keep: tuple[str, ...], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``block``, ``words array<binary>`` (frequent ones first), ``codes`` (packed word
    numbers of all positions), ``docs array<struct<keep..., __n>>`` with their lengths."""
    some = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = some.drop("__text").schema
    row = fields.add("__n", "long")
    schema = T.StructType().add("block", "long").add("words", T.ArrayType(T.BinaryType())).add("codes", "binary").add("docs", T.ArrayType(row))
    docs_type = to_arrow_type(T.ArrayType(row), timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        number: dict[str, int] = {}
        held: list[dict] = []
        positions: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            codes = np.concatenate(positions)
            positions.clear()
            order = np.argsort(-np.bincount(codes, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            words = list(number)
            number.clear()
            columns = [
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([[words[i].encode() for i in order.tolist()]], pa.list_(pa.binary())),
                pa.array([_packed(rank[codes])], pa.binary()),
                pa.array([held], docs_type),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    text = r.pop("__text") or ""
                    codes = np.array([number.setdefault(w, len(number)) for w in find(text)], np.int32)
                    positions.append(codes)
                    held.append(r | {"__n": len(codes)})
                    size += len(text)
                    if size >= block_chars:
                        yield block()
                        size = 0
        if held:
            yield block()

    return some.mapInArrow(run, schema)


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids`` (if asked for), ``ids_sha256`` of the
    decimal ids joined by spaces, ``decoded_sha256`` of the decoded bytes.

    A block of text is what a task holds at once; larger blocks shuffle fewer words.
    ``rank_path`` is read by the driver; its table, of the vocabulary's size, is
    sent to the executors.
    """
    spark = docs.sparkSession
    table = load_ranks(rank_path)
    ranks = spark.sparkContext.broadcast(table)
    tokens = spark.sparkContext.broadcast(token_bytes(table))
    cut = written_by(blocks_of(docs, pattern, text_col, keep, block_chars), "blocks", "block")

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, word, coded = ranks.value, None, []
        parts: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
        held = 0

        def packs() -> pa.RecordBatch:
            columns = [pa.array(list(parts), pa.int64()), pa.array([_packed(*p) for p in parts.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["of", "entries"])

        for batch in batches:
            for w, of, code in zip(*(c.to_pylist() for c in batch.columns)):
                if w != word:
                    word, coded = w, encode_word(w, merges)
                codes, sizes, ids = parts[of]
                codes.append(code)
                sizes.append(len(coded))
                ids += coded
            held += batch.num_rows
            if held >= PACK_ROWS:
                yield packs()
                parts.clear()
                held = 0
        if parts:
            yield packs()

    numbered = cut.select(F.posexplode("words").alias("code", "word"), F.col("block").alias("of")).select("word", "of", "code")
    entries = numbered.repartition("word").sortWithinPartitions("word").mapInArrow(encode_runs, "of long, entries binary")

    fields = docs.select(*keep).schema.add("n_tokens", "long")
    if with_ids:
        fields = fields.add("ids", T.ArrayType(T.IntegerType()))
    fields = fields.add("ids_sha256", "string").add("decoded_sha256", "string")
    out_schema = to_arrow_schema(fields, timestamp_utc=True)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        token = tokens.value.__getitem__
        packs = [_unpacked(x) for x in right.column("entries").to_pylist()] or [_unpacked(_packed([], [], []))]
        codes, sizes, flat = (np.concatenate(x).astype(np.int64) for x in zip(*packs))
        ends = np.cumsum(sizes)
        counts, starts = np.empty_like(sizes), np.empty_like(sizes)
        counts[codes], starts[codes] = sizes, ends - sizes
        shown, decoded = np.empty(len(counts), object), np.empty(len(counts), object)
        for k, (a, n) in enumerate(zip(starts.tolist(), counts.tolist())):
            word = flat[a : a + n].tolist()
            shown[k] = " ".join(map(str, word))
            decoded[k] = b"".join(map(token, word))
        rows = []
        for docs_part, packed in zip(left.column("docs").to_pylist(), left.column("codes").to_pylist()):
            (positions,) = _unpacked(packed)
            at = 0
            for r in docs_part:
                n = r.pop("__n")
                mine = positions[at : at + n]
                at += n
                sizes = counts[mine]
                r["n_tokens"] = int(sizes.sum())
                if with_ids:
                    steps = np.arange(r["n_tokens"]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    r["ids"] = flat[np.repeat(starts[mine], sizes) + steps].astype(np.int32)
                r["ids_sha256"] = hashlib.sha256(" ".join(shown[mine].tolist()).encode()).hexdigest()
                r["decoded_sha256"] = hashlib.sha256(b"".join(decoded[mine].tolist())).hexdigest()
                rows.append(r)
        return pa.Table.from_pylist(rows, out_schema)

    return cut.select("block", "codes", "docs").groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(reassemble, fields)


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    """The bytes of a sequence of ids, by the table of ``token_bytes``."""
    return b"".join(map(tokens.__getitem__, ids))
