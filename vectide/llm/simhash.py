"""SimHash near-duplicates: fingerprints and their links within a Hamming distance.

Search is a generalised pigeonhole. The 64 bits are grouped into partitions of
correlated bits; partition i gets a threshold T[i] (-1: not probed) with
sum(T) = distance - partitions + 1, so that two fingerprints within the distance
agree within T[i] on at least one probed partition. The thresholds come from a
dynamic program over estimated candidate counts. Every distinct fingerprint is
indexed under its value in each probed partition and probes all values within
T[i]; candidates are verified by the Hamming distance of the whole fingerprints.

A bucket with more than ``dense`` entries is not expanded into pairs. Its
members are linked exactly by shared ball points instead: for distance 2, two
fingerprints are within 2 bits if and only if some word is within 1 bit of
both, so grouping members by their 65 words within 1 bit and linking each group
to its smallest member gives the same components, with rows linear in members.

Defined results: a null or blank text has fingerprint zero; repeated rows share
a fingerprint; an empty table gives an empty result; null doc_ids are carried
and never name a component unless every member's is null. Columns other than
the id and text columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import slices, texts
from vectide.llm.components import connected_components
from vectide.sources.tables import fresh, remove, written

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: bytes) -> bytes:
    return text.translate(_LOWER)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit majority fingerprint of the word shingles of UTF-8 bytes."""
    words = lowered(text).split()
    if not words:
        return 0
    width = min(width, len(words))
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = b"".join([digest(join(t), seed) for t in zip(*[words[i:] for i in range(width)])])
    return majorities(hashes)


def majorities(hashes: bytes) -> int:
    """The fingerprint, as a signed 64-bit number, of big-endian hashes of shingles."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(rows), 60_000):
        ones += np.unpackbits(rows[start : start + 60_000], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, [keep...], fp)`` per row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last = batch.num_columns - 1
            made = pa.array([fingerprint(t) for t in texts(batch.column(last))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(last)], made], names=[*batch.schema.names[:last], "fp"])

    some = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))
    schema = some.drop("__text").schema.add("fp", "long")
    return some.mapInArrow(run, schema)


def hex_of(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- the plan: correlated partitions, candidate estimates, thresholds ----


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bit pairs set together.

    Over all fingerprints; every task returns one 64 x 64 table and these are
    summed by cell, so the driver gets 4,096 numbers at any scale.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})

    cells = prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(BITS * BITS)
    for r in cells:
        together[r["cell"]] = r["n"]
    return prints.count(), together.reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the most significant) in ``parts`` groups of nearly equal size,
    grown greedily by mean absolute correlation."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    alike = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: alike[b, sorted(left)].sum())
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: alike[b, group].mean())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _part_value(fp, bits: list[int]) -> F.Column:
    """The fingerprint with all but the partition's bits cleared."""
    return fp.bitwiseAND(F.lit(_mask(bits)).cast("long"))


def _mask(bits) -> int:
    m = sum(1 << (BITS - 1 - b) for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def plan_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Dynamic program: thresholds of least summed cost with the given total.

    ``costs[i][t]`` is the estimated cost of partition i at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for table in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in table.items():
                option = (cost + c, [*chosen, t])
                if used + t not in following or option < following[used + t]:
                    following[used + t] = option
        best = following
    return best[total]


def choose_plan(prints: DataFrame, distance: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """``[(bits, threshold)]`` of the probed partitions, over all fingerprints.

    For each number of partitions, the collisions at threshold 0 are counted
    exactly by value; each further differing bit multiplies the estimate by the
    odds, from the bit frequencies, that one more bit differs. To the candidates
    come the index and probe rows themselves.
    """
    n, together = bit_statistics(prints)
    share = np.diag(together) / max(n, 1)
    odds = 2 * share * (1 - share)
    odds = odds / np.maximum(1 - odds, 1e-9)
    schemes = {m: correlated_groups(n, together, m) for m in range(2, most_parts + 1)}
    flat = [(m, i, bits) for m, groups in schemes.items() for i, bits in enumerate(groups)]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _part_value(F.col("fp"), bits).alias("v")) for k, (_, _, bits) in enumerate(flat)])).alias("x")
    same = prints.select(values).select("x.*").groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()
    pairs = {r["k"]: r["pairs"] for r in same}
    costs: dict[int, list[dict[int, float]]] = {m: [] for m in schemes}
    for k, (m, _, bits) in enumerate(flat):
        table, reached, probes, step = {-1: 0.0}, pairs.get(k, 0.0), 1.0, 1.0
        for t in range(distance + 1):
            if t:
                step *= odds[bits].sum() / t
                reached += pairs.get(k, 0.0) * step
                probes += float(np.prod([len(bits) - j for j in range(t)]) / np.prod(range(1, t + 1)))
            table[t] = reached + n * (1 + probes)
        costs[m].append(table)
    _, m, thresholds = min((*plan_thresholds(costs[m], distance - m + 1)[:1], m, plan_thresholds(costs[m], distance - m + 1)[1]) for m in schemes)
    return [(bits, t) for bits, t in zip(schemes[m], thresholds) if t >= 0]


# ---- probe, verify, link ----


def _flips(bits, radius: int) -> list[int]:
    """Masks of all ways to change 1 to ``radius`` of the bits."""
    return [_mask(c) for r in range(1, radius + 1) for c in itertools.combinations(bits, r)]


def near_links(prints: DataFrame, distance: int = 2, dense: int = 32) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints of ``prints(fp)``, such that
    the components are those of all pairs within ``distance`` bits, which is even."""
    if distance % 2:
        raise ValueError("the distance must be even")
    plan = choose_plan(prints, distance)
    keys = []
    for k, (bits, t) in enumerate(plan):
        value = _part_value(F.col("fp"), bits)
        for m in [0, *_flips(bits, t)]:
            key = value.bitwiseXOR(F.lit(m).cast("long"))
            keys.append(F.struct(F.lit(k).alias("part"), key.alias("key"), F.lit(m == 0).alias("indexed")))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.*")
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("indexed").alias("held")).where("n > 1 and held > 0").drop("held")
    rows = written(rows.join(sizes, ["part", "key"]), "buckets")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    left = rows.where(f"indexed and n <= {dense}").select("part", "key", F.col("fp").alias("a"))
    right = rows.where(f"n <= {dense}").select("part", "key", F.col("fp").alias("b"))
    verified = left.join(right, ["part", "key"]).where((F.col("a") != F.col("b")) & near("a", "b")).select("a", "b")

    # Dense buckets: words within half the distance of a member.
    members = rows.where(f"n > {dense}").select("fp").distinct()
    ball = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in _flips(range(BITS), distance // 2)]))
    points = members.select("fp", ball.alias("word"))
    centres = points.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    through = points.join(centres, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return verified.unionByName(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, [keep...], fp, root, component_id)`` per row of ``docs``.

    Fingerprints within ``distance`` bits link; root is the smallest fingerprint
    reachable and component_id the smallest id.
    """
    printed = written(fingerprints(docs, id_col, text_col, keep), "prints")
    distinct = written(printed.groupBy("fp").agg(F.min("id").alias("least")), "distinct", narrow=True)
    roots = connected_components(near_links(distinct.select("fp"), distance), "a", "b")
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(named, "root").select("fp", "root", "component_id")
    return printed.join(labels, "fp").select("id", *keep, "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each group: that with the
    smallest id (then row hash; of rows alike in every column, one). All columns stay."""
    rows, tag = tagged(docs)
    found = near_duplicates(rows, id_col, text_col, distance, keep=(tag,))
    return least_of_each(docs, rows, tag, found.select("id", tag, F.col("root").alias("by")), id_col)


def tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of each row, nulls and their places included, and the
    name of that column, which no column of ``docs`` has."""
    tag = fresh("__row", docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(tag, F.xxhash64(*[x for c in own for x in (c.cast("string"), c.isNull())])), tag


def least_of_each(docs: DataFrame, rows: DataFrame, tag: str, found: DataFrame, id_col: str, roots: DataFrame | None = None) -> DataFrame:
    """``docs``, tagged as ``rows``, less all but the least of each group of
    ``found(id, <tag>, by)``; groups of one root in ``roots(node, root)`` are one.

    The least of a group is taken before roots are joined, so that a group with a
    third of all rows is one row by then."""
    one = found.select("by", F.struct(F.col("id").isNull().alias("u"), "id", F.col(tag).alias("row")).alias("x"))
    chosen = one.groupBy("by", "x").agg(F.count("*").alias("n")).groupBy("by").agg(F.min(F.struct("x", "n")).alias("y"))
    if roots is not None:
        chosen = chosen.join(roots, F.col("by") == F.col("node"), "left").groupBy(F.coalesce("root", "by").alias("by")).agg(F.min("y").alias("y"))
    names = [fresh(c, rows) for c in ("__id", "__r", "__n")]
    chosen = written(chosen.select(F.col("y.x.id").alias(names[0]), F.col("y.x.row").alias(names[1]), F.col("y.n").alias(names[2])), "kept", narrow=True)
    match = (F.col(tag) == F.col(names[1])) & F.col(f"`{id_col}`").eqNullSafe(F.col(names[0]))
    once = rows.join(chosen.where(f"{names[2]} = 1"), match, "left_semi")
    again = rows.join(chosen.where(f"{names[2]} > 1"), match, "left_semi").dropDuplicates([tag, id_col])
    return once.unionByName(again).drop(tag)
