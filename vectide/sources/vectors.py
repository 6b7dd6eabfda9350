"""Sources and sinks of vectors: Parquet tables, text, ``.npy``, JSON side-cars,
and a synthetic generator.

Vectors are rows of (vec_id, embedding). The identity is an explicit column.
"""

from __future__ import annotations

import ast
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.sources.files import listed, opened, rows_of

DOCUMENTS = [
    "Rivers carry water from the hills to the sea.",
    "A lighthouse warns ships of rocks along the coast.",
    "Honey keeps for years when the jar stays closed.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(vectors: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """``vectors``; reading a row of another length, or without a vector, fails."""
    fits = F.coalesce(F.size(column) == dimensions, F.lit(False))
    message = F.concat(F.lit(f"a vector needs {dimensions} dimensions, not "), F.coalesce(F.size(column).cast("string"), F.lit("null")))
    return vectors.withColumn(column, F.when(fits, F.col(column)).otherwise(F.raise_error(message)))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One vector per line, elements apart by white space; ``#`` starts a comment.
    Ids are positions over the files in order of their names: every block of a file
    counts its lines, and what comes before a block is added to its own positions."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("value", "#.*", ""))).where("line <> ''")
    rows = lines.select("file", "start", "line", F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    offsets = blocks.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    found = rows.join(offsets, ["file", "start"])
    return found.select((F.col("at") + F.col("offset")).alias("vec_id"), F.transform(F.split("line", r"\s+"), lambda v: v.cast("float")).alias("embedding"))


def _npy_header(head: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """(dtype, shape, offset of the data) of a ``.npy`` file."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
    fields = ast.literal_eval(head[at : at + size].decode("latin-1"))
    if fields["fortran_order"]:
        raise ValueError("only row-major .npy files are read")
    return np.dtype(fields["descr"]), fields["shape"], at + size


def _read_matrices(spark: SparkSession, files: list[tuple[str, np.dtype, int, int, int]], part_bytes: int) -> DataFrame:
    """Vectors of row-major matrices ``(path, type, offset of the data, rows,
    dimensions)``, a task for every ``part_bytes`` of a file."""
    parts = []
    for path, kind, at, n, d in files:
        step = max(1, part_bytes // max(1, kind.itemsize * d))
        parts += [(path, kind.str, at, d, first, min(step, n - first)) for first in range(0, n, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            kind, d = np.dtype(part["kind"]), part["d"]
            step = max(1, PART_BYTES // 8 // max(1, kind.itemsize * d))
            system, place = opened(part["path"])
            with system.open_input_file(place) as file:
                file.seek(part["at"] + part["first"] * d * kind.itemsize)
                for start in range(0, part["n"], step):
                    n = min(step, part["n"] - start)
                    data = file.read(n * d * kind.itemsize)
                    if len(data) < n * d * kind.itemsize:
                        raise ValueError(f"{part['path']} ends before its last row")
                    some = np.frombuffer(data, kind).reshape(n, d).astype(np.float32)
                    ids = pa.array(np.arange(part["first"] + start, part["first"] + start + n), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, list_array(some)], names=["vec_id", "embedding"])

    described = spark.createDataFrame(parts, "path string, kind string, at long, d int, first long, n long")
    return described.repartitionByRange(max(1, len(parts)), "path", "first").mapInArrow(run, "vec_id long, embedding array<float>")


#: Bytes of a matrix that a task reads.
PART_BYTES = 128 << 20


def read_npy(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Vectors of ``.npy`` matrices (a vector is one row); ids are positions in the
    file. Files are read in ranges of rows, whatever their size."""
    files = []
    for r in listed(spark, path).orderBy("path").toLocalIterator():
        system, place = opened(r["path"])
        with system.open_input_file(place) as file:
            kind, shape, at = _npy_header(file.read(1 << 16))
        files.append((r["path"], kind, at, *(shape if len(shape) == 2 else (1, *shape))))
    return _read_matrices(spark, files, part_bytes)


def read_raw(spark: SparkSession, path: str, dimensions: int, kind: str = "float32", part_bytes: int = PART_BYTES) -> DataFrame:
    """Vectors of raw row-major matrices without a header, as memory maps read them;
    ids are positions in the file."""
    row = np.dtype(kind).itemsize * dimensions
    files = []
    for r in listed(spark, path).orderBy("path").toLocalIterator():
        if r["length"] % row:
            raise ValueError(f"{r['path']} has no whole number of rows of {dimensions}")
        files.append((r["path"], np.dtype(kind), 0, r["length"] // row, dimensions))
    return _read_matrices(spark, files, part_bytes)


def write_npy(vectors: DataFrame, path: str, rows_per_file: int = 1000, vector_col: str = "embedding") -> int:
    """Writes the vectors as ``.npy`` files of float32 below ``path`` and returns how
    many rows there are. Names follow the table's partitions, so a task that runs
    again replaces its own files; for an order, sort first."""
    system, place = opened(path)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(path)
        number, held = 0, []

        def write(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            buffer = io.BytesIO()
            np.save(buffer, rows)
            name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{number:06d}.npy"
            attempt = f"{folder}/_{uuid.uuid4().hex}"
            with files.open_output_stream(attempt) as out:
                out.write(buffer.getvalue())
            files.move(attempt, name)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_file):
                held.append(matrix(batch.slice(start, rows_per_file).column(0)).astype(np.float32))
                while sum(map(len, held)) >= rows_per_file:
                    rows = np.concatenate(held)
                    held = [rows[rows_per_file:]]
                    yield write(rows[:rows_per_file])
        if sum(map(len, held)):
            yield write(np.concatenate(held))

    found = vectors.where(F.col(vector_col).isNotNull()).select(vector_col).mapInArrow(run, "n long")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def to_npy(vectors: DataFrame, rows_per_part: int = 1000, vector_col: str = "embedding") -> DataFrame:
    """``(part, content)``: the vectors in blocks, each a whole ``.npy`` file of
    float32. Blocks follow the table's partitions; for an order, sort first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_part):
                buffer = io.BytesIO()
                np.save(buffer, matrix(batch.slice(start, rows_per_part).column(0)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary())], names=["content"])

    return vectors.select(vector_col).mapInArrow(run, "content binary").select(F.monotonically_increasing_id().alias("part"), "content")


def list_array(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix of doubles. A null element is NaN; a null
    vector, or vectors of different lengths, are an error."""
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = pc.list_value_length(column)
    least, most = pc.min(sizes).as_py(), pc.max(sizes).as_py()
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} dimensions")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), most)


def read_config(spark: SparkSession, path: str) -> dict:
    """The JSON side-car of a matrix: n, d, a_file, x_file, k (and k_1, k_2)."""
    return spark.read.option("multiLine", True).json(path).first().asDict()


@dataclass
class Workload:
    """What a search or clustering runs on; ``clusters`` and ``probes`` for an index."""

    vectors: DataFrame
    query: list[float] | None
    k: int
    clusters: int | None = None
    probes: int | None = None


def _read_any(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    if path.endswith(".npy"):
        return read_npy(spark, path)
    if path.endswith((".txt", ".csv")):
        return read_text(spark, path)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_raw(spark, path, dimensions)


def workload(spark: SparkSession, path: str) -> Workload:
    """The workload that a JSON side-car describes; file names are relative to it.
    Vectors of other dimensions fail when they are read, another count at once."""
    config = read_config(spark, path)
    place = lambda name: name if "://" in name or name.startswith("/") else f"{path.rsplit('/', 1)[0]}/{name}"
    vectors = checked(_read_any(spark, place(config["a_file"]), config["d"]), config["d"])
    found = vectors.select("vec_id").count()
    if found != config["n"]:
        raise ValueError(f"{config['a_file']} has {found} vectors, not {config['n']}")
    query = None
    if config.get("x_file"):
        query = list(checked(_read_any(spark, place(config["x_file"]), config["d"]), config["d"]).orderBy("vec_id").first()["embedding"])
    return Workload(vectors, query, config["k"], config.get("k_1"), config.get("k_2"))


#: Rows, dimensions, k, clusters and probes of the random workloads.
RANDOM = {"kmeans": (100_000, 2, 10, None, None), "knn": (1_000, 100, 10, None, None), "ann": (100_000, 1024, 10, 256, 100)}


def random_workload(spark: SparkSession, name: str, seed: int = 42) -> Workload:
    """Standard normal vectors, and but for K-means a query, for a search or clustering."""
    n, d, k, clusters, probes = RANDOM[name]
    query = None if name == "kmeans" else list(synthetic(spark, 1, d, seed + 1, "normal").first()["embedding"])
    return Workload(synthetic(spark, n, d, seed, "normal"), query, k, clusters, probes)


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 42, kind: str = "uniform") -> DataFrame:
    """``n`` random vectors: uniform in [0, 1) or standard normal. The values depend
    on the seed, the id and the position alone, not on partitioning: 52 bits of the
    MD5 of ``seed|id|position|draw``."""
    if kind not in ("uniform", "normal"):
        raise ValueError(f"unknown kind {kind!r}")
    drawn = lambda i, salt: F.substring(F.md5(F.concat_ws("|", F.lit(seed), "vec_id", i, F.lit(salt))), 1, 13)
    unit = lambda i, salt: (F.conv(drawn(i, salt), 16, 10).cast("double") + 0.5) / float(1 << 52)
    if kind == "uniform":
        value = lambda i: unit(i, 0)
    else:
        value = lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * np.pi * unit(i, 1))
    ids = spark.range(n).withColumnRenamed("id", "vec_id")
    return ids.select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: value(i).cast("float")).alias("embedding"))


def documents(spark: SparkSession, texts: list[str] | None = None) -> DataFrame:
    """A small in-memory document table; ids are positions."""
    return spark.createDataFrame(list(enumerate(texts if texts is not None else DOCUMENTS)), "doc_id long, text string")
