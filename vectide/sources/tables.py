"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a temporary folder; on a
    cluster a missing setting is an error, as no machine-local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vectide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


#: A narrow table has a file for so many shuffle partitions.
NARROW = 8


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back. A ``narrow``
    table, of a few numbers a row, goes into an eighth of the files that shuffles have
    partitions, though not fewer than there are cores.

    This cuts the lineage and survives the loss of executors. ``remove`` deletes
    it; what a result still reads stays, and the folder's owner cleans it up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if narrow:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, partitions // NARROW))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing will read them again;
    any other table is left alone."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(name: str, *used: DataFrame) -> str:
    """``name``, with underscores added until no table has such a column."""
    taken = {c.lower() for df in used for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``written`` into as many buckets by ``key`` as shuffles have partitions, so
    that a later grouping by ``key`` need not move these rows again."""
    spark = df.sparkSession
    table = f"vectide_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved while the catalogue still has the table; the files stay
    spark.sql(f"DROP TABLE {table}")
    out.written_to = f"{shared_dir(spark)}/{table}"
    return out
