"""Count-or-time micro-batches: an exact replay over a table of arrivals, and a
live runner on Structured Streaming.

Replay: arrivals are ordered by (ts, id). A batch opens with its first arrival
and closes when it holds ``size`` arrivals, or before the first arrival that
comes ``wait`` or more after it opened. (A live consumer opens its batch when its
loop starts, on its own clock, which no replay can know.)

The scan is sequential, but a batch spans at most ``size`` arrivals, so it is
split: arrivals are ranged over blocks, and each block computes for its first
``size`` positions where a batch opened there would leave the block, by doubling
steps. The driver walks these small tables, blocks x size numbers, and every block
then numbers its own batches. Blocks need the first ``size`` times of what follows
them; these and the block's entry come to it as one row of a table.

The live runner closes by time at its triggers. What a trigger finds is divided by
count where it lies: each partition's requests, in the order they were read, make
micro-batches of at most ``size``.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectide.sources.tables import written

SIZE, WAIT = 16, 1.0


def _following(times: np.ndarray, rows: int, size: int, wait: int) -> np.ndarray:
    """For each of the first ``rows`` positions, where the next batch opens."""
    late = np.searchsorted(times, times[:rows] + wait, side="left")
    return np.minimum(np.arange(rows) + size, np.maximum(late, np.arange(rows) + 1))


def _sorted(block: pa.Table) -> tuple[np.ndarray, pa.Table]:
    block = block.sort_by([("us", "ascending"), ("id", "ascending")])
    return block.column("us").to_numpy(), block


def assign_batches(arrivals: DataFrame, size: int = SIZE, wait: float = WAIT, block_rows: int = 1_000_000, id_col: str = "event_id", ts_col: str = "ts") -> DataFrame:
    """``(id, ts, batch_id)``; batches are numbered from 0 in order of opening.
    Rows without a time are left out, as they never arrive; ids are unique."""
    spark = arrivals.sparkSession
    wait_us = round(wait * 1e6)
    timed = arrivals.where(F.col(ts_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(ts_col).alias("ts"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us"))
    blocks = max(1, math.ceil(timed.count() / block_rows))
    ranged = written(timed.repartitionByRange(blocks, "us", "id").withColumn("block", F.spark_partition_id()), "arrivals")

    def heads(block: pa.Table) -> pa.Table:
        times, _ = _sorted(block)
        return pa.table({"block": pa.array([block.column("block")[0].as_py()], pa.int32()), "n": pa.array([len(times)], pa.int64()), "first": pa.array([times[:size].tolist()], pa.list_(pa.int64()))})

    known = sorted(ranged.groupBy("block").applyInArrow(heads, "block int, n long, first array<long>").collect(), key=lambda r: r["block"])
    ahead: dict[int, list[int]] = {}
    following: list[int] = []
    for r in reversed(known):
        ahead[r["block"]] = following
        following = [*r["first"], *following][:size]

    def exits(block: pa.Table, given: pa.Table) -> pa.Table:
        times, _ = _sorted(block)
        rows = len(times)
        step = _following(np.concatenate([times, _one(given, "ahead")]), rows, size, wait_us)
        leave, opened = _doubled(step, rows, size)
        return pa.table({"block": block.column("block")[:1], "leave": pa.array([leave.tolist()], pa.list_(pa.int64())), "opened": pa.array([opened.tolist()], pa.list_(pa.int64()))})

    kind = "block int, ahead array<long>, at long, number long"
    given = spark.createDataFrame([(k, v, 0, 0) for k, v in ahead.items()], kind)
    found = ranged.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(exits, "block int, leave array<long>, opened array<long>")
    table = {r["block"]: r for r in found.collect()}
    enter = []
    offset = number = 0
    for r in known:
        key = r["block"]
        enter.append((key, ahead[key], offset, number))
        if offset >= r["n"]:
            offset -= r["n"]
        else:
            number += table[key]["opened"][offset]
            offset = table[key]["leave"][offset]

    def number_rows(block: pa.Table, given: pa.Table) -> pa.Table:
        times, ordered = _sorted(block)
        rows = len(times)
        step = _following(np.concatenate([times, _one(given, "ahead")]), rows, size, wait_us).tolist()
        at, first = given.column("at")[0].as_py(), given.column("number")[0].as_py()
        opens = np.zeros(rows, np.int64)
        while at < rows:
            opens[at] = 1
            at = step[at]
        return pa.table({"id": ordered.column("id"), "ts": ordered.column("ts"), "batch_id": pa.array(first - 1 + np.cumsum(opens), pa.int64())})

    kinds = dict(timed.dtypes)
    given = spark.createDataFrame(enter, kind)
    out = ranged.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(number_rows, f"id {kinds['id']}, ts {kinds['ts']}, batch_id long")
    named = out.select(F.col("id").alias(id_col), F.col("ts").alias(ts_col), "batch_id")
    named.written_to = ranged.written_to  # for ``remove``
    return named


def _one(given: pa.Table, column: str) -> np.ndarray:
    return np.array(given.column(column)[0].as_py(), np.int64)


def _doubled(step: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For batches opened at each of the first positions: how far into the next block
    they leave this one, and how many were opened, in a logarithm of rows steps."""
    at = np.concatenate([step, np.arange(rows, rows + size + 1)])
    opened = np.concatenate([np.ones(rows, np.int64), np.zeros(size + 1, np.int64)])
    few = min(size, rows)
    while (at[:few] < rows).any():
        opened = opened + opened[at]
        at = at[at]
    return at[:few] - rows, opened[:few]


def batch_stats(assigned: DataFrame) -> DataFrame:
    """``(n_requests, n_batches, max_batch, avg_batch)``."""
    sizes = assigned.groupBy("batch_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_requests"), F.count("*").alias("n_batches"), F.coalesce(F.max("n"), F.lit(0)).alias("max_batch"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_batch"))


def serve(requests: DataFrame, handle: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, wait: str = "1 second", drain: bool = False, timeout: float = 30.0, size: int = SIZE, done: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Runs a stream of ``requests(request_id, ts, query, k)`` through ``handle``
    (requests as ``(qid, query, k)`` to ``(qid, query, result)``) and writes
    ``(request_id, query, result, status, part)`` as Parquet, one folder per trigger:
    a trigger that is run again replaces its own folder, so each request has one
    response.

    What a trigger finds is divided into micro-batches (``part``) of at most ``size``
    requests, without a shuffle. A request has the status
    ``timeout`` and no result if its answer is not there ``timeout`` seconds after
    its ``ts``: one that is older already isn't handled, the time is looked at again
    when its answer is written, and jobs that run longer are cancelled. ``done`` gets
    the responses of each trigger once they are written. ``drain`` finishes what there
    is and stops.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.adaptive.enabled", "true")  # streams turn it off; a trigger's jobs are batch jobs
        target = f"{sink}/batch={number}"
        waited = time.time() - F.unix_micros("ts") / 1e6
        place = F.monotonically_increasing_id()  # partition and position in it
        part = F.shiftleft(F.shiftright(place, 33), 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / size)
        marked = batch.select("request_id", "ts", "query", "k", F.coalesce(waited > timeout, F.lit(False)).alias("late"), part.alias("part")).persist()
        columns = ["request_id", "query", "result", "status", "part"]

        def answer() -> None:
            fresh = handle(marked.where("not late").select(F.col("request_id").alias("qid"), "query", "k")).select("qid", "result")
            late = F.col("late") | (_clock(F.unix_micros("ts"), F.col("result")) > timeout)
            out = marked.join(fresh, F.col("request_id") == F.col("qid"), "left").withColumn("late", late)
            out = out.select("request_id", "query", F.when(~F.col("late"), F.col("result")).alias("result"), F.when(F.col("late"), "timeout").otherwise("ok").alias("status"), "part")
            out.write.mode("overwrite").parquet(target)

        if not _within(spark, answer, timeout):
            marked.select("request_id", "query", F.lit(None).cast("string").alias("result"), F.lit("timeout").alias("status"), "part").select(columns).write.mode("overwrite").parquet(target)
        marked.unpersist()
        if done is not None:
            done(spark.read.schema("request_id long, query string, result string, status string, part long").parquet(target))

    trigger = {"availableNow": True} if drain else {"processingTime": wait}
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _clock(since_us: Column, after: Column) -> Column:
    """Seconds from a time to when a value is there; null times have waited for none."""

    @F.pandas_udf("double")
    def run(since: pd.Series, value: pd.Series) -> pd.Series:
        return (time.time() - since / 1e6).fillna(0.0)

    return run.asNondeterministic()(since_us, after)


def _within(spark: SparkSession, call: Callable[[], None], seconds: float) -> bool:
    """Whether a call ends in so many seconds; if not, its jobs are cancelled."""
    tag = f"serve-{uuid.uuid4().hex}"
    failed: list[BaseException] = []

    def tagged() -> None:
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(True)
        try:
            call()
        except BaseException as e:  # raised again below, unless it is the cancellation
            failed.append(e)
        finally:
            spark.sparkContext.removeJobTag(tag)

    worker = InheritableThread(target=tagged, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        worker.join()
        return False
    if failed:
        raise failed[0]
    return True


def responses(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema("request_id long, query string, result string, status string, part long, batch int").parquet(sink)


def stats(responses_df: DataFrame) -> DataFrame:
    """Running counters of a service: ``(total_requests, total_batches, max_batch,
    avg_batch, timeouts)``."""
    sizes = responses_df.groupBy("batch", "part").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "timeout").alias("late"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"), F.count("*").alias("total_batches"), F.max("n").alias("max_batch"), F.avg("n").alias("avg_batch"), F.coalesce(F.sum("late"), F.lit(0)).alias("timeouts"))
