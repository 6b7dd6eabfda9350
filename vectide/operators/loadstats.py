"""Aggregates of load tests over samples ``(rate, latency)``; a null latency failed."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(call: Callable[[], object]) -> float | None:
    """Seconds that a call takes; None if it fails."""
    began = time.perf_counter()
    try:
        call()
    except Exception:
        return None
    return time.perf_counter() - began


def sweep(spark: SparkSession, call: Callable[[], object], rates: tuple[int, ...] = (5, 10, 20, 50, 100)) -> DataFrame:
    """``(rate, request_id, latency)`` of bursts: for each rate, so many calls at once."""
    rows: list[tuple[int, int, float | None]] = []
    for rate in rates:
        with ThreadPoolExecutor(rate) as pool:
            rows += [(rate, k, seconds) for k, seconds in enumerate(pool.map(lambda _: timed(call), range(rate)))]
    return spark.createDataFrame(rows, "rate int, request_id long, latency double")


def throughput(samples: DataFrame) -> DataFrame:
    """``(rate, total, ok, failed, latency_sum, throughput)``; the throughput is
    successes over summed latency, that is one over the mean, and 0 if nothing ran."""
    out = samples.groupBy("rate").agg(F.count("*").alias("total"), F.count("latency").alias("ok"), F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency_sum"))
    rate = F.coalesce(F.try_divide(F.col("ok").cast("double"), F.col("latency_sum")), F.lit(0.0))
    return out.select("rate", "total", "ok", (F.col("total") - F.col("ok")).alias("failed"), F.round("latency_sum", 4).alias("latency_sum"), F.round(rate, 6).alias("throughput"))


def latency(samples: DataFrame) -> DataFrame:
    """``(rate, min, mean, p50, p95, max)`` of the latencies that are there; the
    percentiles are exact, interpolated between neighbours."""
    return (
        samples.groupBy("rate")
        .agg(F.min("latency").alias("min"), F.avg("latency").alias("mean"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"), F.max("latency").alias("max"))
        .select("rate", *[F.round(c, 4).alias(c) for c in ("min", "mean", "p50", "p95", "max")])
    )


def timeouts(samples: DataFrame, limit: float = 30.0) -> DataFrame:
    """``(status, n)``: ok, timeout (slower than the limit) and failed requests."""
    status = F.when(F.col("latency").isNull(), "failed").when(F.col("latency") > limit, "timeout").otherwise("ok")
    return samples.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
