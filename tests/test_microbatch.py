import json
import random
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from vectide.functions.embed import HashingEmbedder, embed
from vectide.operators import rag
from vectide.sources import vectors as V
from vectide.streaming import microbatch as M
from vectide.streaming.service import Service

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(arrivals, size, wait):
    out, batch, opened, held = {}, -1, None, 0
    for ts, key in sorted((t, k) for k, t in arrivals if t is not None):
        if held == 0 or held >= size or ts - opened >= timedelta(seconds=wait):
            batch, opened, held = batch + 1, ts, 0
        held += 1
        out[key] = batch
    return out


@pytest.mark.parametrize("block_rows", [1_000_000, 50, 7, 1])
@pytest.mark.parametrize("gap", [0, 0.05, 1.0, 30])
def test_replay_against_a_loop(spark, block_rows, gap):
    rng = random.Random(gap)
    t, rows = START, []
    for k in range(120 if block_rows > 1 else 20):
        rows.append((1000 - k, t))
        t += timedelta(seconds=round(rng.random() * 2 * gap, 3))
    rows += [(2000, None), (2001, rows[3][1] + timedelta(seconds=1))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    got = {r["event_id"]: r["batch_id"] for r in M.assign_batches(df, 16, 1.0, block_rows).collect()}
    assert got == plain(rows, 16, 1.0)


def test_both_ways_of_closing(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(k, at(0)) for k in range(17)] + [(20, at(0.5)), (21, at(1.0)), (22, at(1.999)), (23, at(2.0))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    got = {r["event_id"]: r["batch_id"] for r in M.assign_batches(df).collect()}
    assert [got[k] for k in (0, 15, 16, 20, 21, 22, 23)] == [0, 0, 1, 1, 2, 2, 3]
    s = M.batch_stats(M.assign_batches(df)).first()
    assert tuple(s) == (21, 4, 16, 5.25)
    empty = M.batch_stats(M.assign_batches(df.where("false"))).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_live_stream_drains_and_answers(spark, tmp_path):
    now = datetime.now(timezone.utc)
    rows = [(i, now if i else now - timedelta(hours=1), f"ships and rivers {i}", 1 + i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, query string, k int")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(source)
    docs = embed(V.documents(spark), HashingEmbedder()).cache()
    handle = lambda asked: rag.answer(docs, asked, HashingEmbedder(), rag.EchoGenerator())
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    M.serve(stream, handle, sink, str(tmp_path / "check"), drain=True).awaitTermination(120)
    got = M.responses(spark, sink)
    by = {r["request_id"]: r for r in got.collect()}
    assert set(by) == set(range(9)) and by[0]["status"] == "timeout" and by[0]["result"] is None
    batch = {r["qid"]: r["result"] for r in handle(df.withColumnRenamed("request_id", "qid")).collect()}
    assert all(by[i]["result"] == batch[i] for i in range(1, 9))
    s = M.stats(got).first()
    assert s["total_requests"] == 9 and s["timeouts"] == 1
    assert s["total_batches"] >= 3 and got.select("batch").distinct().count() == 3


def test_live_batches_have_a_count_limit(spark, tmp_path):
    now = datetime.now(timezone.utc)
    rows = [(i, now, f"rivers {i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, query string, k int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    handle = lambda asked: asked.select("qid", "query", asked["query"].alias("result"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    M.serve(stream, handle, str(tmp_path / "out"), str(tmp_path / "check"), drain=True).awaitTermination(120)
    s = M.stats(M.responses(spark, str(tmp_path / "out"))).first()
    assert (s["total_requests"], s["total_batches"], s["max_batch"], s["timeouts"]) == (40, 3, 16, 0)


@pytest.mark.parametrize("slow", [4, 60])
def test_slow_answers_time_out(spark, tmp_path, slow):
    """A job that ends late is a timeout, and one that would run on is cancelled."""
    from pyspark.sql import functions as F

    now = datetime.now(timezone.utc) - timedelta(seconds=17)
    df = spark.createDataFrame([(i, now, "q", 1) for i in range(3)], "request_id long, ts timestamp, query string, k int")
    df.write.parquet(str(tmp_path / "in"))

    @F.pandas_udf("string")
    def wait(q: pd.Series) -> pd.Series:
        time.sleep(slow)
        return q

    handle = lambda asked: asked.coalesce(1).select("qid", "query", wait("query").alias("result"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    began = time.monotonic()
    M.serve(stream, handle, str(tmp_path / "out"), str(tmp_path / "check"), drain=True, timeout=20.0).awaitTermination(120)
    assert time.monotonic() - began < 50
    got = M.responses(spark, str(tmp_path / "out")).collect()
    assert sorted(r["request_id"] for r in got) == [0, 1, 2] and {(r["status"], r["result"]) for r in got} == {("timeout", None)}


def test_http_service(spark, tmp_path):
    docs = embed(V.documents(spark), HashingEmbedder()).cache()
    handle = lambda asked: rag.answer(docs, asked, HashingEmbedder(), rag.EchoGenerator())
    service = Service(spark, handle, str(tmp_path / "service"), wait=0.2)

    def post(body, path="/rag"):
        try:
            with urllib.request.urlopen(urllib.request.Request(service.address + path, body), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    for bad in (b"", b"[]", b"no json", b'{"k": 2}', b'{"query": ""}', b'{"query": "q", "k": 0}', b'{"query": "q", "k": "2"}', b'{"query": 5}'):
        assert post(bad)[0] == 422
    assert post(b"{}", "/other")[0] == 404
    with ThreadPoolExecutor(20) as pool:
        got = list(pool.map(lambda i: post(json.dumps({"query": f"rivers and ships {i}", "k": 1 + i % 3}).encode()), range(20)))
    asked = spark.createDataFrame([(i, f"rivers and ships {i}", 1 + i % 3) for i in range(20)], "qid long, query string, k int")
    want = {r["query"]: r["result"] for r in handle(asked).collect()}
    assert [s for s, _ in got] == [200] * 20 and all(b["result"] == want[b["query"]] for _, b in got)
    with urllib.request.urlopen(service.address + "/performance") as r:
        counts = json.loads(r.read())
    assert counts["total_requests"] == counts["answered"] == counts["batched"] == 20 and counts["max_batch"] <= 16 and counts["total_batches"] >= 2 and counts["timeouts"] == 0
    service.stop()
    assert M.stats(M.responses(spark, str(tmp_path / "service" / "answers"))).first()["total_requests"] == 20
