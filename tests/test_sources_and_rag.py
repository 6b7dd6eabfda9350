import io
import json

import numpy as np
import pytest

from vectide.functions.embed import HashingEmbedder, embed
from vectide.operators import ann, knn, loadstats, rag
from vectide.sources import vectors as V


def test_readers(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(2500, 5)).astype(np.float32)
    np.save(tmp_path / "a.npy", m)
    got = V.read_npy(spark, str(tmp_path / "a.npy")).orderBy("vec_id").collect()
    assert np.array_equal([r["embedding"] for r in got], m)
    np.save(tmp_path / "x.npy", m[0].astype(float))
    assert np.allclose(V.read_npy(spark, str(tmp_path / "x.npy")).first()["embedding"], m[0])
    parts = V.to_npy(V.read_npy(spark, str(tmp_path / "a.npy")).coalesce(1), 700).orderBy("part").collect()
    assert len(parts) == 4 and np.array_equal(np.vstack([np.load(io.BytesIO(r["content"])) for r in parts]), m)
    np.savetxt(tmp_path / "a.txt", m[:7], header="seven rows")
    text = V.read_text(spark, str(tmp_path / "a.txt")).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in text] == list(range(7)) and np.allclose([r["embedding"] for r in text], m[:7], atol=1e-6)
    (tmp_path / "c.json").write_text(json.dumps({"n": 3, "d": 5, "a_file": "a", "x_file": "x", "k": 2}, indent=1))
    assert V.read_config(spark, str(tmp_path / "c.json"))["d"] == 5
    with pytest.raises(Exception, match="dimensions"):
        V.checked(V.read_npy(spark, str(tmp_path / "a.npy")), 4).collect()
    assert V.checked(V.read_npy(spark, str(tmp_path / "a.npy")), 5).count() == 2500


def test_matrices_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1000, 6)).astype(np.float32)
    np.save(tmp_path / "a.npy", m)
    m.tofile(tmp_path / "a.bin")
    m[7].tofile(tmp_path / "x.bin")
    np.savetxt(tmp_path / "a.txt", m)
    for found in (V.read_npy(spark, str(tmp_path / "a.npy"), 700), V.read_raw(spark, str(tmp_path / "a.bin"), 6, part_bytes=1000)):
        got = found.orderBy("vec_id").collect()
        assert [r["vec_id"] for r in got] == list(range(1000)) and np.array_equal([r["embedding"] for r in got], m)
        assert found.rdd.getNumPartitions() > 20
    with pytest.raises(ValueError, match="whole number"):
        V.read_raw(spark, str(tmp_path / "a.bin"), 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many blocks a file
    try:
        (tmp_path / "t").mkdir()
        for name, part in (("2.txt", m[400:]), ("1.txt", m[:400])):
            np.savetxt(tmp_path / "t" / name, part, header="rows")
        text = V.read_text(spark, str(tmp_path / "t"))
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 5
        got = text.orderBy("vec_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["vec_id"] for r in got] == list(range(1000)) and np.allclose([r["embedding"] for r in got], m, atol=1e-6)
    out = tmp_path / "out"
    assert V.write_npy(V.read_raw(spark, str(tmp_path / "a.bin"), 6).coalesce(1), str(out), 300) == 1000
    assert V.write_npy(V.read_raw(spark, str(tmp_path / "a.bin"), 6).coalesce(1), f"file://{out}", 300) == 1000
    files = sorted(out.iterdir())
    assert len(files) == 4 and np.array_equal(np.vstack([np.load(f) for f in files]), m)


def test_workloads(spark, tmp_path):
    m = np.random.default_rng(5).normal(size=(50, 4)).astype(np.float32)
    m.tofile(tmp_path / "A.bin")
    m[3].tofile(tmp_path / "X.bin")
    config = {"n": 50, "d": 4, "a_file": "A.bin", "x_file": "X.bin", "k": 3, "k_1": 5, "k_2": 5}
    (tmp_path / "c.json").write_text(json.dumps(config))
    w = V.workload(spark, str(tmp_path / "c.json"))
    assert np.allclose(w.query, m[3]) and (w.k, w.clusters, w.probes) == (3, 5, 5)
    exact = [r["vec_id"] for r in knn.nearest(w.vectors, w.query, w.k).orderBy("rank").collect()]
    index = ann.build(w.vectors, w.clusters, max_iters=3)
    assert exact[0] == 3 and [r["vec_id"] for r in ann.search_one(index, w.query, w.k, w.probes).orderBy("rank").collect()] == exact
    (tmp_path / "d.json").write_text(json.dumps(config | {"n": 51}))
    with pytest.raises(ValueError, match="not 51"):
        V.workload(spark, str(tmp_path / "d.json"))
    r = V.random_workload(spark, "knn")
    assert len(r.query) == 100 and r.vectors.count() == 1000 and V.random_workload(spark, "kmeans").query is None


def test_synthetic_is_stable(spark):
    a = V.synthetic(spark, 200, 8).orderBy("vec_id").collect()
    b = V.synthetic(spark.range(1).sparkSession, 200, 8).repartition(7).orderBy("vec_id").collect()
    assert a == b
    u = np.array([r["embedding"] for r in a])
    assert 0 <= u.min() and u.max() <= 1 and abs(u.mean() - 0.5) < 0.05
    z = np.array([r["embedding"] for r in V.synthetic(spark, 500, 8, kind="normal").collect()])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_embedding_is_batch_invariant(spark):
    e = HashingEmbedder(16)
    texts = ["One two, TWO!", "", "é a1", "x " * 5000]
    together = e.embed(texts)
    assert np.allclose(together, np.vstack([HashingEmbedder(16).embed([t]) for t in texts]))
    assert np.allclose(np.linalg.norm(together, axis=1), [1, 0, 1, 1])
    df = spark.createDataFrame([(0, None), (1, "One two, TWO!")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in embed(df, e).collect()}
    assert np.allclose(got[0], 0) and np.allclose(got[1], together[0])


def test_retrieval_pipeline(spark):
    docs = embed(V.documents(spark), HashingEmbedder())
    asked = spark.createDataFrame([(1, "which honey jar keeps for years?", None), (2, "ships near the coast", 1), (3, "rivers", 9)], "qid long, query string, k int")
    got = {r["qid"]: r["result"] for r in rag.answer(docs, asked, HashingEmbedder(), rag.EchoGenerator("!")).collect()}
    assert got[2] == f"Question: ships near the coast\nContext:\n{V.DOCUMENTS[1]}\nAnswer:!"
    assert got[1].split("\n")[2] == V.DOCUMENTS[2] and len(got[1].split("\n")) == 5
    assert sorted(got[3].split("\n")[2:5]) == sorted(V.DOCUMENTS)
    assert rag.requests(asked.drop("k")).select("k").distinct().collect()[0][0] == 2
    for bad in ([(1, None, 2)], [(1, "q", 0)]):
        with pytest.raises(Exception):
            rag.requests(spark.createDataFrame(bad, "qid long, query string, k int")).collect()
    nothing = rag.answer(docs.where("false"), asked, HashingEmbedder(), rag.EchoGenerator("")).collect()
    assert {r["result"] for r in nothing if r["qid"] == 3} == {"Question: rivers\nContext:\n\nAnswer:"}


def test_load_statistics(spark):
    data = [(5, 1.0), (5, 3.0), (5, None), (10, None), (20, 40.0)]
    df = spark.createDataFrame(data, "rate int, latency double")
    got = {r["rate"]: tuple(r)[1:] for r in loadstats.throughput(df).collect()}
    assert got == {5: (3, 2, 1, 4.0, 0.5), 10: (1, 0, 1, 0.0, 0.0), 20: (1, 1, 0, 40.0, 0.025)}
    assert {r["status"]: r["n"] for r in loadstats.timeouts(df).collect()} == {"ok": 2, "failed": 2, "timeout": 1}
    assert {r["rate"]: r["p50"] for r in loadstats.latency(df).collect()} == {5: 2.0, 10: None, 20: 40.0}


def test_bursts(spark):
    calls = iter(range(1000))

    def call():
        if next(calls) % 3 == 0:
            raise RuntimeError

    got = loadstats.throughput(loadstats.sweep(spark, call, (2, 4))).collect()
    assert {r["rate"]: r["total"] for r in got} == {2: 2, 4: 4} and sum(r["failed"] for r in got) == 2
