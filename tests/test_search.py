import duckdb
import numpy as np
import pytest

from vectide.functions import distances as D
from vectide.operators import ann, kmeans, knn, topk
from vectide.plans import catalogue


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(parts)


def queries(spark, rows, ks=None):
    data = [(i, [float(x) for x in r], ks[i] if ks else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "qid long, q array<double>, k int")


def plain_search(rows, q, metric, k, ascending):
    d = np.round(D.block(metric, rows, q[None])[:, 0], 6)
    order = sorted(range(len(rows)), key=lambda i: (d[i] if ascending else -d[i], i))[:k]
    return [(r + 1, i, d[i]) for r, i in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(120, 32)) * rng.integers(1, 5, size=(120, 1))).astype(np.float32)
    v[50] = v[10]
    v[60] = 0
    return v


@pytest.mark.parametrize("metric", D.METRICS)
@pytest.mark.parametrize("query_bytes", [64 << 20, 600])
def test_search_against_numpy(spark, rows, metric, query_bytes):
    q = rows[[10, 60, 3, 4, 5]].astype(float)
    ks = [1, 5, 119, 120, 500]
    got = {}
    for r in knn.search(frame(spark, rows), queries(spark, q, ks), metric, digits=6, query_bytes=query_bytes).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vec_id"], r["dist"]))
    for j, k in enumerate(ks):
        expected = plain_search(rows, q[j], metric, k, D.nearest_first(metric))
        assert [x[:2] for x in sorted(got[j])] == [x[:2] for x in expected]
        assert np.allclose([x[2] for x in sorted(got[j])], [x[2] for x in expected])


def test_order_and_prefix(spark, rows):
    f = frame(spark, rows)
    take = lambda k, **o: [tuple(r) for r in knn.nearest(f, rows[7], k, digits=6, **o).orderBy("rank").collect()]
    assert take(9)[:8] == take(8)
    assert [x[1] for x in take(5, metric="dot", order="asc")] == [x[1] for x in plain_search(rows, rows[7].astype(float), "dot", 5, True)]
    with pytest.raises(ValueError):
        take(1, metric="dot", order="up")
    with pytest.raises(ValueError):
        knn.distances_to(f, queries(spark, rows[:3]), "hamming")


@pytest.mark.parametrize("query_bytes", [64 << 20, 600])
def test_all_distances(spark, rows, query_bytes):
    found = knn.distances_to(frame(spark, rows), queries(spark, rows[:5]), "manhattan", query_bytes=query_bytes).collect()
    expected = D.block("manhattan", rows, rows[:5])
    assert len(found) == 600 and all(abs(r["dist"] - expected[r["vec_id"], r["qid"]]) < 1e-9 for r in found)


def test_empty_tables(spark, rows):
    none = frame(spark, [])
    assert knn.search(none, queries(spark, rows[:2]), k=3).count() == 0
    assert knn.search(frame(spark, rows), queries(spark, []), k=3).count() == 0


def test_top_k(spark):
    data = [(i, g, v) for i, (g, v) in enumerate([("a", 3.0), ("a", -5.0), ("b", 3.0), ("a", 3.0), ("b", None), ("b", 0.5)])]
    df = spark.createDataFrame(data, "id int, g string, v double")
    ids = lambda **o: [r["id"] for r in topk.top_k(df, "v", "id", **o).orderBy("rank").collect()]
    assert ids(k=3) == [1, 5, 0] and ids(k=2, order="desc") == [0, 2] and ids(k=10, order="abs") == [5, 0, 2, 3, 1, 4]
    per = {(r["g"], r["rank"]): r["id"] for r in topk.top_k_per_group(df, "g", "v", "id", 2).collect()}
    assert per == {("a", 1): 1, ("a", 2): 0, ("b", 1): 5, ("b", 2): 2}
    with pytest.raises(ValueError):
        topk.top_k(df, "v", "id", 1, "random")


def plain_kmeans(rows, start, metric, max_iters, tol, spare):
    c = start.astype(float)
    spare = list(spare)
    for n in range(1, max_iters + 1):
        d = D.block("l2_squared" if metric == "l2" else "cosine", rows, c)
        a = d.argmin(axis=1)
        used, new = c, np.array([rows[a == j].astype(float).mean(axis=0) if (a == j).any() else rows[spare.pop(0)] for j in range(len(c))])
        if np.sqrt(((new - c) ** 2).sum(axis=1)).max() <= tol:
            break
        c = new
    return c, used, a, n


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("iters, tol", [(1, 0.0), (4, 0.0), (100, 1e-4)])
def test_kmeans_follows_lloyd(spark, rows, metric, iters, tol):
    f = frame(spark, rows)
    order = [r["vec_id"] for r in kmeans.start_rows(f, 120).orderBy("cid").collect()]
    model = kmeans.fit(f, 6, iters, tol, metric)
    c, _, a, n = plain_kmeans(rows, rows[order[:6]], metric, iters, tol, order[6:])
    assert model.iterations == n and np.allclose(model.centroids, c, atol=1e-6)
    assert {r["vec_id"]: r["cid"] for r in model.assignments.collect()} == dict(enumerate(a.tolist()))
    assert model.sizes == {int(j): int((a == j).sum()) for j in np.unique(a)}


def test_kmeans_edges(spark, rows):
    f = frame(spark, rows)
    start = np.vstack([rows[:2], np.full((1, 32), 1e6)])  # the third gets no row
    order = [r["vec_id"] for r in kmeans.start_rows(f, 6).orderBy("cid").collect()]
    model = kmeans.fit(f, 3, 1, start=start)
    assert np.allclose(model.centroids[2], rows[order[0]])
    stable = kmeans.fit(f, 3, 50)
    again = kmeans.fit(f, 3, 50, start=stable.centroids, tol=1e-3)
    assert again.iterations == 1 and np.allclose(again.centroids, stable.centroids)
    for bad in (lambda: kmeans.fit(f, 3, metric="dot"), lambda: kmeans.fit(frame(spark, []), 2)):
        with pytest.raises(ValueError):
            bad()


def test_clustered_search(spark, rows, tmp_path):
    f = frame(spark, rows)
    index = ann.write_index(ann.build(f, 6, max_iters=5), str(tmp_path / "index"))
    q = queries(spark, rows[:8])
    exact = knn.search(f, q, k=5, digits=6)
    recall = []
    for probes in (1, 3, 6):
        found = ann.search_batch(index, q, 5, probes, digits=6)
        recall.append(np.mean([r["recall"] for r in ann.recall(exact, found, 5).collect()]))
    assert recall == sorted(recall) and recall[-1] == 1.0 and recall[0] > 0.2
    shuffled = ann.search_batch(index, q, 5, 6, digits=6, query_bytes=600)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, exact.collect()))
    one = [tuple(r) for r in ann.search_one(index, rows[3], 5, 6, digits=6).orderBy("rank").collect()]
    assert one == [tuple(r) for r in knn.nearest(f, rows[3], 5, digits=6).orderBy("rank").collect()]
    assert ann.default_clusters(500) == 22 and ann.default_clusters(0) == 1
    plan = index.vectors.where("cid = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cid" in plan


@pytest.mark.parametrize("name", ["ann_kmeans_recall", "ann_label_recall"])
def test_chosen_probes_reach_the_recall(spark, name):
    found = catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 25 and np.mean([r["recall"] for r in found]) >= 0.9


def test_fewest_probes(spark, rows):
    f, q = frame(spark, rows), queries(spark, rows[:8])
    index, exact = ann.build(f, 6, max_iters=5), knn.search(f, q, k=5, digits=6)
    means = [np.mean([r["recall"] for r in ann.recall(exact, ann.search_batch(index, q, 5, p, digits=6), 5).collect()]) for p in range(1, 7)]
    assert ann.choose_probes(index, q, exact, 0.9, digits=6) == next(p for p, m in enumerate(means, 1) if m >= 0.9 - 1e-9)


@pytest.mark.parametrize("metric", ["l2", "dot", "manhattan"])
def test_vectors_that_are_not_numbers(spark, metric):
    kind = "vec_id long, embedding array<float>"
    nan = float("nan")
    data = [(k, [float(k), 1.0]) for k in (4, 2, 9)] + [(k, [nan, 1.0]) for k in (8, 1, 7, 3)] + [(5, None), (None, [0.0, 0.0]), (6, [None, 2.0])]
    df = spark.createDataFrame(data, kind).repartition(2)
    for k in (1, 3, 5, 50):
        got = [r["vec_id"] for r in knn.nearest(df, [0.0, 1.0], k, metric=metric, digits=6).orderBy("rank").collect()]
        numbers = [2, 4, 9] if metric != "dot" else [2, 4, 9][:0] + sorted([4, 2, 9], key=lambda i: (-1.0, i))
        assert got == (numbers + [1, 3, 6, 7, 8])[:k], (metric, k)
    with pytest.raises(Exception, match="dimensions"):
        knn.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], kind).coalesce(1), [0.0, 1.0], 2).collect()
    asked = "qid long, q array<double>, k int"
    for bad, said in (((0, None, 1), "null"), ((0, [0.0, 1.0], None), "needs k")):
        with pytest.raises(ValueError, match=said):
            knn.search(df, spark.createDataFrame([bad], asked)).collect()


@pytest.mark.parametrize("metric", ["l2", "l2_squared", "cosine"])
@pytest.mark.parametrize("digits", [None, 2])
def test_many_queries_ties_and_small_slices(spark, monkeypatch, metric, digits):
    """Slices of a few rows, values that tie, and sums much larger than distances."""
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 3, size=(400, 3)).astype(float) + (1e4 if metric != "cosine" else 1)
    q = rows[:60] + rng.choice([0, 0.25], size=(60, 3))
    best = knn.Nearest(metric, q, rng.integers(1, 9, 60), True, digits)
    ids = rng.permutation(400)
    for start in range(0, 400, 7):
        best.offer(ids[start : start + 7], rows[start : start + 7])
    query, found, values = best.result()
    exact = knn.scores(metric, rows, q, digits)
    for j, k in enumerate(best.ks):
        order = np.lexsort((ids, exact[:, j]))[:k]
        if digits is not None or metric != "cosine":
            assert found[query == j].tolist() == ids[order].tolist()
        assert np.allclose(values[query == j], exact[order, j], atol=1e-9)


def test_kmeans_leaves_out_what_has_no_vector(spark, rows):
    kind = "vec_id long, embedding array<float>"
    clean = frame(spark, rows)
    odd = spark.createDataFrame([(1000, None), (1001, [float("nan")] * 32), (1002, [None] * 32)], kind)
    a, b = (kmeans.fit(f, 4, 5, metric="l2") for f in (clean, clean.unionByName(odd)))
    assert np.allclose(a.centroids, b.centroids) and b.sizes == a.sizes
    assert sorted(map(tuple, a.assignments.collect())) == sorted(map(tuple, b.assignments.collect()))
    means = kmeans.update(spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (None, [5.0, 5.0]), (0, [3.0, 4.0])], "cid int, embedding array<double>")).collect()
    assert [(r["cid"], r["mean"], r["n"]) for r in means] == [(0, [2.0, 3.0], 2)]
    with pytest.raises(Exception, match="dimensions"):
        kmeans.assign(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind).coalesce(1), np.zeros((1, 2))).collect()


def test_kmeans_spares_do_not_run_out(spark):
    """Many equal rows: clusters stay empty again and again, and each time take the
    next row in order, far beyond twice the clusters."""
    rows = np.zeros((90, 2), np.float32)
    rows[np.arange(90) % 9 == 0] = 5
    f = frame(spark, rows)
    order = [r["vec_id"] for r in kmeans.start_rows(f, 90).orderBy("cid").collect()]
    model = kmeans.fit(f, 4, 12, 0.0)
    c, _, a, n = plain_kmeans(rows, rows[order[:4]], "l2", 12, 0.0, order[4:])
    assert n == model.iterations and np.allclose(model.centroids, c)


@pytest.mark.parametrize("name", ["ann_recall"])
def test_registered_index_search_reaches_the_recall(spark, name):
    for sf in ("sf0.01", "sf0.1"):
        found = catalogue.queries()[name](spark, f"/root/testdata/{sf}").collect()
        assert np.mean([r["recall"] for r in found]) >= 0.9


def converged_and_sql(spark, tmp_path, vectors, metric):
    """What ``kmeans_converged_*`` gives for a table, and what its SQL gives."""
    path = str(tmp_path / "embeddings.parquet")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(path)
    name = f"kmeans_converged_{metric}"
    with duckdb.connect() as sql:
        sql.execute(f"create view embeddings as select * from '{path}/*.parquet'")
        expected = sql.execute(catalogue.oracle_sql()[name]).fetchall()
    return sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())), sorted(expected)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_converged_kmeans_makes_as_many_updates_as_its_sql(spark, tmp_path, metric):
    """Points along an arc, whose clusters still move after all updates of the SQL."""
    angle = np.linspace(0, 1.5, 2000)
    vectors = np.zeros((2000, 64))
    vectors[:, 0], vectors[:, 1] = np.cos(angle), np.sin(angle)
    assert kmeans.fit(frame(spark, vectors), 8, catalogue.UPDATES + 1, 0.0, metric).iterations > catalogue.UPDATES
    found, expected = converged_and_sql(spark, tmp_path, vectors, metric)
    assert found == expected


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_converged_kmeans_leaves_clusters_of_copies_empty(spark, tmp_path, metric):
    """As its SQL does: of centroids that are copies the first takes the rows."""
    vectors = np.random.default_rng(3).standard_normal((200, 64))
    vectors[np.arange(200) % 3 > 0] = vectors[0]
    found, expected = converged_and_sql(spark, tmp_path, vectors, metric)
    assert found == expected


def test_rounded_ties_go_to_the_first():
    rows = np.array([[1.0, 0.0], [0.0, 1.0]])
    near = np.array([[1.0 + 1e-8, 0.0], [1.0, 0.0], [0.0, 1.0]])  # squares differ by 1e-16
    assert kmeans.nearest_centroid(rows, near, "l2", 12).tolist() == [0, 2]
    assert kmeans.nearest_centroid(rows, near, "cosine", 12).tolist() == [0, 2]
