import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import distances as D

PLAIN = {
    "l2": lambda x, y: np.sqrt(((x - y) ** 2).sum()),
    "l2_squared": lambda x, y: ((x - y) ** 2).sum(),
    "manhattan": lambda x, y: np.abs(x - y).sum(),
    "dot": lambda x, y: (x * y).sum(),
    "cosine": lambda x, y: 1 - ((x * y).sum() / n if (n := np.linalg.norm(x) * np.linalg.norm(y)) else 0),
}


def plain(metric, x, y):
    if metric != "cosine_chunked":
        return PLAIN[metric](x, y)
    c = D.chunk_width(len(x))
    return sum(PLAIN["cosine"](x[i : i + c], y[i : i + c]) for i in range(0, len(x), c))


@pytest.mark.parametrize("metric", D.METRICS)
@pytest.mark.parametrize("d", [1, 2, 32, 64, 1024])
def test_columns_and_blocks_against_numpy(spark, metric, d):
    rng = np.random.default_rng(42)
    x, y = rng.normal(size=(6, d)).astype(np.float32), rng.normal(size=(6, d)).astype(np.float32)
    x[0] = 0
    y[1] = x[1]
    expected = [plain(metric, a.astype(float), b.astype(float)) for a, b in zip(x, y)]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<float>, y array<float>")
    got = [r[0] for r in df.orderBy("i").select(D.column(metric, F.col("x"), F.col("y"), d)).collect()]
    assert np.allclose(got, expected, atol=1e-9)
    assert np.allclose(np.diag(D.block(metric, x, y)), expected, atol=1e-9)


def test_zero_norms_and_unknown_names(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "x array<double>, y array<double>")
    r = df.select(D.cosine(F.col("x"), F.col("y")), D.normalize(F.col("x")), D.norm(F.col("y"))).first()
    assert r[0] == 1 and r[1] == [0, 0] and abs(r[2] - 5**0.5) < 1e-12
    for f in (lambda: D.column("hamming", F.col("x"), F.col("y")), lambda: D.block("hamming", np.ones((1, 2)), np.ones((1, 2))), lambda: D.chunk_width(100), lambda: D.column("cosine_chunked", F.col("x"), F.col("y"))):
        with pytest.raises(ValueError):
            f()


vectors = st.lists(st.lists(st.floats(-1e3, 1e3), min_size=4, max_size=4), min_size=3, max_size=3).map(np.array)


@settings(max_examples=200, deadline=None)
@given(vectors)
def test_metric_properties(v):
    for metric in ("l2", "manhattan"):
        m = D.block(metric, v, v)
        assert np.allclose(m, m.T) and np.allclose(np.diag(m), 0)
        assert m[0, 2] <= m[0, 1] + m[1, 2] + 1e-6
    c = D.block("cosine", v, v)
    assert (c >= -1e-9).all() and (c <= 2 + 1e-9).all()
