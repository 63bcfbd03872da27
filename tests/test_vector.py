import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import vector as V


def frame(spark, rows):
    return spark.createDataFrame(rows, "site string, post_id long, point_id long, image_vec array<float>")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [("s%d" % (k % 2), k, 1000 + k, rng.standard_normal(8).tolist()) for k in range(60)]
    bad = [("s0", 90, 1090, None), ("s0", 91, 1091, [0.0] * 8), ("s0", 92, 1092, [float("nan")] + [1.0] * 7), ("s0", 93, 1093, [1.0] * 7)]
    return frame(spark, rows + bad), {1000 + k: np.array(r[3], np.float32) / np.linalg.norm(np.array(r[3], np.float32)) for k, r in enumerate(rows)}


def test_search_is_exact(points):
    df, unit = points
    q = [1.0, 2, 3, 4, 0, 0, 0, -1]
    want = sorted(unit, key=lambda i: (-(unit[i] @ np.array(q)), i))
    assert [r.point_id for r in V.search(df, q, 7).collect()] == want[:7]
    assert [r.point_id for r in V.search(df, q, 3, ["s1"]).collect()] == [i for i in want if i % 2][:3]
    assert V.search(df, q, 0).count() == 0


def test_similar(points):
    df, unit = points
    want = sorted((i for i in unit if i % 2 == 0 and i != 1010), key=lambda i: (-(unit[i] @ unit[1010]), i))
    assert [r.point_id for r in V.search_similar(df, "s0", 10, 5).collect()] == want[:5]
    with pytest.raises(V.NotFound):
        V.search_similar(df, "s0", 10_000)


def test_batch_knn(points):
    df, unit = points
    twice = df.unionAll(df)
    got = {}
    for r in V.batch_knn(twice.where("point_id % 10 = 0"), twice, 4, dim=8, block=16).collect():
        got.setdefault(r.query, {})[r.rank] = r.other
    for q in range(1000, 1060, 10):
        want = sorted((i for i in unit if i != q), key=lambda i: (-(unit[i] @ unit[q]), i))[:4]
        assert [got[q][k] for k in range(1, 5)] == want
    assert V.batch_knn(df.limit(0), df, 4, dim=8).count() == 0


def test_guards_and_blend(spark):
    for bad in ([float("nan")], [0.0, 1e-9]):
        with pytest.raises(ValueError):
            V.check_query(bad)
    assert (V.effective_weight(True, False, 0.7), V.effective_weight(False, True, 0.7), V.effective_weight(True, True, 0.7)) == (0, 1, 0.7)
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0]), ([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.blend(F.col("a"), F.col("b"), 0.5)).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0]


def test_quantized_search_finds_the_same(points):
    df, _ = points
    coded = df.where("post_id < 60").withColumn("code", V.quantize_int8(F.col("image_vec"), 8))
    q = [1.0, 2, 3, 4, 0, 0, 0, -1]
    assert [r.point_id for r in V.search_quantized(coded, q, 5).collect()] == [r.point_id for r in V.search(df, q, 5).collect()]


def test_sql_function(spark):
    V.register_sql(spark)
    spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [1.0], [1.0, 2.0]), (3, None, [1.0]), (4, [0.0], [1.0]), (5, [2.0, 0.0], [-1.0, 0.0])], "k int, a array<float>, b array<float>").createOrReplaceTempView("pairs")
    got = [r[0] for r in spark.sql("SELECT cosine_similarity(a, b) FROM pairs ORDER BY k").collect()]
    assert abs(got[0] - 0.96) < 1e-12 and got[1:] == [None, None, None, -1.0]


def test_quantized_search_is_exact_among_near_copies(spark):
    """A hundred posts closer to each other than the 8-bit error: the best are still found."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(64)
    rows = [(k, "a", (base + 1e-3 * rng.standard_normal(64)).tolist()) for k in range(100)] + [(100, "a", None), (101, "a", rng.standard_normal(64).tolist())]
    df = spark.createDataFrame(rows, "point_id long, site string, image_vec array<double>").repartition(3)
    q = (base + 0.05 * rng.standard_normal(64)).tolist()
    coded = df.withColumn("code", V.quantize_int8(F.col("image_vec")))
    for limit in (0, 1, 5, 200):
        assert [(r.point_id, r.score) for r in V.search_quantized(coded, q, limit).collect()] == [(r.point_id, r.score) for r in V.search(df, q, limit).collect()]
