import numpy as np
from pyspark.sql import functions as F

from mosaiq.functions.text import normal_form, normal_form_col
from mosaiq.operators import hotkeys
from mosaiq.operators.hotkeys import counted_keys, from_gaps, heavy_keys, per_key, to_gaps


def test_normal_form(spark):
    assert normal_form(" Ａ  b\t") == "a_b"
    df = spark.createDataFrame([(" RULE34 ",), ("ｒｕｌｅ３４",), ("",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(normal_form_col("s")).collect()] == ["rule34", "rule34", None, None, None]


def test_per_key(spark, monkeypatch):
    rows = [("hot" if k % 2 else " HOT", k % 10 if k < 280 else k << 30, k) for k in range(300)] + [("a", None, None), ("a", 1, 5), ("a", 1, 5), (None, 1, 1), ("", 1, 2), ("none", None, 3), ("a", -1 << 40, None)]
    df = spark.createDataFrame(rows, "k string, i long, n long").withColumn("key", F.lit("clash")).repartition(3)
    find = lambda rows: per_key(rows, "k", normal_form_col, "i", F.col("n"))
    want = {"hot": (300, 30, 0, 299), "a": (4, 2, 5, 5), None: (2, 1, 1, 2), "none": (1, 0, 3, 3)}
    assert {r.key: tuple(r)[1:] for r in find(df).collect()} == want
    monkeypatch.setattr(hotkeys, "HELD_ITEMS", 1)
    monkeypatch.setattr(hotkeys, "DENSE_ITEMS", 4)
    assert {r.key: tuple(r)[1:] for r in find(df).collect()} == want
    assert [r.key for r in heavy_keys(counted_keys(df, "k", normal_form_col), 0.5).collect()] == ["hot"]
    assert find(df.limit(0)).count() == 0 and heavy_keys(counted_keys(df.limit(0), "k", normal_form_col), 0.5).count() == 0


def test_gaps():
    rng = np.random.default_rng(0)
    for values in ([0], [5], [0, 1, 2, 127, 128, 129, 16_384, 4_194_303], np.unique(rng.integers(0, 1 << 22, 5000)), []):
        x = np.array(values, np.int64)
        assert (from_gaps(to_gaps(x)) == x).all() and len(to_gaps(x)) <= 4 * len(x)


def test_heavy_keys_shuffle_a_row_a_spelling(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id AS i")
    plan = counted_keys(df, "k", normal_form_col)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("ArrowEvalPython")  # counted before it is brought to one form
