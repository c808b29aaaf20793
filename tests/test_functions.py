import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import scalars
from spotweave.functions.indexing import dense_index, exact_quantiles, ordered_index


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=3000)]
    rows += [("a", 0.25)] * 1500  # a third of the group is one value
    rows += [("b", float(v)) for v in rng.integers(0, 4, 50)] + [("c", 7.0)]
    rows += [("b", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    # A coarse sketch forces the bracketing path for the large group.
    for accuracy in (100, 10_000):
        got = {r["g"]: [r[f"q_{i}"] for i in range(5)] for r in exact_quantiles(df, ["g"], "v", qs, accuracy).collect()}
        for g in "abc":
            want = np.quantile([v for k, v in rows if k == g and v is not None and not np.isnan(v)], qs)
            assert np.allclose(got[g], want, atol=1e-12)


def test_dense_index_is_a_bijection(spark):
    ids = spark.range(5000).select((F.col("id") * 7 + 3).alias("obs_id"))
    got = sorted(r["i"] for r in dense_index(ids, "obs_id", buckets=16).collect())
    assert got == list(range(5000))


def test_ordered_index_follows_the_order_with_ties(spark):
    rows = [(i % 3, f"n{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = [(r["a"], r["b"]) for r in ordered_index(df, ["a", "b"], parts=7).orderBy("i").collect()]
    assert got == sorted(rows)


def test_harmonic_mean_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.5, 0.25), (0.0, 0.0), (0.0, 1.0), (-1.0, 1.0), (nan, 1.0), (inf, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(scalars.harmonic_mean("a", "b")).collect()]
    assert got[:3] == pytest.approx([1 / 3, 0.0, 0.0])
    assert all(np.isnan(v) for v in got[3:])


def test_scalars(spark):
    df = spark.createDataFrame([("12", "2_1_x"), (" 7 ", "3_0_4_y"), ("1.5", "plain"), ("", "9_z"), (None, "x1_2")], "v string, n string")
    got = df.select(scalars.safe_int("v"), *scalars.natural_key("n")).collect()
    assert [r[0] for r in got] == [12, 7, None, None, None]
    assert [tuple(r)[1:] for r in got] == [(2, 1, 0), (3, 0, 4), (999, 999, 999), (9, 0, 0), (999, 999, 999)]
    assert spark.range(1).select(scalars.k_folder(F.lit(7))).first()[0] == "k_007"
    assert scalars.alpha_tag(0.5) == "0p50"
    noisy = spark.createDataFrame([('x {"a": {"b": 1}} y {"c": 2}',), ("none",)], "t string")
    assert [r[0] for r in noisy.select(scalars.first_json_object("t")).collect()] == ['{"a": {"b": 1}}', None]


def test_equal_width_bin_top_edge_and_flat_range(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (10.0,)], "v double")
    bins = [r[0] for r in df.select(scalars.equal_width_bin("v", F.lit(0.0), F.lit(10.0), 2)).collect()]
    assert bins == [0, 0, 1, 1]
    flat = df.select(scalars.equal_width_bin("v", F.lit(3.0), F.lit(3.0), 4)).distinct().collect()
    assert [r[0] for r in flat] == [3]


def test_guarded_cosine(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 4.0), (2.0000001, 1.0, 4.0)], "d double, a double, b double")
    assert [r[0] for r in df.select(scalars.guarded_cosine("d", "a", "b")).collect()] == [1.0, 0.0, 1.0]
