import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.operators import ranking


@pytest.fixture(scope="module")
def values(spark):
    """5,000 rows, a third of them one value, in two groups."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), 7.0 if rnd.random() < 0.33 else round(rnd.lognormvariate(2, 1), 2)) for i in range(5000)]
    return spark.createDataFrame(rows, "id int, g string, v double").repartition(6).persist()


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_prefix_sum_equals_global_window(values, rows, by, descending, buckets):
    counts = ranking.value_counts(values, "v", by)
    got = ranking.prefix_sum(counts, "v", ["n"], by, descending, few=buckets == 1, buckets=buckets)
    order = F.desc("v") if descending else F.asc("v")
    want = counts.select(
        "*",
        F.sum("n").over(W.partitionBy(*by).orderBy(order)).alias("cum_n"),
        F.sum("n").over(W.partitionBy(*by)).alias("total_n"),
    )
    cols = [*by, "v", "n", "cum_n", "total_n"]
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("small", [0, 5_000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_exact_quantiles(values, monkeypatch, small, by):
    monkeypatch.setattr(ranking, "SMALL_GROUP", small)
    monkeypatch.setattr(ranking, "MARGIN", 0.01)
    probs = {"low": 0.0, "q1": 0.25, "med": 0.5, "close": 0.505, "p99": 0.99, "high": 1.0}
    got = {r["g"] if by else "": r for r in ranking.exact_quantiles(values, "v", probs, by).collect()}
    assert len(got) == (2 if by else 1)
    for g, r in got.items():
        v = np.array([r["v"] for r in values.filter(F.col("g").startswith(g)).collect()])
        assert r["n"] == len(v) and r["min"] == v.min() and r["max"] == v.max()
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(v, 100 * p), abs=1e-9)


def test_quantiles_of_awkward_groups(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", nan), (None, 4.0), ("wide", -inf), ("wide", 0.0), ("wide", inf), *[("same", 5.0)] * 50]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["low"], r["med"]) for r in ranking.exact_quantiles(df, "v", {"low": 0.0, "med": 0.5}, ["g"]).collect()}
    assert got == {"one": (1, 3.0, 3.0), "two": (2, 1.0, 1.5), "wide": (3, -inf, 0.0), "same": (50, 5.0, 5.0)}
    empty = ranking.exact_quantiles(df.limit(0), "v", {"med": 0.5})
    assert [tuple(r) for r in empty.collect()] == [(0, None, None, None)]
    assert ranking.exact_quantiles(df.limit(0), "v", {"med": 0.5}, ["g"]).collect() == []


def test_quantiles_of_a_large_group(spark):
    """Far more rows than a sketch holds exactly."""
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).cast("double").alias("v"))
    v = (np.arange(300_000) * 7919) % 300_007
    r = ranking.exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "p99": 0.99}).first()
    assert (r["q1"], r["med"], r["p99"]) == tuple(float(np.percentile(v, p)) for p in (25, 50, 99))


def test_ranges_hold_even_numbers_of_values(spark):
    """Nine of ten rows are zero: no range may hold more than twice the mean of values."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), (F.col("id") % 100 < 97).cast("string").alias("g"))
    for by in ([], ["g"]):
        counts = ranking.value_counts(df, "v", by)
        sizes = [r["n"] for r in ranking.range_buckets(counts, [*by, "v"], 16).groupBy("__b").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


@pytest.mark.parametrize("n", [0, 1, 500, 2400, 10_000])
def test_take_lowest_is_exact_and_repeatable(values, n):
    out = ranking.take_lowest(values, ["g"], "id", 5, F.lit(n))
    taken = {r["g"]: r["n"] for r in out.filter("__taken").groupBy("g").agg(F.count("*").alias("n")).collect()}
    sizes = {r["g"]: r["n"] for r in values.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 5000
    for g, size in sizes.items():
        assert taken.get(g, 0) == min(n, size)
    again = ranking.take_lowest(values.repartition(3), ["g"], "id", 5, F.lit(n)).filter("__taken")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in out.filter("__taken").collect()}


def test_take_lowest_share_of_group_and_null_group(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 4 == 0, None).otherwise("x").alias("g"))
    out = ranking.take_lowest(df, ["g"], "id", 1, F.round(F.col("__size") * 0.2)).filter("__taken")
    assert {r["g"]: r["n"] for r in out.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"x": 150, None: 50}


def test_dense_ranks(spark, rows):
    df = spark.createDataFrame([(w, n) for w, n in zip("abcdef", [5, 3, 5, 1, 3, 9])], "w string, n bigint")
    want = [("a", 5, 2), ("b", 3, 3), ("c", 5, 2), ("d", 1, 4), ("e", 3, 3), ("f", 9, 1)]
    assert rows(ranking.dense_ranks(df, "n", "rank"), "w", "n", "rank") == want
    halves = df.withColumn("h", F.col("w") < "d")
    assert rows(ranking.dense_ranks(halves, "n", "rank", ["h"]), "w", "rank") == [("a", 1), ("b", 2), ("c", 1), ("d", 3), ("e", 2), ("f", 1)]


def test_bounded_rows_says_no(spark):
    assert ranking.bounded_rows(spark.range(11), 10) is None
    assert ranking.bounded_rows(spark.range(10), 10).count() == 10


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, rows, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("hot", 1.5), ("y", 2.5)], "k string, v double")
    assert rows(ranking.salted_join(left, right, ["k"], how)) == rows(left.join(right, "k", how))


def test_salted_join_refuses_outer(spark):
    with pytest.raises(ValueError):
        ranking.salted_join(spark.range(1), spark.range(1), ["id"], "full")


def test_attach_falls_back_to_salting(spark, rows, monkeypatch):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i int")
    right = spark.createDataFrame([("a", 9)], "k string, v int")
    want = rows(left.join(right, "k", "left"))
    assert rows(ranking.attach(left, right, ["k"], "left")) == want
    monkeypatch.setattr(ranking, "bounded_rows", lambda *a, **k: None)
    assert rows(ranking.attach(left, right, ["k"], "left")) == want


def test_dedupe_keeps_first(spark, rows):
    df = spark.createDataFrame([(3, "A ", "z"), (1, "a", "x"), (2, "b", "y")], "o int, k string, p string")
    got = ranking.dedupe_first(df, F.lower(F.trim("k")), "o")
    assert got.columns == df.columns
    assert rows(got) == [(1, "a", "x"), (2, "b", "y")]


def test_top_bottom_keeps_equal_routes(spark, rows):
    df = spark.createDataFrame([("r1", 1.0, 5), ("r2", 1.0, 5), ("r3", 2.0, 5)], "route string, mean double, n int")
    got = ranking.top_bottom(df, "mean", ["route"], 2)
    assert rows(got, "route") == [("r1",), ("r2",), ("r3",)]


@pytest.mark.parametrize("folds", [2, 5])
def test_folds_hold_equal_shares(spark, folds):
    sizes = {"a": 1_003, "b": 3, "c": 1, None: 47}
    rows = [(100_000 * k + i, g) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, g string")
    dealt = ranking.deal_folds(df, ["g"], "id", folds, 4).collect()
    assert len(dealt) == len(rows)
    for g, n in sizes.items():
        counts = [sum(r["g"] == g and r["fold"] == f for r in dealt) for f in range(folds)]
        assert counts == [(f + 1) * n // folds - f * n // folds for f in range(folds)]
    again = ranking.deal_folds(df.repartition(3), ["g"], "id", folds, 4).collect()
    assert {(r["id"], r["fold"]) for r in dealt} == {(r["id"], r["fold"]) for r in again}
    alone = ranking.deal_folds(df, [], "id", folds, 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in alone) == sorted((f + 1) * len(rows) // folds - f * len(rows) // folds for f in range(folds))
    assert ranking.deal_folds(df.limit(0), ["g"], "id", folds, 4).collect() == []


def test_lookup_and_among_top(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)], "k string, i int")
    freq = spark.createDataFrame([("a", 2)], "key string, f int")
    assert rows(ranking.lookup_left(df, freq, "k", "key"), "k", "i", "f")[0] == ("a", 1, 2)
    assert {r["k"] for r in ranking.among_top(df, "k", 1).collect()} == {"a"}  # ties go by key


def test_partial_group_limit_in_plan(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    plan = ranking.top_per_group(df, ["g"], [F.asc("id")], 2)
    assert plan.count() == 6
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_missing_numbers_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    r = ranking.exact_quantiles(df, "v", {"med": 0.5}).first()
    assert (r["n"], r["med"], r["max"]) == (2, 2.0, 3.0)
