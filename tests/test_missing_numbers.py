"""NaN counts as a missing value in every aggregate, and long categories need no column per level."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfare.operators import distributions, experiment, propensity

NAN = float("nan")


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 2], (x := rng.gauss(0, 1)), 2 * x + rng.gauss(0, 1)) for i in range(80)]
    clean = spark.createDataFrame(rows, "g string, x double, y double")
    holes = [("a", NAN, 1.0), ("b", 1.0, NAN), ("a", None, 1.0), ("b", NAN, NAN), (None, NAN, None)]
    return clean, clean.unionByName(spark.createDataFrame(holes, "g string, x double, y double"))


def close(a, b):
    assert len(a) == len(b) > 0
    for r, s in zip(a, b):
        assert r.asDict().keys() == s.asDict().keys()
        for c in r.asDict():
            assert r[c] == (pytest.approx(s[c]) if isinstance(s[c], float) else s[c])


@pytest.mark.parametrize(
    "summary",
    [
        lambda df: distributions.corr_with(df, ["x"], "y"),
        lambda df: distributions.corr_matrix(df, ["x", "y"]),
        lambda df: distributions.linreg(df, "x", "y"),
        lambda df: distributions.kde(df.select("g", "x").filter("g is not null"), "x", "g", points=5).orderBy("g", "i"),
        lambda df: experiment.jarque_bera(df.select("g", "x"), "g", "x").orderBy("g"),
        lambda df: experiment.arm_stats(df.select("g", "x"), "g", ["x"], treatment="a", control="b"),
    ],
)
def test_holes_change_nothing(pairs, summary):
    clean, holey = pairs
    if "linreg" in str(summary.__code__.co_names) or "corr" in str(summary.__code__.co_names):
        close(summary(holey).collect(), summary(clean).collect())
    else:  # values of x alone: rows whose y is missing count
        known = holey.filter(F.col("x").isNotNull() & ~F.isnan("x"))
        close(summary(holey).collect(), summary(known).collect())


def test_sparse_codes_of_many_levels(spark):
    rows = [(i, f"v{i % 1500:04d}" if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, c string")
    coded, levels = propensity.one_hot_sparse(df, "c", "code")
    table = {r["level"]: (r["index"], r["n"]) for r in levels.collect()}
    names = sorted({c or "Unknown" for _, c in rows})
    assert {n: i for n, (i, _) in table.items()} == {n: i for i, n in enumerate(names)}
    assert sum(n for _, n in table.values()) == 4000
    for r in coded.collect():
        assert r["code"].size == len(names) and r["code"].indices.tolist() == [names.index(r["c"] or "Unknown")]
    later, _ = propensity.one_hot_sparse(spark.createDataFrame([(1, "v0001"), (2, "new")], "id int, c string"), "c", "code", levels)
    got = {r["id"]: r["code"] for r in later.collect()}
    assert got[1].indices.tolist() == [names.index("v0001")] and np.count_nonzero(got[2].toArray()) == 0 and got[2].size == len(names)
