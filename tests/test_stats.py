import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfare.functions import stats


@pytest.mark.parametrize(
    "t, df, p",
    [(2.228139, 10, 0.05), (1.959964, 1e9, 0.05), (12.7062, 1, 0.05), (0.0, 5, 1.0), (3.169273, 10, 0.01), (-2.228139, 10, 0.05)],
)
def test_t_tail(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize("df, q", [(1, 12.7062), (10, 2.228139), (30, 2.042272), (1e7, 1.959964)])
def test_t_quantile(df, q):
    assert stats.t_quantile(0.975, df) == pytest.approx(q, rel=1e-5)


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (2.0, 10, 0.996340), (0.0, 3, 1.0)])
def test_chi2_tail(x, df, p):
    assert stats.chi2_upper(x, df) == pytest.approx(p, rel=1e-5)


def test_normal_tail():
    assert stats.normal_upper(1.644854) == pytest.approx(0.05, rel=1e-5)
    assert stats.normal_upper(-1.644854) == pytest.approx(0.95, rel=1e-5)


def test_shapiro_separates_shapes():
    rng = np.random.default_rng(1)
    w, p = stats.shapiro_wilk(rng.normal(size=200))
    assert w > 0.98 and p > 0.05
    w, p = stats.shapiro_wilk(rng.exponential(size=200))
    assert w < 0.9 and p < 1e-6
    assert math.isnan(stats.shapiro_wilk(np.ones(20))[0])


def test_shapiro_small_samples():
    """Published values for 11 and 3 values, and the ends of the range."""
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 5), round(p, 5)) == (0.78881, 0.00670)
    w, p = stats.shapiro_wilk([1, 2, 4])
    assert (round(w, 5), round(p, 4)) == (0.96429, 0.6369)
    for n in range(3, 14):
        w, p = stats.shapiro_wilk(np.arange(n))
        assert 0.9 < w <= 1 and 0.5 < p <= 1
        w, p = stats.shapiro_wilk([*range(n - 1), 1e6])
        assert w < 0.8 and p < 0.06
    assert math.isnan(stats.shapiro_wilk([1, 2])[0]) and math.isnan(stats.shapiro_wilk([5, 5, 5])[0])


def test_shapiro_known_sample():
    # The weights of 11 men in the paper of 1965 are too few for this range; a symmetric grid is exact.
    x = np.array([stats._NORMAL.inv_cdf((i - 0.375) / 50.25) for i in range(1, 51)])
    w, p = stats.shapiro_wilk(x)
    assert w > 0.995 and p > 0.99


def test_columns(spark):
    df = spark.createDataFrame([(2.228139, 10), (None, 10)], "t double, df int")
    got = df.select(stats.t_pvalue(F.col("t"), F.col("df")).alias("p"), stats.t_critical(0.95, F.col("df")).alias("q")).collect()
    assert got[0]["p"] == pytest.approx(0.05, rel=1e-4) and got[1]["p"] is None
    assert got[0]["q"] == pytest.approx(2.228139, rel=1e-5)
    marks = spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.5,), (None,)], "p double")
    assert [r[0] for r in marks.select(stats.stars(F.col("p"))).collect()] == ["***", "**", "*", "ns", None]
    sizes = spark.createDataFrame([(-0.9,), (0.5,), (0.2,), (0.1,)], "d double")
    assert [r[0] for r in sizes.select(stats.effect_label(F.col("d"))).collect()] == ["Large", "Medium", "Small", "Negligible"]
