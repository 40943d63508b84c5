import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfare.functions import stats
from voxfare.operators import distributions, experiment


@pytest.fixture(scope="module")
def trial(spark):
    rnd = random.Random(9)
    data = []
    for i in range(600):
        arm = "Treatment" if i % 2 else "Control"
        data.append((i, arm, rnd.choice("EB"), round(rnd.gauss(3.9 if i % 2 else 3.6, 0.5), 1), int(rnd.random() < (0.04 if i % 2 else 0.2))))
    return spark.createDataFrame(data, "id int, arm string, cabin string, x double, bad int").persist()


def arrays(trial, cabin=None):
    rows = [r for r in trial.collect() if cabin is None or r["cabin"] == cabin]
    return tuple(np.array([r["x"] for r in rows if r["arm"] == a]) for a in ("Treatment", "Control"))


def test_t_test_and_effects(trial):
    out = experiment.effects(experiment.with_p(experiment.t_test(experiment.arm_stats(trial, "arm", ["x"], ["cabin"]))))
    got = {r["level"]: r for r in out.collect()}
    assert set(got) == {"all", "E", "B"}
    for level, r in got.items():
        t, c = arrays(trial, None if level == "all" else level)
        n1, n2 = len(t), len(c)
        sp = ((n1 - 1) * t.var(ddof=1) + (n2 - 1) * c.var(ddof=1)) / (n1 + n2 - 2)
        stat = (t.mean() - c.mean()) / math.sqrt(sp * (1 / n1 + 1 / n2))
        assert r["t_stat"] == pytest.approx(stat) and r["df"] == n1 + n2 - 2
        assert r["p_value"] == pytest.approx(stats.t_two_sided(stat, n1 + n2 - 2))
        assert r["cohens_d"] == pytest.approx((t.mean() - c.mean()) / math.sqrt((t.var(ddof=1) + c.var(ddof=1)) / 2))
        assert r["stars"] == "***" and r["effect"] in ("Medium", "Small", "Large")


@pytest.mark.parametrize("few", [True, False])
def test_mann_whitney_brute_force(trial, few):
    t, c = arrays(trial)
    u = sum((a > c).sum() + 0.5 * (a == c).sum() for a in t)
    r = experiment.mann_whitney(trial, "arm", "x", few=few).first()
    assert r["u_stat"] == pytest.approx(u)
    other = experiment.mann_whitney(trial, "arm", "x", treatment="Control", control="Treatment").first()
    assert r["u_stat"] + other["u_stat"] == pytest.approx(len(t) * len(c))
    _, ties = np.unique(np.concatenate([t, c]), return_counts=True)
    n = len(t) + len(c)
    sigma = math.sqrt(len(t) * len(c) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    assert r["z"] == pytest.approx((u - len(t) * len(c) / 2 - 0.5) / sigma)


def test_yates(spark):
    cells = [("Treatment", 1)] * 30 + [("Treatment", 0)] * 10 + [("Control", 1)] * 20 + [("Control", 0)] * 20
    r = experiment.with_chi2_p(experiment.chi2_yates(spark.createDataFrame(cells, "arm string, f int"), "arm", "f")).first()
    assert r["chi2"] == pytest.approx(4.32) and r["p_value"] == pytest.approx(0.03767, abs=1e-5)
    assert (r["t_rate"], r["c_rate"], r["reduction_pp"]) == (75.0, 50.0, -25.0)
    even = [("Treatment", 1), ("Treatment", 0), ("Control", 1), ("Control", 0)]
    assert experiment.chi2_yates(spark.createDataFrame(even, "arm string, f int"), "arm", "f").first()["chi2"] == 0.0


def test_intervals(trial):
    r = experiment.intervals(experiment.arm_stats(trial, "arm", ["x"])).first()
    t, c = arrays(trial)
    half = stats.t_quantile(0.975, len(t) - 1) * t.std(ddof=1) / math.sqrt(len(t))
    assert r["t_low"] == pytest.approx(t.mean() - half) and r["t_high"] == pytest.approx(t.mean() + half)
    assert r["lift_low"] == pytest.approx(r["t_low"] - r["c_high"]) and r["lift_high"] == pytest.approx(r["t_high"] - r["c_low"])
    assert r["lift_low"] < r["welch_low"] < r["welch_high"] < r["lift_high"]


def test_normality_and_balance(trial, rows):
    got = experiment.normality(trial, "arm", "x", "id", 100).collect()
    assert {r["arm"] for r in got} == {"Treatment", "Control"} and all(r["n"] == 100 and r["w_stat"] > 0.9 for r in got)
    with pytest.raises(ValueError):
        experiment.normality(trial, "arm", "x", "id", 6000)
    bal = experiment.balance(trial, "arm", ["cabin"])
    assert bal.agg(F.sum("n_control"), F.sum("n_treatment")).first() == (300, 300)
    assert experiment.sample_ratio(trial, "arm").first()["chi2"] == 0.0


def test_result_table(trial):
    got = {(r["metric"], r["test"]) for r in experiment.result_table(trial, "arm", "x", [], "bad").collect()}
    assert got == {("x", "t"), ("x", "U"), ("bad", "chi2")}


def test_business_case(spark):
    rates = spark.createDataFrame([(4.0, 8.0)], "t_rate double, c_rate double")
    got = {r["item"]: r["amount"] for r in experiment.business_case(rates).collect()}
    assert got["complaints_avoided"] == pytest.approx(1_000_000) and got["complaint_saving"] == pytest.approx(85e6)
    assert got["net"] == pytest.approx(85e6 - 112.5e6 - 60e6)
    lifts = spark.createDataFrame([("all", "all", 0.3), ("cabin", "E", 0.4), ("cabin", "B", 0.1)], "dimension string, level string, lift double")
    nps = {r["scenario"]: r["nps_gain"] for r in experiment.nps_scenarios(lifts, "E", "B").collect()}
    assert nps == {"economy only": pytest.approx(1.68), "economy and business": pytest.approx(2.432), "full fleet": pytest.approx(2.4)}


def test_kde_brute_force(trial):
    got = distributions.kde(trial, "x", "arm", points=50).orderBy("i")
    t, _ = arrays(trial)
    mine = [r for r in got.collect() if r["arm"] == "Treatment"]
    h = t.std(ddof=1) * len(t) ** -0.2
    span = t.max() - t.min()
    grid = np.linspace(t.min() - span / 2, t.max() + span / 2, 50)
    want = np.exp(-(((grid[:, None] - t[None, :]) / h) ** 2) / 2).sum(1) / (len(t) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in mine] == pytest.approx(grid) and [r["density"] for r in mine] == pytest.approx(want)


def test_distributions(spark, trial):
    df = spark.createDataFrame([("a", 0.5), ("a", 10.5), ("a", 10.4), ("a", 11.0), ("a", None), ("b", 3.0)], "g string, v double")
    h = {(r["g"], r["bin"]): r["n"] for r in distributions.histogram(df, "v", 0.5, 10.5, 10, ["g"]).collect()}
    assert len(h) == 20 and h[("a", 1)] == 1 and h[("a", 10)] == 2 and h[("b", 3)] == 1 and h[("b", 10)] == 0
    e = [(r["x"], r["cdf"]) for r in distributions.ecdf(trial, "x", ["arm"]).filter("arm = 'Control'").orderBy("x").collect()]
    assert e[-1][1] == 1.0 and all(a[1] < b[1] for a, b in zip(e, e[1:]))


def test_regression_uses_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 100.0), (50.0, None)], "x double, y double")
    fit = distributions.linreg(df, "x", "y")
    r = fit.first()
    assert (r["slope"], r["intercept"], r["n"], r["x_max"]) == (pytest.approx(2.0), pytest.approx(1.0), 3, 3.0)
    line = distributions.fitted_line(fit, 3).orderBy("i").collect()
    assert [(p["x"], p["y"]) for p in line] == [(1.0, pytest.approx(3.0)), (2.0, pytest.approx(5.0)), (3.0, pytest.approx(7.0))]
    m = distributions.corr_matrix(df.withColumn("z", -F.col("x")), ["x", "y", "z"])
    assert {(q["row_field"], q["col_field"]): round(q["r"], 6) for q in m.collect()} == {("y", "x"): 1.0, ("z", "x"): -1.0, ("z", "y"): -1.0}


def test_jitter_stays_near_and_repeats(spark):
    df = spark.range(100).select("id", F.lit(1.0).alias("x"), F.lit(5.0).alias("y"))
    a, b = (distributions.jittered(d, "x", "y", "id").orderBy("id").collect() for d in (df, df.repartition(5)))
    assert a == b and all(abs(r["x"] - 1) <= 0.1 and abs(r["y"] - 5) <= 0.3 for r in a) and len({r["x"] for r in a}) > 90
