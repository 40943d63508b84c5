"""Two-arm experiments: tests, effect sizes, intervals, subgroups, balance, business case.

The rows are read once per table: conditional aggregates give count, mean and variance of both arms, and
grouping sets add the subgroups. Test statistics are arithmetic on those few rows; only p-values and t
quantiles leave native columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfare.functions import stats
from voxfare.functions.scores import holds, known_number, safe_ratio
from voxfare.operators.ranking import prefix_sum, take_lowest, with_value

CONTROL, TREATMENT = "Control", "Treatment"

# The assumptions of the roll-out projection.
BUSINESS_PARAMS = {
    "annual_pax_economy": 25_000_000.0,
    "annual_pax_business": 5_000_000.0,
    "complaint_cost": 85.0,
    "economy_meal_cost": 4.50,
    "business_meal_cost": 12.00,
}
NPS_PER_POINT = 8.0
ROLLOUT_SHARES = {"economy": 0.7, "business": 0.24}


def arm_stats(
    df: DataFrame, arm: str, metrics: Sequence[str], dims: Sequence[str] = (),
    treatment: str = TREATMENT, control: str = CONTROL,
) -> DataFrame:
    """Count, mean and sample variance of each metric in both arms, overall and per value of each dimension.

    One row per (dimension, level, metric); the overall rows have dimension ``all``.
    """
    parts = []
    for m in metrics:
        fields = [F.lit(m).alias("metric")]
        for prefix, name in (("t", treatment), ("c", control)):
            x = F.when(F.col(arm) == name, known_number(m))
            fields += [
                F.count(x).alias(f"{prefix}_n"),
                F.avg(x).alias(f"{prefix}_mean"),
                F.var_samp(x).alias(f"{prefix}_var"),
            ]
        parts.append(F.struct(*fields))
    aggs = [p.alias(f"__m{i}") for i, p in enumerate(parts)]
    used = df.select(arm, *dims, *metrics).filter(F.col(arm).isin(treatment, control))
    if dims:
        sets = [[], *[[d] for d in dims]]
        grouped = used.groupingSets(sets, *dims).agg(*[F.grouping(d).alias(f"__g_{d}") for d in dims], *aggs)
        dim, level = F.lit("all"), F.lit("all")
        for d in dims:
            dim = F.when(F.col(f"__g_{d}") == 0, d).otherwise(dim)
            level = F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(level)
        grouped = grouped.withColumn("dimension", dim).withColumn("level", level).filter(F.col("level").isNotNull())
    else:
        grouped = used.agg(*aggs).withColumn("dimension", F.lit("all")).withColumn("level", F.lit("all"))
    each = F.explode(F.array(*[F.col(f"__m{i}") for i in range(len(parts))]))
    return grouped.select("dimension", "level", each.alias("s")).select("dimension", "level", "s.*")


def t_test(arms: DataFrame) -> DataFrame:
    """Pooled-variance t statistic and degrees of freedom, treatment minus control."""
    n1, n2 = F.col("t_n"), F.col("c_n")
    df = n1 + n2 - 2
    pooled = safe_ratio((n1 - 1) * F.col("t_var") + (n2 - 1) * F.col("c_var"), df)
    se = F.sqrt(pooled * (safe_ratio(F.lit(1), n1) + safe_ratio(F.lit(1), n2)))
    return arms.withColumn("t_stat", safe_ratio(F.col("t_mean") - F.col("c_mean"), se)).withColumn("df", df)


def effects(arms: DataFrame) -> DataFrame:
    """Absolute and percent lift and Cohen's d over the unweighted mean of both variances."""
    lift = F.col("t_mean") - F.col("c_mean")
    spread = F.sqrt((F.col("t_var") + F.col("c_var")) / 2)
    return (
        arms.withColumn("lift", lift)
        .withColumn("lift_pct", safe_ratio(lift * 100, F.col("c_mean")))
        .withColumn("cohens_d", safe_ratio(lift, spread))
        .withColumn("effect", stats.effect_label(F.col("cohens_d")))
    )


def with_p(tests: DataFrame) -> DataFrame:
    """Two-sided p-value and significance marks of t tests."""
    return tests.withColumn("p_value", stats.t_pvalue(F.col("t_stat"), F.col("df"))).withColumn(
        "stars", stats.stars(F.col("p_value"))
    )


def intervals(arms: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Interval of both means; of the lift by the outer limits; and of the difference by Welch's rule."""
    t_se2, c_se2 = safe_ratio(F.col("t_var"), F.col("t_n")), safe_ratio(F.col("c_var"), F.col("c_n"))
    welch_df = safe_ratio(
        (t_se2 + c_se2) * (t_se2 + c_se2),
        safe_ratio(t_se2 * t_se2, F.col("t_n") - 1) + safe_ratio(c_se2 * c_se2, F.col("c_n") - 1),
    )
    wide = (
        arms.withColumn("__th", stats.t_critical(confidence, F.col("t_n") - 1) * F.sqrt(t_se2))
        .withColumn("__ch", stats.t_critical(confidence, F.col("c_n") - 1) * F.sqrt(c_se2))
        .withColumn("__dh", stats.t_critical(confidence, welch_df) * F.sqrt(t_se2 + c_se2))
    )
    t, c, d = F.col("t_mean"), F.col("c_mean"), F.col("t_mean") - F.col("c_mean")
    return wide.select(
        *arms.columns,
        (t - F.col("__th")).alias("t_low"),
        (t + F.col("__th")).alias("t_high"),
        (c - F.col("__ch")).alias("c_low"),
        (c + F.col("__ch")).alias("c_high"),
        (t - F.col("__th") - c - F.col("__ch")).alias("lift_low"),
        (t + F.col("__th") - c + F.col("__ch")).alias("lift_high"),
        (d - F.col("__dh")).alias("welch_low"),
        (d + F.col("__dh")).alias("welch_high"),
    )


def mann_whitney(
    df: DataFrame, arm: str, metric: str, by: Sequence[str] = (),
    treatment: str = TREATMENT, control: str = CONTROL, few: bool = False,
) -> DataFrame:
    """U of the treatment arm with tie-corrected, continuity-corrected z (alternative: greater).

    Rank sums come from value counts and a distributed running sum; no arm is ever sorted in one task.
    """
    by = list(by)
    known = with_value(df.filter(F.col(arm).isin(treatment, control)), metric)
    for b in by:
        known = known.filter(F.col(b).isNotNull())
    counts = known.groupBy(*by, metric).agg(
        F.count_if(F.col(arm) == treatment).alias("a"), F.count_if(F.col(arm) == control).alias("b")
    )
    run = prefix_sum(counts, metric, ["b"], by, few=few)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ties = a + b
    u = F.sum(a * (F.col("cum_b") - b + b / 2))
    table = run.groupBy(*by).agg(
        F.sum("a").alias("n_t"), F.sum("b").alias("n_c"), u.alias("u_stat"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
    )
    n1, n2 = F.col("n_t").cast("double"), F.col("n_c").cast("double")
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - safe_ratio(F.col("tie_term"), n * (n - 1))))
    return table.withColumn("z", safe_ratio(F.col("u_stat") - n1 * n2 / 2 - 0.5, sigma))


def with_normal_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", stats.normal_pvalue(F.col("z"))).withColumn(
        "stars", stats.stars(F.col("p_value"))
    )


def chi2_yates(df: DataFrame, arm: str, flag: str, treatment: str = TREATMENT, control: str = CONTROL) -> DataFrame:
    """Rates of a 0/1 outcome, their difference in points, and chi-squared with Yates' correction."""
    t, c = F.col(arm) == treatment, F.col(arm) == control
    hit = F.col(flag).cast("int") == 1
    counts = df.filter((t | c) & F.col(flag).isNotNull()).agg(
        F.count_if(t & hit).alias("t_yes"),
        F.count_if(t & ~hit).alias("t_no"),
        F.count_if(c & hit).alias("c_yes"),
        F.count_if(c & ~hit).alias("c_no"),
    )
    cells = ("t_yes", "t_no", "c_yes", "c_no")
    ty, tn, cy, cn = (F.col(x).cast("double") for x in cells)
    n, t_n, c_n, yes, no = ty + tn + cy + cn, ty + tn, cy + cn, ty + cy, tn + cn
    expected = [safe_ratio(r * k, n) for r in (t_n, c_n) for k in (yes, no)]
    shift = F.abs(ty - expected[0])
    shift = shift - F.least(F.lit(0.5), shift)
    chi2 = sum((safe_ratio(shift * shift, e) for e in expected[1:]), safe_ratio(shift * shift, expected[0]))
    return counts.select(
        *cells,
        (safe_ratio(ty, t_n) * 100).alias("t_rate"),
        (safe_ratio(cy, c_n) * 100).alias("c_rate"),
        (safe_ratio(cy, c_n) * 100 - safe_ratio(ty, t_n) * 100).alias("reduction_pp"),
        chi2.alias("chi2"),
    )


def with_chi2_p(table: DataFrame, df: int = 1) -> DataFrame:
    return table.withColumn("p_value", stats.chi2_pvalue(F.col("chi2"), F.lit(df))).withColumn(
        "stars", stats.stars(F.col("p_value"))
    )


def normality(df: DataFrame, arm: str, metric: str, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """Shapiro-Wilk on ``n`` rows per arm, taken in hash order."""
    if n > 5000:
        raise ValueError("the approximation holds up to 5,000 values")
    known = df.select(arm, key, F.col(metric).cast("double").alias(metric)).filter(
        F.col(arm).isNotNull() & F.col(metric).isNotNull()
    )
    picked = take_lowest(known, [arm], key, seed, F.lit(n)).filter("__taken").select(arm, metric)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = stats.shapiro_wilk(pdf[metric].to_numpy())
        return pd.DataFrame({arm: [pdf[arm].iloc[0]], "n": [len(pdf)], "w_stat": [w], "p_value": [p]})

    return picked.groupBy(arm).applyInPandas(test, f"`{arm}` string, n bigint, w_stat double, p_value double")


def jarque_bera(df: DataFrame, by: str, metric: str) -> DataFrame:
    """Normality of all rows from skewness and excess kurtosis; missing values and NaN are left out."""
    x = known_number(metric)
    out = (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    )
    return out.withColumn(
        "jb", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    )


def balance(df: DataFrame, arm: str, dims: Sequence[str], treatment: str = TREATMENT, control: str = CONTROL) -> DataFrame:
    """Arm sizes per value of each dimension, from one grouping-sets pass."""
    arm_counts = df.select(arm, *dims).filter(F.col(arm).isin(treatment, control))
    aggs = [F.count_if(F.col(arm) == control).alias("n_control"), F.count_if(F.col(arm) == treatment).alias("n_treatment")]
    out = arm_counts.groupingSets([[d] for d in dims], *dims).agg(*[F.grouping(d).alias(f"__g_{d}") for d in dims], *aggs)
    dim, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.col(f"__g_{d}") == 0, d).otherwise(dim)
        level = F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")).otherwise(level)
    return out.select(dim.alias("dimension"), level.alias("level"), "n_control", "n_treatment").filter(
        F.col("level").isNotNull()
    )


def sample_ratio(df: DataFrame, arm: str, expected: float = 0.5, treatment: str = TREATMENT, control: str = CONTROL) -> DataFrame:
    """Chi-squared test of the planned split of the arms."""
    counts = df.agg(
        F.count_if(F.col(arm) == treatment).alias("n_treatment"), F.count_if(F.col(arm) == control).alias("n_control")
    )
    n = F.col("n_treatment") + F.col("n_control")
    dev = F.col("n_treatment") - n * expected
    return counts.withColumn("chi2", safe_ratio(dev * dev, n * expected) + safe_ratio(dev * dev, n * (1 - expected)))


def rate_by(df: DataFrame, key: str, arm: str, flag: str, treatment: str = TREATMENT, control: str = CONTROL) -> DataFrame:
    """Percent of a 0/1 outcome per key, one column per arm."""
    x = F.col(flag).cast("double") * 100
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.avg(F.when(F.col(arm) == control, x)).alias("control_pct"),
            F.avg(F.when(F.col(arm) == treatment, x)).alias("treatment_pct"),
        )
    )


def result_table(
    df: DataFrame, arm: str, primary: str, others: Sequence[str], flag: str,
    treatment: str = TREATMENT, control: str = CONTROL,
) -> DataFrame:
    """Metric, test, statistic, p-value, marks and effect of every test, one row each."""
    t = effects(with_p(t_test(arm_stats(df, arm, [primary, *others], (), treatment, control))))
    u = with_normal_p(mann_whitney(df, arm, primary, (), treatment, control))
    x = with_chi2_p(chi2_yates(df, arm, flag, treatment, control))
    return (
        t.select("metric", F.lit("t").alias("test"), F.col("t_stat").alias("statistic"), "p_value", "stars", F.col("cohens_d").alias("effect_size"))
        .unionByName(
            u.select(F.lit(primary).alias("metric"), F.lit("U").alias("test"), F.col("u_stat").alias("statistic"), "p_value", "stars",
                     safe_ratio(F.col("u_stat"), F.col("n_t") * F.col("n_c")).alias("effect_size"))
        )
        .unionByName(
            x.select(F.lit(flag).alias("metric"), F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value", "stars",
                     F.col("reduction_pp").alias("effect_size"))
        )
    )


def business_case(rates: DataFrame, params: Mapping[str, float] = BUSINESS_PARAMS) -> DataFrame:
    """Yearly projection from the rates in percent: complaints avoided, savings, costs, net; one row per item."""
    p = {k: F.lit(float(v)) for k, v in params.items()}
    avoided = (F.col("c_rate") - F.col("t_rate")) / 100 * p["annual_pax_economy"]
    saving = avoided * p["complaint_cost"]
    economy = -(p["annual_pax_economy"] * p["economy_meal_cost"])
    business = -(p["annual_pax_business"] * p["business_meal_cost"])
    items = {
        "complaints_avoided": avoided,
        "complaint_saving": saving,
        "economy_cost": economy,
        "business_cost": business,
        "net": saving + economy + business,
    }
    listed = F.array(*[F.struct(F.lit(k).alias("item"), v.cast("double").alias("amount")) for k, v in items.items()])
    return rates.select(F.explode(listed).alias("x")).select("x.*")


def nps_scenarios(
    lifts: DataFrame, economy: str, business: str, shares: Mapping[str, float] = ROLLOUT_SHARES, factor: float = NPS_PER_POINT
) -> DataFrame:
    """Roll-out scenarios from a lift table (``dimension``, ``level``, ``lift``): partial, two cabins, full."""
    overall = F.max(F.when(F.col("dimension") == "all", F.col("lift")))
    eco = F.max(F.when(F.col("level") == economy, F.col("lift")))
    biz = F.max(F.when(F.col("level") == business, F.col("lift")))
    items = {
        "economy only": overall * shares["economy"] * factor,
        "economy and business": (eco * shares["economy"] + biz * shares["business"]) * factor,
        "full fleet": overall * factor,
    }
    listed = F.array(*[F.struct(F.lit(k).alias("scenario"), v.alias("nps_gain")) for k, v in items.items()])
    return lifts.agg(listed.alias("a")).select(F.explode("a").alias("x")).select("x.*")
