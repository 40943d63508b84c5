"""Distributions, correlations and the experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfare.operators import distributions, experiment, ranking, summaries
from voxfare.plans.registry import day, query, rounded

METRICS = ("meal_satisfaction", "meal_finish_rate", "overall_sat_impact")


@query(
    "hist_density",
    """WITH g AS (SELECT recommended, least(floor(rating_10 - 0.5), 9) AS b, count(*) AS n FROM rated WHERE rating_10 BETWEEN 0.5 AND 10.5 GROUP BY 1, 2),
      t AS (SELECT recommended, sum(n) AS total FROM g GROUP BY 1)
      SELECT t.recommended, CAST(i AS INTEGER) AS bin, i - 0.5 AS bin_low, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS density
      FROM t CROSS JOIN range(1, 11) r(i) LEFT JOIN g ON g.recommended = t.recommended AND g.b = i - 1""",
    ("rated",),
)
def hist_density(t):
    return rounded(distributions.histogram(t.rated, "rating_10", 0.5, 10.5, 10, ["recommended"]), "density")


@query(
    "five_number",
    """SELECT test_group, count(spend) AS n, min(spend) AS min, max(spend) AS max, round(quantile_cont(spend, 0.25), 6) AS q1,
      round(median(spend), 6) AS median, round(quantile_cont(spend, 0.75), 6) AS q3 FROM trial GROUP BY test_group""",
    ("trial",),
)
def five_number(t):
    return rounded(distributions.five_number(t.trial, "spend", ["test_group"]), "q1", "median", "q3")


@query(
    "rating_quartiles_by_cabin",
    """SELECT seat_type, count(rating_10) AS n, min(rating_10) AS min, max(rating_10) AS max, quantile_cont(rating_10, 0.25) AS q1,
      median(rating_10) AS median, quantile_cont(rating_10, 0.75) AS q3 FROM rated GROUP BY seat_type""",
    ("rated",),
)
def rating_quartiles_by_cabin(t):
    return distributions.five_number(t.rated, "rating_10", ["seat_type"])


@query(
    "ecdf",
    """SELECT test_group, meal_satisfaction, n, round(sum(n) OVER (PARTITION BY test_group ORDER BY meal_satisfaction) / sum(n) OVER (PARTITION BY test_group), 6) AS cdf
      FROM (SELECT test_group, meal_satisfaction, count(*) AS n FROM trial GROUP BY 1, 2)""",
    ("trial",),
)
def ecdf(t):
    return rounded(distributions.ecdf(t.trial, "meal_satisfaction", ["test_group"], few=True), "cdf")  # whole units


@query(
    "ecdf_open_metric",
    """SELECT o_totalprice, n, round(sum(n) OVER (ORDER BY o_totalprice) / sum(n) OVER (), 6) AS cdf
      FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)""",
)
def ecdf_open_metric(t):
    return rounded(distributions.ecdf(t.orders, "o_totalprice"), "cdf")


@query(
    "ecdf_zero_inflated",
    """SELECT l_returnflag, excess, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY excess) / sum(n) OVER (PARTITION BY l_returnflag), 6) AS cdf
      FROM (SELECT l_returnflag, greatest(l_extendedprice - 60000, 0) AS excess, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
)
def ecdf_zero_inflated(t):
    """A column that is zero in most rows."""
    rows = t.lineitem.select("l_returnflag", F.greatest(F.col("l_extendedprice") - 60000, F.lit(0.0)).alias("excess"))
    return rounded(distributions.ecdf(rows, "excess", ["l_returnflag"]), "cdf")


@query(
    "quantiles_by_day",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.1), 6) AS p10,
      round(median(value), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2""",
)
def quantiles_by_day(t):
    rows = t.events.withColumn("day", day("ts"))
    return rounded(ranking.exact_quantiles(rows, "value", {"p10": 0.1, "median": 0.5, "p99": 0.99}, ["day", "event_type"]), "p10", "median", "p99")


@query(
    "kde_grid",
    """WITH s AS (SELECT test_group, count(*) AS n, stddev_samp(meal_satisfaction) * pow(count(*), -0.2) AS h,
        min(meal_satisfaction) AS lo, max(meal_satisfaction) AS hi FROM trial GROUP BY 1),
      g AS (SELECT s.*, CAST(i AS INTEGER) AS i, (lo - 0.5 * (hi - lo)) + i * ((hi - lo) * 2) / 999 AS x FROM s CROSS JOIN range(1000) r(i)),
      v AS (SELECT test_group, meal_satisfaction AS v, count(*) AS c FROM trial GROUP BY 1, 2)
      SELECT g.test_group, i, round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
      FROM g JOIN v ON g.test_group = v.test_group GROUP BY g.test_group, i, x""",
    ("trial",),
)
def kde_grid(t):
    curve = distributions.kde(t.trial, "meal_satisfaction", "test_group")
    return rounded(rounded(curve, "x"), "density", places=8)


@query(
    "corr_with_target",
    """WITH c AS (SELECT corr(seat_comfort, rating_10) AS a, corr(value_for_money, rating_10) AS b, corr(TRY_CAST(wifi_text AS DOUBLE), rating_10) AS c FROM scored),
      l AS (SELECT 'seat_comfort' AS field, a AS r FROM c UNION ALL SELECT 'value_for_money', b FROM c UNION ALL SELECT 'wifi', c FROM c)
      SELECT field, round(r, 8) AS r, CASE WHEN r >= 0.7 THEN 'strong' WHEN r >= 0.5 THEN 'moderate' ELSE 'weak' END AS tier FROM l""",
    ("scored",),
)
def corr_with_target(t):
    df = t.scored.withColumn("wifi", F.col("wifi_text").try_cast("double"))
    return rounded(distributions.corr_with(df, ["seat_comfort", "value_for_money", "wifi"], "rating_10"), "r", places=8)


CORR_FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row_field, '{b}' AS col_field, round(corr({a}, {b}), 8) AS r FROM lineitem"
        for i, a in enumerate(CORR_FIELDS)
        for b in CORR_FIELDS[:i]
    ),
)
def corr_matrix(t):
    return rounded(distributions.corr_matrix(t.lineitem, CORR_FIELDS), "r", places=8)


@query(
    "linreg",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
      round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem""",
)
def linreg(t):
    out = rounded(distributions.linreg(t.lineitem, "l_quantity", "l_extendedprice"), "slope", "intercept", places=4)
    return rounded(out, "r", places=8)


@query(
    "linreg_line",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
      SELECT CAST(i AS INTEGER) AS i, round(lo + i * (hi - lo) / 99, 6) AS x, round(a + b * (lo + i * (hi - lo) / 99), 4) AS y FROM f CROSS JOIN range(100) r(i)""",
)
def linreg_line(t):
    line = distributions.fitted_line(distributions.linreg(t.lineitem, "l_quantity", "l_extendedprice"))
    return rounded(rounded(line, "x"), "y", places=4)


@query(
    "jittered_points",
    """SELECT review_id, round(value_for_money + (CAST('0x' || md5('43:' || review_id)[1:8] AS BIGINT) / 4294967296 * 2 - 1) * 0.1, 6) AS x,
      round(rating_10 + (CAST('0x' || md5('44:' || review_id)[1:8] AS BIGINT) / 4294967296 * 2 - 1) * 0.3, 6) AS y
      FROM scored WHERE value_for_money IS NOT NULL AND rating_10 IS NOT NULL""",
    ("scored",),
)
def jittered_points(t):
    pts = distributions.jittered(t.scored, "value_for_money", "rating_10", "review_id")
    return rounded(pts, "x", "y")


# ---------------------------------------------------------------- experiment

def _arm_sql(metric: str, dim: str = "'all'", level: str = "'all'", group: str = "") -> str:
    stats = ", ".join(
        f"{f}({metric}) FILTER (test_group = '{name}') AS {p}_{s}"
        for p, name in (("t", "Treatment"), ("c", "Control"))
        for f, s in (("count", "n"), ("avg", "mean"), ("var_samp", "var"))
    )
    return f"SELECT {dim} AS dimension, {level} AS level, '{metric}' AS metric, {stats} FROM trial_tiers {group}"


T_SQL = "(t_mean - c_mean) / sqrt(((t_n - 1) * t_var + (c_n - 1) * c_var) / (t_n + c_n - 2) * (1.0 / t_n + 1.0 / c_n))"
D_SQL = "(t_mean - c_mean) / sqrt((t_var + c_var) / 2)"
EFFECT_SQL = f"CASE WHEN abs({D_SQL}) >= 0.8 THEN 'Large' WHEN abs({D_SQL}) >= 0.5 THEN 'Medium' WHEN abs({D_SQL}) >= 0.2 THEN 'Small' ELSE 'Negligible' END"


@query(
    "ab_ttest",
    f"""SELECT dimension, level, metric, t_n, c_n, round(t_mean, 6) AS t_mean, round(c_mean, 6) AS c_mean, round({T_SQL}, 6) AS t_stat, t_n + c_n - 2 AS df
      FROM ({" UNION ALL ".join(_arm_sql(m) for m in METRICS).replace("trial_tiers", "trial")})""",
    ("trial",),
)
def ab_ttest(t):
    out = experiment.t_test(experiment.arm_stats(t.trial, "test_group", METRICS))
    return rounded(out.drop("t_var", "c_var"), "t_mean", "c_mean", "t_stat")


@query(
    "ab_effect_lift",
    f"""SELECT metric, round(t_mean - c_mean, 6) AS lift, round((t_mean - c_mean) * 100 / c_mean, 6) AS lift_pct,
      round({D_SQL}, 6) AS cohens_d, {EFFECT_SQL} AS effect FROM ({" UNION ALL ".join(_arm_sql(m) for m in METRICS).replace("trial_tiers", "trial")})""",
    ("trial",),
)
def ab_effect_lift(t):
    out = experiment.effects(experiment.arm_stats(t.trial, "test_group", METRICS))
    return rounded(out.select("metric", "lift", "lift_pct", "cohens_d", "effect"), "lift", "lift_pct", "cohens_d")


DIMS = ("cabin_class", "route", "loyalty_tier")


@query(
    "ab_subgroups",
    f"""SELECT dimension, level, t_n, c_n, round(t_mean, 6) AS t_mean, round(c_mean, 6) AS c_mean, round(t_mean - c_mean, 6) AS lift,
      round({T_SQL}, 6) AS t_stat, round({D_SQL}, 6) AS cohens_d FROM ({" UNION ALL ".join(
        [_arm_sql("meal_satisfaction")] + [_arm_sql("meal_satisfaction", f"'{d}'", d, f"GROUP BY {d}") for d in DIMS])})""",
    ("trial_tiers",),
)
def ab_subgroups(t):
    out = experiment.effects(experiment.t_test(experiment.arm_stats(t.trial_tiers, "test_group", ["meal_satisfaction"], DIMS)))
    kept = out.select("dimension", "level", "t_n", "c_n", "t_mean", "c_mean", "lift", "t_stat", "cohens_d")
    return rounded(kept, "t_mean", "c_mean", "lift", "t_stat", "cohens_d")


@query("ab_subgroup_pvalues")
def ab_subgroup_pvalues(t):
    out = experiment.with_p(experiment.t_test(experiment.arm_stats(t.trial_tiers, "test_group", ["meal_satisfaction"], DIMS)))
    return rounded(out.select("dimension", "level", "t_stat", "df", "p_value", "stars"), "t_stat", "p_value")


@query("ab_ci")
def ab_ci(t):
    out = experiment.intervals(experiment.arm_stats(t.trial, "test_group", METRICS))
    cols = ("t_low", "t_high", "c_low", "c_high", "lift_low", "lift_high", "welch_low", "welch_high")
    return rounded(out.select("metric", *cols), *cols)


MW_SQL = """WITH v AS (SELECT {by}{m} AS v, count(*) FILTER (test_group = 'Treatment') AS a, count(*) FILTER (test_group = 'Control') AS b FROM trial GROUP BY {by}{m}),
  c AS (SELECT *, coalesce(sum(b) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
  s AS (SELECT {by}CAST(sum(a) AS BIGINT) AS n_t, CAST(sum(b) AS BIGINT) AS n_c, CAST(sum(a * (below + b / 2)) AS DOUBLE) AS u_stat,
    sum(pow(CAST(a + b AS DOUBLE), 3) - (a + b)) AS tie_term FROM c {group})
  SELECT {by}n_t, n_c, u_stat, tie_term, round((u_stat - n_t * 1.0 * n_c / 2 - 0.5) / sqrt(n_t * 1.0 * n_c / 12 * (n_t + n_c + 1 - tie_term / ((n_t + n_c) * 1.0 * (n_t + n_c - 1)))), 6) AS z FROM s"""


@query("ab_mannwhitney", MW_SQL.format(by="", m="meal_satisfaction", part="", group=""), ("trial",))
def ab_mannwhitney(t):
    return rounded(experiment.mann_whitney(t.trial, "test_group", "meal_satisfaction", few=True), "z")  # whole units


@query("ab_mannwhitney_open", MW_SQL.format(by="", m="spend", part="", group=""), ("trial",))
def ab_mannwhitney_open(t):
    """The same test on an open metric, through range buckets."""
    return rounded(experiment.mann_whitney(t.trial, "test_group", "spend"), "z")


@query(
    "ab_mannwhitney_by_cabin",
    MW_SQL.format(by="cabin_class, ", m="meal_satisfaction", part="PARTITION BY cabin_class ", group="GROUP BY cabin_class"),
    ("trial",),
)
def ab_mannwhitney_by_cabin(t):
    return rounded(experiment.mann_whitney(t.trial, "test_group", "meal_satisfaction", ["cabin_class"], few=True), "z")


@query(
    "ab_chi2_yates",
    """WITH k AS (SELECT count(*) FILTER (test_group = 'Treatment' AND meal_complaint = 1) AS t_yes, count(*) FILTER (test_group = 'Treatment' AND meal_complaint = 0) AS t_no,
        count(*) FILTER (test_group = 'Control' AND meal_complaint = 1) AS c_yes, count(*) FILTER (test_group = 'Control' AND meal_complaint = 0) AS c_no FROM trial)
      SELECT *, round(t_yes * 100.0 / (t_yes + t_no), 6) AS t_rate, round(c_yes * 100.0 / (c_yes + c_no), 6) AS c_rate,
        round(c_yes * 100.0 / (c_yes + c_no) - t_yes * 100.0 / (t_yes + t_no), 6) AS reduction_pp,
        round((t_yes + t_no + c_yes + c_no) * pow(greatest(abs(t_yes * 1.0 * c_no - t_no * 1.0 * c_yes) - (t_yes + t_no + c_yes + c_no) / 2, 0), 2)
          / ((t_yes + t_no) * 1.0 * (c_yes + c_no) * (t_yes + c_yes) * 1.0 * (t_no + c_no)), 6) AS chi2 FROM k""",
    ("trial",),
)
def ab_chi2_yates(t):
    out = experiment.chi2_yates(t.trial, "test_group", "meal_complaint")
    return rounded(out, "t_rate", "c_rate", "reduction_pp", "chi2")


@query("ab_result_table")
def ab_result_table(t):
    out = experiment.result_table(t.trial, "test_group", METRICS[0], METRICS[1:], "meal_complaint")
    return rounded(out, "statistic", "p_value", "effect_size")


@query(
    "ab_balance",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, count(*) FILTER (test_group = 'Control') AS n_control, count(*) FILTER (test_group = 'Treatment') AS n_treatment FROM trial_tiers GROUP BY {d}"
        for d in (*DIMS, "month")
    ),
    ("trial_tiers",),
)
def ab_balance(t):
    return experiment.balance(t.trial_tiers, "test_group", [*DIMS, "month"])


@query(
    "ab_sample_ratio",
    """SELECT n_treatment, n_control, round(pow(n_treatment - (n_treatment + n_control) / 2, 2) / ((n_treatment + n_control) / 2) * 2, 6) AS chi2
      FROM (SELECT count(*) FILTER (test_group = 'Treatment') AS n_treatment, count(*) FILTER (test_group = 'Control') AS n_control FROM trial)""",
    ("trial",),
)
def ab_sample_ratio(t):
    return rounded(experiment.sample_ratio(t.trial, "test_group"), "chi2")


@query(
    "ab_complaint_rates",
    """SELECT cabin_class, round(avg(meal_complaint * 100.0) FILTER (test_group = 'Control'), 6) AS control_pct,
      round(avg(meal_complaint * 100.0) FILTER (test_group = 'Treatment'), 6) AS treatment_pct FROM trial GROUP BY cabin_class""",
    ("trial",),
)
def ab_complaint_rates(t):
    return rounded(experiment.rate_by(t.trial, "cabin_class", "test_group", "meal_complaint"), "control_pct", "treatment_pct")


@query(
    "ab_business_case",
    """WITH r AS (SELECT avg(meal_complaint) FILTER (test_group = 'Control') - avg(meal_complaint) FILTER (test_group = 'Treatment') AS d FROM trial)
      SELECT 'complaints_avoided' AS item, round(d * 25000000, 2) AS amount FROM r UNION ALL SELECT 'complaint_saving', round(d * 25000000 * 85, 2) FROM r
      UNION ALL SELECT 'economy_cost', -112500000.0 UNION ALL SELECT 'business_cost', -60000000.0
      UNION ALL SELECT 'net', round(d * 25000000 * 85 - 112500000 - 60000000, 2) FROM r""",
    ("trial",),
)
def ab_business_case(t):
    rates = experiment.chi2_yates(t.trial, "test_group", "meal_complaint")
    return rounded(experiment.business_case(rates), "amount", places=2)


@query(
    "ab_nps",
    """WITH l AS (SELECT avg(meal_satisfaction) FILTER (test_group = 'Treatment') - avg(meal_satisfaction) FILTER (test_group = 'Control') AS o,
        avg(meal_satisfaction) FILTER (test_group = 'Treatment' AND cabin_class = 'A') - avg(meal_satisfaction) FILTER (test_group = 'Control' AND cabin_class = 'A') AS e,
        avg(meal_satisfaction) FILTER (test_group = 'Treatment' AND cabin_class = 'R') - avg(meal_satisfaction) FILTER (test_group = 'Control' AND cabin_class = 'R') AS b FROM trial)
      SELECT 'economy only' AS scenario, round(o * 0.7 * 8, 6) AS nps_gain FROM l UNION ALL SELECT 'economy and business', round((e * 0.7 + b * 0.24) * 8, 6) FROM l
      UNION ALL SELECT 'full fleet', round(o * 8, 6) FROM l""",
    ("trial",),
)
def ab_nps(t):
    lifts = experiment.effects(experiment.arm_stats(t.trial, "test_group", ["meal_satisfaction"], ["cabin_class"]))
    return rounded(experiment.nps_scenarios(lifts, "A", "R"), "nps_gain")


@query("ab_normality")
def ab_normality(t):
    keyed = t.trial_by_order
    return rounded(experiment.normality(keyed, "test_group", "meal_satisfaction", "row_key"), "w_stat", "p_value")


@query(
    "ab_jarque_bera",
    """WITH m AS (SELECT test_group, count(*) AS n, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4
        FROM (SELECT test_group, meal_satisfaction AS x FROM trial) GROUP BY 1),
      c AS (SELECT test_group, n, m2 - m1 * m1 AS v, m3 - 3 * m1 * m2 + 2 * pow(m1, 3) AS c3, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4) AS c4 FROM m)
      SELECT test_group, n, round(c3 / pow(v, 1.5), 6) AS skew, round(c4 / (v * v) - 3, 6) AS kurt,
        round(n / 6 * (pow(c3 / pow(v, 1.5), 2) + pow(c4 / (v * v) - 3, 2) / 4), 4) AS jb FROM c""",
    ("trial",),
)
def ab_jarque_bera(t):
    out = rounded(experiment.jarque_bera(t.trial, "test_group", "meal_satisfaction"), "skew", "kurt")
    return rounded(out, "jb", places=4)


@query(
    "group_value_prefix_sums",
    """SELECT cabin_class, spend, n, CAST(sum(n) OVER (PARTITION BY cabin_class ORDER BY spend) AS BIGINT) AS cum_n, CAST(sum(n) OVER (PARTITION BY cabin_class) AS BIGINT) AS total_n
      FROM (SELECT cabin_class, spend, count(*) AS n FROM trial GROUP BY 1, 2)""",
    ("trial",),
)
def group_value_prefix_sums(t):
    counts = ranking.value_counts(t.trial, "spend", ["cabin_class"])
    return ranking.prefix_sum(counts, "spend", ["n"], ["cabin_class"])


@query(
    "meal_mix_by_month",
    """SELECT month, test_group, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY test_group), 6) AS share_pct FROM trial GROUP BY 1, 2""",
    ("trial",),
)
def meal_mix_by_month(t):
    return rounded(summaries.mix(t.trial, ["month", "test_group"], ["test_group"]), "share_pct")
