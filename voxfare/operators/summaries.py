"""Frequency, rate, profile, mix, pivot and theme tables.

Every table is a partial + final hash aggregate over the rows; whatever follows (shares, tiers, ranks)
works on the reduced table. Rows with a NULL key are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfare.functions.scores import at_least, at_most, holds, literal_map, safe_ratio, tier
from voxfare.functions.text import NOT_RATED
from voxfare.operators.ranking import local_table, top_k, union_all

# Labels of the ten product themes.
THEME_LABELS = {
    "theme_seat_comfort": "Seat Comfort",
    "theme_cabin_crew": "Cabin Crew",
    "theme_food_beverage": "Food & Beverage",
    "theme_ife": "IFE",
    "theme_wifi": "Wi-Fi",
    "theme_lounge": "Lounge",
    "theme_boarding": "Boarding",
    "theme_cleanliness": "Cleanliness",
    "theme_value": "Value for Money",
    "theme_punctuality": "Punctuality",
}
ALL_CABINS = "All Cabins"
NOT_MENTIONED = "not_mentioned"


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def freq(df: DataFrame, keys: Sequence[str], k: int | None = None, share: bool = False) -> DataFrame:
    """Rows per key; optionally the share of all rows in percent, optionally only the top k."""
    out = _known(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if share:
        total = out.agg(F.sum("n")).scalar()
        out = out.withColumn("share_pct", F.col("n") / total * 100)
    return top_k(out, "n", keys, k) if k else out


def rate(df: DataFrame, keys: Sequence[str], cond: Column, name: str = "rate_pct", among: Column | None = None) -> DataFrame:
    """Percent of rows per key that meet a condition.

    All rows count in the denominator, also those whose answer is missing; ``among`` restricts it.
    """
    base = _known(df, keys)
    if among is not None:
        base = base.filter(among)
    return base.groupBy(*keys).agg((F.avg(holds(cond)) * 100).alias(name), F.count(F.lit(1)).alias("n"))


def profile(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], stats: Sequence[str] = ("mean",)
) -> DataFrame:
    """Mean, count, sample deviation, minimum, maximum and scale median of several metrics per key.

    ``median`` is for rating scales, whose few distinct values make the exact aggregate cheap; for open
    metrics use ``ranking.exact_quantiles``.
    """
    build = {
        "mean": F.avg,
        "n": F.count,
        "sd": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "median": F.median,
    }
    single = len(metrics) == 1
    aggs = [
        build[s](F.col(m)).alias(s if single else (m if stats == ("mean",) else f"{m}_{s}"))
        for m in metrics
        for s in stats
    ]
    return _known(df, keys).groupBy(*keys).agg(*aggs)


def profile_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means per key in long form: one row per key and metric."""
    return profile(df, keys, metrics).unpivot(list(keys), list(metrics), "metric", "mean")


def with_sd_band(df: DataFrame, width: float = 0.5) -> DataFrame:
    """Band of ``width`` deviations around a mean."""
    half = F.col("sd") * width
    return df.select("*", (F.col("mean") - half).alias("band_low"), (F.col("mean") + half).alias("band_high"))


def mean_of_means(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Unweighted mean of the group means: the reference line of a trend."""
    return profile(df, [key], [metric]).agg(F.avg("mean").alias("mean_of_means"))


def rating_story(df: DataFrame, key: str, rating: str, recommended: str, good: float = 70, fair: float = 60) -> DataFrame:
    """Trend table in one pass: mean, median, count, deviation, band, high / low share, recommend rate, tier."""
    high, low = at_least(rating, 8), at_most(rating, 3)
    table = (
        _known(df, [key])
        .groupBy(key)
        .agg(
            F.avg(rating).alias("mean"),
            F.median(rating).alias("median"),  # ten-point scale: at most ten distinct values
            F.count(rating).alias("n"),
            F.stddev_samp(rating).alias("sd"),
            F.bround(safe_ratio(F.sum(high) * 100, F.count(rating)), 1).alias("high_pct"),
            F.bround(safe_ratio(F.sum(low) * 100, F.count(rating)), 1).alias("low_pct"),
            (F.avg(holds(F.col(recommended) == "Yes")) * 100).alias("recommend_pct"),
        )
    )
    return with_sd_band(table).withColumn("recommend_tier", tier("recommend_pct", good, fair))


def pivot_mean(df: DataFrame, row: str, col: str, metric: str, values: Sequence[str]) -> DataFrame:
    """Two-key mean, the second key across; the column values are given, so one pass is enough."""
    return _known(df, [row]).groupBy(row).pivot(col, list(values)).agg(F.avg(metric))


def gap(wide: DataFrame, a: str, b: str, name: str = "gap") -> DataFrame:
    """Difference of two columns of a pivot; rows where either is missing drop out."""
    return wide.withColumn(name, F.col(a) - F.col(b)).filter(F.col(name).isNotNull())


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of two keys, the second across, 0 where a pair never occurs."""
    table = _known(df, [row]).groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return table.fillna(0, list(values))


def with_row_total(table: DataFrame, cols: Sequence[str], name: str = "total") -> DataFrame:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c)
    return table.withColumn(name, total)


def mix(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Percent of each key combination within its group (row- or column-normalised mix)."""
    counts = _known(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*within).agg(F.sum("n").alias("__total"))
    return counts.join(totals, list(within)).select(
        *keys, "n", (F.col("n") / F.col("__total") * 100).alias("share_pct")
    )


def stats_having(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], min_n: int, metric: str) -> DataFrame:
    """Group statistics of the groups with at least ``min_n`` known values of the metric."""
    return (
        _known(df, keys)
        .groupBy(*keys)
        .agg(F.count(metric).alias("n"), *aggs)
        .filter(F.col("n") >= min_n)
    )


def align(df: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """A fixed list of categories in order; missing ones give a row of NULLs, others drop out."""
    dim = local_table(df.sparkSession, f"ord int, {key} string", list(enumerate(categories, start=1)))
    return dim.join(df, key, "left")


def segment_vs_rest(df: DataFrame, cond: Column, key: str, metric: str) -> DataFrame:
    """Means of a segment, of all other rows (NULL segment included) and of everything, in one pass."""
    inside = F.coalesce(cond, F.lit(False))
    return (
        _known(df, [key])
        .groupBy(key)
        .agg(
            F.avg(F.when(inside, F.col(metric))).alias("segment_mean"),
            F.avg(F.when(~inside, F.col(metric))).alias("rest_mean"),
            F.avg(metric).alias("global_mean"),
        )
    )


def sentinel_share(df: DataFrame, cols: Sequence[str], sentinel: str = NOT_RATED) -> DataFrame:
    """Percent of rows that hold the sentinel, per column, from one pass."""
    wide = df.agg(*[(F.avg(holds(F.col(c) == sentinel)) * 100).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "field", "missing_pct")


def kpi_row(df: DataFrame, year: str, rating: str, recommended: str) -> DataFrame:
    """Headline figures: rows, mean, recommend rate and the weakest year, from one grouping by year."""
    by_year = df.groupBy(year).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.sum(rating).alias("__sum"),
        F.count(rating).alias("__rated"),
        F.sum(holds(F.col(recommended) == "Yes")).alias("__yes"),
    )
    mean = safe_ratio(F.col("__sum"), F.col("__rated"))
    worst = F.min(F.when(F.col(year).isNotNull() & mean.isNotNull(), F.struct(mean.alias("m"), F.col(year).alias("y"))))
    return by_year.agg(
        F.sum("__rows").alias("reviews"),
        safe_ratio(F.sum("__sum"), F.sum("__rated")).alias("mean_rating"),
        (safe_ratio(F.sum("__yes"), F.sum("__rows")) * 100).alias("recommend_pct"),
        worst.alias("__w"),
    ).select(
        "reviews", "mean_rating", "recommend_pct",
        F.col("__w")["y"].alias("worst_year"), F.col("__w")["m"].alias("worst_year_mean"),
    )


# ---------------------------------------------------------------- themes and months

def _theme_counts(df: DataFrame, themes: Sequence[str], by: str, null_is_mentioned: bool) -> DataFrame:
    """Mentions and polarities per segment and theme.

    The rows are counted once, all themes side by side; only the reduced table is turned into long form.
    """
    counts = []
    for t in themes:
        said = F.coalesce(F.col(t) != NOT_MENTIONED, F.lit(null_is_mentioned))
        counts.append(
            F.struct(
                F.count_if(said).alias("n_mentioned"),
                *[F.count_if(F.col(t) == p).alias(f"n_{p}") for p in ("positive", "negative", "neutral")],
            ).alias(t)
        )
    wide = df.groupBy(by).agg(*counts)
    pairs = [F.struct(F.lit(t).alias("theme_col"), F.col(t).alias("c")) for t in themes]
    return wide.select(by, F.explode(F.array(*pairs)).alias("p")).select(by, "p.theme_col", "p.c.*")


def theme_summary(
    df: DataFrame, themes: Mapping[str, str], by: str, total: str = ALL_CABINS, null_is_mentioned: bool = False
) -> DataFrame:
    """Mentions and polarity of each theme per segment and over all segments (grouping sets).

    The total takes in rows without a segment; the per-segment rows do not. Other polarities than
    positive, negative and neutral count as mentioned only. A theme nobody mentions gives no row.
    """
    names = literal_map(themes)
    cols = ("n_mentioned", "n_positive", "n_negative", "n_neutral")
    grouped = (
        _theme_counts(df, list(themes), by, null_is_mentioned)
        .groupingSets([["theme_col", by], ["theme_col"]], "theme_col", by)
        .agg(F.grouping(by).alias("__all"), *[F.sum(c).alias(c) for c in cols])
        .filter(((F.col("__all") == 1) | F.col(by).isNotNull()) & (F.col("n_mentioned") > 0))
    )

    def pct(c: str) -> Column:
        return F.bround(F.col(c) / F.col("n_mentioned") * 100, 1)

    return grouped.select(
        names[F.col("theme_col")].alias("theme"),
        "theme_col",
        F.when(F.col("__all") == 1, total).otherwise(F.col(by)).alias(by),
        *cols,
        pct("n_positive").alias("pct_positive"),
        pct("n_negative").alias("pct_negative"),
        pct("n_neutral").alias("pct_neutral"),
        F.bround((F.col("n_positive") - F.col("n_negative")) / F.col("n_mentioned"), 3).alias("sentiment_ratio"),
    )


def theme_negativity(
    df: DataFrame, themes: Mapping[str, str], by: str, null_is_mentioned: bool = False
) -> DataFrame:
    """Percent negative among the mentions of each theme per segment; 0 where nobody mentions it."""
    counts = _theme_counts(_known(df, [by]), list(themes), by, null_is_mentioned)
    return counts.select(
        by,
        "theme_col",
        (F.col("n_negative") / F.greatest(F.col("n_mentioned"), F.lit(1)) * 100).alias("negative_pct"),
    )


def theme_ranking(summary: DataFrame, by: str, total: str = ALL_CABINS) -> DataFrame:
    """Overall themes, the most criticised first."""
    return (
        summary.filter(F.col(by) == total)
        .select("theme", "pct_negative", "pct_positive", "n_mentioned")
        .orderBy(F.desc("pct_negative"), "theme")
    )


def monthly(
    df: DataFrame, year: str, month: str, score: str, rating: str, sentiment: str,
    recommended: str, sarcastic: str, competitor: str,
) -> DataFrame:
    """Thirteen measures per month; an unknown flag counts as false."""

    def pct(cond: Column) -> Column:
        return F.bround(F.avg(holds(cond)) * 100, 1)

    return (
        _known(df, [year, month])
        .groupBy(year, month)
        .agg(
            F.count(F.lit(1)).alias("n_reviews"),
            F.bround(F.avg(score), 4).alias("avg_sentiment_score"),
            F.bround(F.avg(rating), 3).alias("avg_overall_rating"),
            *[
                pct(F.col(sentiment) == s).alias(f"pct_{s}")
                for s in ("positive", "negative", "neutral", "mixed")
            ],
            pct(F.col(recommended) == "Yes").alias("pct_recommended"),
            pct(F.col(sarcastic)).alias("pct_sarcastic"),
            pct(F.col(competitor)).alias("pct_competitor_mention"),
        )
        .withColumn("date", F.make_date(year, month, F.lit(1)))
        .orderBy(year, month)
    )


# ---------------------------------------------------------------- clusters

def _mode(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, ties by value, from value counts."""
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))))
    return counts.groupBy(*by).agg(best["v"].alias(f"top_{value}"))


def mode_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return _mode(counts, by, value)


def cluster_stats(df: DataFrame, keys: Sequence[str], rating: str, score: str, recommended: str) -> DataFrame:
    """Size, mean rating, mean score and percent recommending per cluster, rounded to 3 places."""
    return (
        _known(df, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.bround(F.avg(rating), 3).alias("avg_rating"),
            F.bround(F.avg(score), 3).alias("avg_sentiment"),
            F.bround(F.avg(holds(F.col(recommended) == "Yes")) * 100, 3).alias("pct_recommended"),
        )
    )


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts, percents and ratio of a 0/1 target."""
    yes, n = F.sum(target), F.count(target)
    return df.agg(
        yes.cast("bigint").alias("n_yes"),
        (n - yes).cast("bigint").alias("n_no"),
        (yes / n * 100).alias("yes_pct"),
        ((n - yes) / n * 100).alias("no_pct"),
        safe_ratio(yes, n - yes).alias("ratio"),
    )


def category_table(parts: Mapping[str, DataFrame], name: str = "part") -> DataFrame:
    """Several tables of one layout under each other, labelled."""
    return union_all(*[df.withColumn(name, F.lit(label)) for label, df in parts.items()])
