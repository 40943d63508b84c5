"""Headline indices: sentiment index, advocacy gap, change over the year before, captive advocates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.functions.scores import holds, safe_ratio


def minmax_index(df: DataFrame, score: str, name: str = "sentiment_index") -> DataFrame:
    """Score on a 0-100 scale between the least and greatest score of the whole table.

    The limits are a one-row scalar subquery, so the rows are neither joined nor shuffled. NULL where
    all scores are equal.
    """
    limits = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    out = df.withColumn("__l", limits)
    low, high = F.col("__l")["lo"], F.col("__l")["hi"]
    return out.withColumn(name, safe_ratio(F.col(score) - low, high - low) * 100).drop("__l")


def advocacy_gap(df: DataFrame, by: Sequence[str], score: str, recommended: str) -> DataFrame:
    """Recommend rate minus mean index per slice; the index limits stay those of the whole table."""
    indexed = minmax_index(df, score)
    out = indexed.groupBy(*by).agg(
        (F.avg(holds(F.col(recommended) == "Yes")) * 100).alias("recommend_pct"),
        F.avg("sentiment_index").alias("index_avg"),
    )
    return out.withColumn("advocacy_gap", F.col("recommend_pct") - F.col("index_avg"))


def yoy(df: DataFrame, year: str, metric: str) -> DataFrame:
    """Mean per year and change from the calendar year before; a gap year gives NULL."""
    by_year = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.avg(metric).alias("mean"))
    prior = by_year.select((F.col(year) + 1).alias(year), F.col("mean").alias("prior_mean"))
    return by_year.join(prior, year, "left").withColumn("yoy_change", F.col("mean") - F.col("prior_mean"))


def captive(df: DataFrame, by: Sequence[str], score: str, recommended: str) -> DataFrame:
    """Those who recommend in spite of a negative score: count, and percent of those who recommend."""
    yes = F.col(recommended) == "Yes"
    return df.groupBy(*by).agg(
        F.count_if(yes & (F.col(score) < 0)).alias("captive"),
        F.count_if(yes).alias("advocates"),
        (safe_ratio(F.count_if(yes & (F.col(score) < 0)), F.count_if(yes)) * 100).alias("captive_pct"),
    )


def dissatisfied_markets(df: DataFrame, key: str, metric: str, min_n: int, max_mean: float) -> DataFrame:
    """Markets with many reviews and a low mean: a commercial risk list."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
        .filter((F.col("n") >= min_n) & (F.col("mean") < max_mean))
    )
