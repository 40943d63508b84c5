"""Histograms, five-number summaries, densities, distribution functions, correlation, regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxfare.functions.scores import known_number, tier
from voxfare.operators.ranking import attach, exact_quantiles, hash_order, prefix_sum, value_counts, with_value

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def histogram(df: DataFrame, c: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and densities of equal bins; the last bin is closed, values outside drop out, empty bins stay."""
    x = F.col(c).cast("double")
    place = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    inside = x.between(low, high)
    rows = df.filter(inside).withColumn("__bin", place)
    for b in by:
        rows = rows.filter(F.col(b).isNotNull())
    counts = rows.groupBy(*by).agg(
        F.array(*[F.count_if(F.col("__bin") == i) for i in range(bins)]).alias("__c"),
        F.count(F.lit(1)).alias("__total"),
    )
    width = (high - low) / bins
    return counts.select(*by, "__total", F.posexplode("__c").alias("bin", "n")).select(
        *by,
        (F.col("bin") + 1).alias("bin"),
        (F.lit(low) + F.col("bin") * width).alias("bin_low"),
        "n",
        (F.col("n") / (F.col("__total") * width)).alias("density"),
    )


def five_number(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, extremes and exact quartiles per group."""
    return exact_quantiles(df, c, QUARTILES, by)


def kde(df: DataFrame, c: str, by: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density per group on a grid that overlaps the data by half its range on both sides.

    Bandwidth by Scott's rule. Each task adds up the kernels of its distinct values over the whole grid
    with numpy and emits one partial curve per group; the curves are summed after one small shuffle, so
    the grid never multiplies the rows.
    """
    counts = value_counts(df.withColumn(c, F.col(c).cast("double")), c, [by])
    shape = (
        with_value(df.withColumn(c, F.col(c).cast("double")), c)
        .filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.count(c).cast("double").alias("__n"),
            F.stddev_samp(c).alias("__sd"),
            F.min(c).cast("double").alias("__lo"),
            F.max(c).cast("double").alias("__hi"),
        )
        .filter(F.col("__sd") > 0)
    )
    rows = attach(counts, shape, [by]).select(by, F.col(c).alias("v"), F.col("n"), "__n", "__sd", "__lo", "__hi")
    schema = T.StructType(
        [
            T.StructField(by, counts.schema[by].dataType),
            T.StructField("i", T.IntegerType()),
            T.StructField("x", T.DoubleType()),
            T.StructField("part", T.DoubleType()),
        ]
    )

    def curves(held: dict) -> Iterator[pd.DataFrame]:
        for key, (grid, total) in held.items():
            yield pd.DataFrame({by: key, "i": np.arange(points, dtype="int32"), "x": grid, "part": total})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(by):
                n, sd, low, high = (float(g[k].iloc[0]) for k in ("__n", "__sd", "__lo", "__hi"))
                if key not in held:
                    reach = 0.5 * (high - low)
                    held[key] = (np.linspace(low - reach, high + reach, points), np.zeros(points))
                grid, total = held[key]
                h = sd * n**-0.2
                v, w = g["v"].to_numpy(), g["n"].to_numpy(dtype="float64")
                for at in range(0, len(v), 512):
                    z = (grid[None, :] - v[at : at + 512, None]) / h
                    total += w[at : at + 512] @ np.exp(-0.5 * z * z) / (n * h * np.sqrt(2 * np.pi))
            if len(held) > 2000:
                yield from curves(held)
                held = {}
        yield from curves(held)

    return (
        rows.mapInPandas(partial, schema)
        .groupBy(by, "i")
        .agg(F.max("x").alias("x"), F.sum("part").alias("density"))
    )


def ecdf(df: DataFrame, c: str, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Empirical distribution function: one row per distinct value; ``few`` as in ``prefix_sum``."""
    run = prefix_sum(value_counts(df, c, by), c, ["n"], by, few=few)
    return run.select(*by, c, "n", (F.col("cum_n") / F.col("total_n")).alias("cdf"))


def corr_with(df: DataFrame, cols: Sequence[str], target: str, strong: float = 0.7, fair: float = 0.5) -> DataFrame:
    """Pearson r of each column with the target over the rows where both are known; strongest first."""
    wide = df.agg(*[F.corr(known_number(c), known_number(target)).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "field", "r").filter(F.col("r").isNotNull())
    return long.withColumn("tier", tier("r", strong, fair, ("strong", "moderate", "weak"))).orderBy(F.desc("r"), "field")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle of pairwise-complete correlations, from one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    wide = df.agg(F.array(*[F.corr(known_number(a), known_number(b)) for a, b in pairs]).alias("r"))
    names = F.array(*[F.struct(F.lit(a).alias("row_field"), F.lit(b).alias("col_field")) for a, b in pairs])
    zipped = F.explode(F.arrays_zip(names.alias("p"), F.col("r").alias("r")))
    return wide.select(zipped.alias("z")).select("z.p.row_field", "z.p.col_field", "z.r")


def linreg(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and r over the complete rows, with the range of x."""
    known = with_value(with_value(df.select(x, y), x), y)
    return known.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )


def fitted_line(fit: DataFrame, points: int = 100) -> DataFrame:
    """The fitted line on evenly spaced points."""
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        "i",
        (F.col("x_min") + F.col("i") * step).alias("x"),
        (F.col("intercept") + F.col("slope") * (F.col("x_min") + F.col("i") * step)).alias("y"),
    )


def jittered(
    df: DataFrame, x: str, y: str, key: str, spread_x: float = 0.1, spread_y: float = 0.3, seed: int = 42
) -> DataFrame:
    """Points of the complete rows with uniform noise that is the same in every run, for scatter plots."""

    def noise(salt: int, spread: float):
        unit = F.conv(F.substring(hash_order(key, seed + salt), 1, 8), 16, 10).cast("double") / 2.0**32
        return (unit * 2 - 1) * spread

    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.select(key, (F.col(x) + noise(1, spread_x)).alias("x"), (F.col(y) + noise(2, spread_y)).alias("y"))
