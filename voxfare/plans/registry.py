"""Registered queries: a Spark plan and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfare.plans import views

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a plan over ``Tables``; ``uses`` names the shared SQL views of its oracle."""

    def add(fn: Callable[[views.Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(views.Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.with_views(uses, sql)
        return fn

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round result columns, so that the order of floating-point sums does not show."""
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


def bigint(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
