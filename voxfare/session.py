"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "voxfare", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a machine-local folder: on a cluster other executors
    could not read it, so a missing setting is an error there.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_dir() -> str:
    """One folder for a local-mode process whose session names none."""
    return tempfile.mkdtemp(prefix="voxfare-")


def checkpointed(df, purpose: str = "cut"):
    """Cut the lineage of ``df`` by writing it once to the shared folder and reading it back."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], Any]]) -> list[Any]:
    """Results of independent driver steps whose Spark jobs run at the same time, in the order of the steps.

    Fits of many short jobs leave most cores idle when they run one after another.
    """
    with ThreadPool(len(tasks)) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in tasks], chunksize=1)
