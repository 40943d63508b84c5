"""Incremental runs: extraction with resume and an error table, and a daily summary of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voxfare.operators.voice import merge_fields, parse_reply
from voxfare.session import checkpointed
from voxfare.sources import schemas

DELAY = "2 days"


def extract_stream(
    source: DataFrame,
    reply: Callable[[DataFrame], DataFrame],
    key: str,
    good_path: str,
    error_path: str,
    checkpoint: str,
    schema: StructType = schemas.EXTRACTION,
) -> StreamingQuery:
    """Run the extraction over all files not handled yet, then stop.

    ``reply`` adds a text column ``reply``. Each micro-batch writes its parsed rows and its failures under
    its own batch folder in overwrite mode, so a batch that is repeated after a failure leaves no copies;
    the checkpoint remembers the files already handled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        replied = checkpointed(reply(batch), "replies")  # a second call may answer otherwise
        good, bad = parse_reply(replied, "reply", schema)
        merged = merge_fields(good, [c for c in batch.columns])
        merged.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.select(F.col(key), "error", "raw").write.mode("overwrite").parquet(f"{error_path}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def extract_batch(df: DataFrame, done: DataFrame, key: str, reply: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The batch twin: rows not done yet, split into merged results and failures.

    Replies are stored before the split: each row is asked once, and is in exactly one of the two results.
    """
    todo = df.join(done.select(key), key, "left_anti")
    good, bad = parse_reply(checkpointed(reply(todo), "replies"), "reply")
    return merge_fields(good, df.columns), bad


def daily_summary(
    events: DataFrame, ts: str, key: str, by: str, value: str, delay: str = DELAY
) -> DataFrame:
    """Count and sum per day and kind over a stream with repeats and late rows.

    A repeat of a key within the delay is dropped; state older than the delay leaves memory. Sums are kept
    as counts and totals, so months are a plain roll-up of the days.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.dropDuplicatesWithinWatermark([key])
        .groupBy(F.window(ts, "1 day"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("day_start"), by, "n", "total")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the closed windows to Parquet until the source is read up, then stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_days(spark: SparkSession, checkpoint: str, by: str) -> DataFrame:
    """Days that ``daily_summary`` has not closed yet, as far as its last batch has summed them.

    They are read from the state that the stopped stream left in its checkpoint, so no event is read again, and
    repeats that the stream has dropped stay out.
    """
    operators = spark.read.format("state-metadata").load(checkpoint)
    sums = operators.filter("operatorName = 'stateStoreSave'").select("operatorId").distinct().first()
    state = spark.read.format("statestore").option("operatorId", sums["operatorId"]).load(checkpoint)
    n, total = state.schema["value"].dataType.names
    return state.select(
        F.col("key.window.start").alias("day_start"), F.col("key")[by].alias(by), F.col("value")[n].alias("n"), F.col("value")[total].alias("total")
    )


def complete_days(spark: SparkSession, path: str, checkpoint: str, by: str) -> DataFrame:
    """All days of a ``daily_summary`` that ``run_to_table`` has written, each with ``closed``: whether late rows can still change it."""
    closed = spark.read.parquet(path).withColumn("closed", F.lit(True))
    return closed.unionByName(open_days(spark, checkpoint, by).withColumn("closed", F.lit(False)))


def roll_up_months(days: DataFrame, by: str) -> DataFrame:
    """Monthly figures from days, with the number of days that are still open."""
    month: Column = F.trunc("day_start", "month")
    return days.groupBy(month.alias("month"), by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("total") / F.sum("n")).alias("mean"), F.count_if(~F.col("closed")).alias("open_days")
    )
