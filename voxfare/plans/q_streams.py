"""Incremental runs over files, and stores written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.plans.registry import day, query, rounded
from voxfare.plans.views import Tables
from voxfare.session import shared_dir
from voxfare.sources import files, schemas
from voxfare.streaming import incremental


def _event_days(t: Tables) -> DataFrame:
    """The events table as a stream of files, summed per day: the closed days and those still open."""
    spark = t.spark
    source = (
        spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    )
    out, checkpoint = shared_dir(spark, "days"), shared_dir(spark, "days-checkpoint")
    days = incremental.daily_summary(source, "ts", "event_id", "event_type", "value")
    incremental.run_to_table(days, out, checkpoint).awaitTermination()
    return incremental.complete_days(spark, out, checkpoint, "event_type")


@query(
    "stream_daily",
    """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, round(total, 4) AS total, d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) AS closed
      FROM (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)""",
)
def stream_daily(t):
    out = _event_days(t).select(day("day_start").alias("day"), "event_type", "n", "total", "closed")
    return rounded(out, "total", places=4)


@query(
    "stream_months",
    """SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean
      FROM events GROUP BY date_trunc('month', ts), event_type""",
)
def stream_months(t):
    months = incremental.roll_up_months(_event_days(t), "event_type").drop("open_days")
    return rounded(rounded(months.withColumn("month", day("month")), "total", places=4), "mean")


def _reply(batch: DataFrame) -> DataFrame:
    """Replies in the wanted form from the event's own JSON; events of one kind give broken text."""
    body = F.to_json(
        F.struct(
            F.when(F.col("value") >= 50, "positive").otherwise("negative").alias("sentiment_overall"),
            F.get_json_object("props", "$.k").cast("double").alias("sentiment_score"),
        )
    )
    return batch.withColumn("reply", F.when(F.col("event_type") == "error", F.concat(F.lit("sorry: "), body)).otherwise(body))


@query(
    "stream_extract_resume",
    """SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value >= 50 THEN 'positive' ELSE 'negative' END AS outcome, count(*) AS n,
      CASE WHEN event_type <> 'error' THEN round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) END AS k_sum FROM events GROUP BY 1, 2""",
)
def stream_extract_resume(t):
    """Extraction over the files of the events table, started twice: the second run finds nothing new."""
    spark = t.spark
    good, bad, checkpoint = (shared_dir(spark, x) for x in ("good", "bad", "extract-checkpoint"))
    schema = t.events.schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
        incremental.extract_stream(source, _reply, "event_id", good, bad, checkpoint, schemas.EXTRACTION).awaitTermination()
    done = spark.read.parquet(good).select("event_type", F.col("sentiment_overall").alias("outcome"), F.col("sentiment_score").alias("k"))
    kinds = t.events.select("event_id", "event_type")
    failed = spark.read.parquet(bad).join(kinds, "event_id").select("event_type", F.lit("failed").alias("outcome"), F.lit(None).cast("double").alias("k"))
    both = done.unionByName(failed)
    return rounded(both.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum")), "k_sum", places=2)


@query(
    "csv_round_trip",
    """SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
      WHERE text NOT IN ('', '#N/A', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') GROUP BY lang, source""",
)
def csv_round_trip(t):
    """Documents as CSV with a byte-order mark, quotes and line breaks, and read back."""
    path = shared_dir(t.spark, "csv")
    files.write_csv(t.documents.select("lang", "source", "text"), path, bom=True)
    back = files.read_reviews(t.spark, path, schemas.csv_schema(["lang", "source", "text"]))
    kept = back.filter(F.col("text").isNotNull())
    return kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


@query(
    "json_store",
    """SELECT event_type, count(*) * 2 AS n, round(sum(value) * 2, 4) AS total FROM events GROUP BY event_type""",
)
def json_store(t):
    """Two batches appended to a record store, then read with a fixed schema."""
    path = shared_dir(t.spark, "records")
    rows = t.events.select("event_id", "event_type", "value")
    for _ in range(2):
        files.append_records(rows, path)
    back = files.read_records(t.spark, path, rows.schema)
    return rounded(back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", places=4)
