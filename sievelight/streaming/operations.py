"""Operational views: rate limits, feedback, telemetry, caches. Each is a batch plan; those over event time also run as
Structured Streaming, where a watermark (an extension: it bounds the state) is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the duration histogram, in seconds.
BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]


def rate_limit(events: DataFrame, key: Column, ts: Column, limit: int = 60, order: str = "event_id") -> DataFrame:
    """Adds allowed: the first ``limit`` events of a key in each minute."""
    minute = F.date_trunc("minute", ts)
    return events.withColumn("allowed", F.row_number().over(Window.partitionBy(key, minute).orderBy(ts, order)) <= limit)


def demo_limit(events: DataFrame, key: Column, ts: Column, visitor: int = 10, everyone: int = 60, order: str = "event_id") -> DataFrame:
    """Adds allowed: within the visitor's limit and, of all such, within the minute's global budget.

    Of each key ``visitor`` events a minute compete for the budget; the others are refused before that and take no part in the
    minute's ranking. ``order`` is unique.
    """
    minute = F.date_trunc("minute", ts)
    own = events.withColumn("_own", F.row_number().over(Window.partitionBy(key, minute).orderBy(ts, order)) <= visitor)
    turn = F.row_number().over(Window.partitionBy(minute).orderBy(ts, order))
    within = own.where("_own").select(F.col(order).alias("_id"), turn.alias("_turn")).where(F.col("_turn") <= everyone)
    return own.join(within, F.col(order) == F.col("_id"), "left").withColumn("allowed", F.col("_turn").isNotNull()).drop("_own", "_turn", "_id")


def feedback_summary(votes: DataFrame) -> DataFrame:
    """Per verdict: votes, agreed, disagreed, and how many came with the mail."""
    return votes.groupBy("verdict").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.count_if(~F.col("correct")).alias("wrong"), F.count_if("has_email").alias("with_email"))


def accept_feedback(votes: DataFrame, stored_bytes: int, most_bytes: int) -> DataFrame:
    """What may still be appended: nothing once the store is full."""
    return votes.where(F.lit(stored_bytes < most_bytes))


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, seconds: Column, by: list[str] | None = None) -> DataFrame:
    """Counts per upper bound; what is above all bounds is counted at infinity."""
    bucket = F.coalesce(*[F.when(seconds <= b, F.lit(b)) for b in BOUNDS], F.lit(float("inf")))
    return events.groupBy(*(by or []), bucket.alias("le")).agg(F.count("*").alias("n"))


def fresh(cache: DataFrame, now: Column, success_hours: int = 24, failure_minutes: int = 10) -> DataFrame:
    """Cache rows (checked, checked_at) that need no new lookup; fractions of a second count."""
    ttl = F.when(F.col("checked"), F.lit(success_hours * 3_600_000_000)).otherwise(F.lit(failure_minutes * 60_000_000))
    return cache.where(F.unix_micros(now) < F.unix_micros("checked_at") + ttl)


def first_of_message(events: DataFrame, key: str) -> DataFrame:
    return events.dropDuplicates([key])


def stream_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of a stream; ``ts`` may be a timestamp without zone (read as UTC)."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def stream_feedback(votes: DataFrame) -> DataFrame:
    """The running summary of a stream of votes; write it in ``complete`` mode."""
    return feedback_summary(votes)


def append_feedback(batch: DataFrame, path: str, most_rows: int) -> bool:
    """For ``foreachBatch``: appends a batch unless the store would outgrow its cap; False means rejected."""
    spark = batch.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    stored = spark.read.schema(batch.schema).parquet(path).count() if exists else 0
    if stored + batch.count() > most_rows:
        return False
    batch.write.mode("append").parquet(path)
    return True


def publish_feed(batch: DataFrame, root: str, version: int) -> str:
    """A feed snapshot in a directory of its own; readers are given the new path only once it is complete."""
    path = f"{root}/version={version}"
    batch.write.mode("overwrite").parquet(path)
    return path
