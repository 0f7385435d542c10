"""Structured Streaming jobs: sources, windows with watermarks, sinks."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.operators import insights, signals
from worklens.session import shared_folder
from worklens.sources import tables as src

WATERMARK = "10 minutes"
#: Files of a micro-batch where their order does not matter, so that the first one is not the whole history.
FILES_PER_TRIGGER = 64


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a file stream; a checkpoint remembers which files were read. All files that are there make one
    micro-batch. ``files_per_trigger`` limits it, for files that come in time order or sinks that need none: under a watermark,
    rows that come after much newer ones are dropped."""
    reader = spark.readStream.schema(src.EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process everything that is there and stop. Appended rows go to a Parquet table in the shared
    folder, which is returned; with ``each`` the micro-batches go to that function instead."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/worklens-stream-{uuid.uuid4().hex[:8]}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_complete(stream: DataFrame) -> DataFrame:
    """The result table of a complete-mode aggregate after everything that is there: each micro-batch replaces it."""
    spark = stream.sparkSession
    base, last = f"{shared_folder(spark)}/worklens-result-{uuid.uuid4().hex[:8]}", {}

    def keep(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch, base, batch_id)
        last["batch"] = batch_id

    run_available(stream, mode="complete", each=keep)
    return spark.read.parquet(f"{base}/batch_id={last['batch']}")


def raw_inputs(events: DataFrame) -> DataFrame:
    return src.raw_input_columns(events).withWatermark("ts", WATERMARK)


def tumbling_inputs(events: DataFrame, seconds: int = 60) -> DataFrame:
    """I01."""
    return signals.tumbling_inputs(raw_inputs(events), seconds)


def sliding_metrics(events: DataFrame, seconds: int = 300, slide: int = 10) -> DataFrame:
    """The collector marks the rows that open another window, so no look-back is needed."""
    rows = raw_inputs(events).withColumn("app_change", (F.col("k") % 3 == 0).cast("int"))
    return signals.sliding_metrics(rows, seconds, slide)


def minute_timeline(events: DataFrame) -> DataFrame:
    """Keys, clicks and mouse distance per user and minute window."""
    kind = lambda k, v=None: F.sum(F.when(F.col("kind") == k, v if v is not None else F.lit(1)).otherwise(0))
    return raw_inputs(events).groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(
        kind("key").alias("keys"), kind("click").alias("clicks"), kind("move", F.col("amount")).cast("double").alias("mouse_distance")
    ).select("user_id", F.col("w.start").alias("minute"), "keys", "clicks", "mouse_distance")


def input_summaries(events: DataFrame, seconds: int = 5, at_least: int = 2) -> DataFrame:
    """I04."""
    return signals.input_summaries(raw_inputs(events), seconds, at_least)


def gap_sessions(events: DataFrame, idle_seconds: int = 300) -> DataFrame:
    """G02 on a stream: session windows that close after ``idle_seconds`` without an input."""
    return raw_inputs(events).groupBy("user_id", F.session_window("ts", f"{idle_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("inputs"), F.max(F.col("ts")).alias("last_input")).select(
        "user_id", F.col("w.start").alias("start_time"), "last_input", "inputs")


def task_moments(events: DataFrame) -> DataFrame:
    """I16: count, mean and sum of squared deviations of the input amount per task, kept up by the
    stream (update or complete mode)."""
    return src.raw_input_columns(events).groupBy(F.concat(F.lit("T"), (F.col("k") % 5).cast("string")).alias("task_id")).agg(
        F.count("amount").alias("n"), F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count("amount")).alias("m2"))


def _replace_batch(rows: DataFrame, base: str, batch_id: int) -> None:
    """Write a micro-batch under its own id: after a restart the same batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")


def periodic_report(spark: SparkSession, sf_dir: str, lookback_minutes: int = 120, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """With every micro-batch the hourly heat-map of the last ``lookback_minutes`` of the log so far is
    written; on a running stream the trigger is 60 seconds of processing time. Returns the newest report.

    A batch leaves two tables, by date: its intervals, and their sums by minute. The report adds up the sums of the minutes in the lookback, whatever batch they
    came in, and reads single intervals of its first minute only; dates before it are not listed. So it does not matter how the log is cut into
    batches or in which order the files come, and a report's work follows its lookback, not the log."""
    base = f"{shared_folder(spark)}/worklens-report-{uuid.uuid4().hex[:8]}"
    newest = {}

    def by_date(rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").partitionBy("date").parquet(f"{base}/{name}/batch_id={batch_id}")
        return spark.read.schema(rows.schema).parquet(f"{base}/{name}")

    def report(batch: DataFrame, batch_id: int) -> None:
        rows = src.interval_columns(batch).withColumns({"date": F.to_date("timestamp_start"), "minute": F.date_trunc("minute", "timestamp_start")})
        log = by_date(rows, "log", batch_id)
        sums = by_date(insights.heatmap_sums(rows, ["date", "minute"]), "sums", batch_id)
        top = log.agg(F.max("date").alias("date"))  # of folder names
        last = sums.where(F.col("date") == top.first()["date"]).agg(F.max("newest").alias("n"))
        first = last.select((F.unix_micros("n") - lookback_minutes * 60_000_000).alias("m")).first()["m"]
        if first is None:
            return
        at = F.timestamp_micros(F.lit(first))
        start = F.date_trunc("minute", at)
        day = F.lit(datetime.datetime.fromtimestamp(first / 1e6, datetime.timezone.utc).date())
        whole = sums.where((F.col("date") >= day) & (F.col("minute") > start))
        edge = log.where((F.col("date") == day) & (F.col("minute") == start) & (F.col("timestamp_start") >= at))
        both = whole.withColumn("hour", F.hour("minute")).drop("date", "minute", "batch_id").unionByName(insights.heatmap_sums(edge.withColumn("hour", F.hour("minute")), ["hour"]))
        _replace_batch(insights.heatmap_of(both), f"{base}/report", batch_id)
        newest["batch"] = batch_id

    run_available(event_stream(spark, sf_dir, files_per_trigger), each=report)
    return spark.read.parquet(f"{base}/report/batch_id={newest['batch']}")


def live_scores(spark: SparkSession, sf_dir: str, predict: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Every micro-batch is scored by ``predict`` and written under its id."""
    base = f"{shared_folder(spark)}/worklens-live-{uuid.uuid4().hex[:8]}"

    def score(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(predict(batch), base, batch_id)

    run_available(event_stream(spark, sf_dir, files_per_trigger), each=score)
    return spark.read.parquet(base).drop("batch_id")
