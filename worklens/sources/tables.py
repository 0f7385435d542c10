"""Views of the given tables in the engine's own data model (schemas in FIXTURES.md).

The log of the test data is sparse (hours between rows of a user), so the views use scaled
parameters: one hour stands for one minute. The operators' defaults stay in minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.functions.sequence import day_chunk, span_islands
from worklens.session import stored

IDLE_GAP_SECONDS = 5 * 3600
MIN_SEGMENT_MINUTES = 600.0
SPLIT_GAP_MINUTES = 300.0
FOCUS_GAP_MINUTES = 300.0
AS_OF = "2024-01-31 00:00:00"

# fixed values: event type -> app, and the ten window titles
APP_OF_EVENT = {
    "click": "chrome.exe",
    "view": "firefox.exe",
    "purchase": "excel.exe",
    "signup": "slack.exe",
    "error": "code.exe",
}
TITLES = [
    "main.py - Visual Studio Code",
    "GitHub - Pull Request #123 – Mozilla Firefox",
    "YouTube - How to Python",
    "Stack Overflow - Python question",
    "Inbox - Microsoft Outlook",
    "Chat - John Doe",
    "Call - Team Meeting",
    "Documents - File Explorer",
    "Windows PowerShell",
    "Some random window",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.read.schema(EVENT_SCHEMA).parquet(path).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def lookup(key: Column, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def interval_columns(ev: DataFrame) -> DataFrame:
    """events -> interval signals without session (works on a stream too)."""
    k = F.col("k")
    titles = F.array(*[F.lit(t) for t in TITLES])
    return ev.select(
        "event_id",
        "user_id",
        F.col("ts").alias("timestamp_start"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10) + k * 6)).alias("timestamp_end"),
        lookup(F.col("event_type"), APP_OF_EVENT).alias("app"),
        F.element_at(titles, (k % 10) + 1).alias("window_title"),
        F.col("value").alias("keyboard_intensity"),
        ((k % 25) * 60).alias("mouse_clicks"),
        (F.col("value") * 10).alias("mouse_distance"),
        (k % 4).alias("copy_count"),
        (k % 3).alias("paste_count"),
        (k % 2).alias("cut_count"),
        (k % 5 == 0).alias("mic_active"),
        (k % 7 == 0).alias("camera_active"),
        ((k % 10) / 10.0).alias("audio_volume"),
        (k / 100.0).alias("cpu_usage"),
        (((k * 7) % 100) / 100.0).alias("ram_usage"),
        F.when(k % 3 != 0, ((k * 13) % 100) / 100.0).alias("gpu_usage"),
        *scoring.time_context(F.col("ts")),
        (F.col("event_type") == "view").alias("is_background"),
        F.concat(F.lit("T"), (k % 5).cast("string")).alias("task_id"),
        "k",
    )


def intervals_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core fact table without the session column: one scan, no shuffle."""
    return interval_columns(events(spark, sf_dir))


def sessionize(rows: DataFrame, idle_seconds: float = 300, chunk: Column | None = None) -> DataFrame:
    """A row that starts ``idle_seconds`` or more after all earlier activity of the user opens a
    new session. Adds ``session_id``."""
    idle = int(idle_seconds * 1_000_000)
    marked = span_islands(
        rows, ["user_id"], "timestamp_start", "timestamp_end", ["event_id"],
        chunk if chunk is not None else day_chunk("timestamp_start"),
        lambda start, seen: F.unix_micros(start) - F.unix_micros(seen) >= idle, out="__at",
    )
    sid = F.concat_ws("-", F.col("user_id").cast("string"), F.unix_seconds("__at").cast("string"))
    return marked.withColumn("session_id", sid).drop("__at")


def interval_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground intervals with their session, and background intervals with session NULL."""
    return stored(spark, sf_dir, "interval_signals", lambda: _interval_signals(spark, sf_dir))


def _interval_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = intervals_flat(spark, sf_dir)
    front = sessionize(flat.filter(~F.col("is_background")), IDLE_GAP_SECONDS)
    back = flat.filter("is_background").withColumn("session_id", F.lit(None).cast("string"))
    return front.unionByName(back)


def session_rows(intervals: DataFrame) -> DataFrame:
    """Foreground intervals (with session_id) -> one row per session."""
    minutes = scoring.minutes_between("timestamp_start", "timestamp_end")
    first = F.struct("timestamp_start", "event_id")
    return (
        intervals.groupBy("user_id", "session_id")
        .agg(
            F.min("timestamp_start").alias("start_time"),
            F.max("timestamp_end").alias("end_time"),
            F.sum((F.col("keyboard_intensity") * minutes).cast("long")).alias("keys"),
            F.sum("mouse_clicks").alias("clicks"),
            F.sum(F.col("mouse_distance").cast("long")).alias("mouse_distance"),
            F.count(F.lit(1)).alias("total_events"),
            F.countDistinct("app").alias("n_apps"),
            F.array_sort(F.collect_set("app")).alias("apps"),
            F.min_by("task_id", first).alias("task_id"),
            F.avg(scoring.focus_score()).alias("focus_continuity"),
        )
        .withColumn("entropy", (F.col("n_apps") - 1) / 4.0)
        .withColumn("device_id", F.concat(F.lit("dev"), (F.col("user_id") % 3).cast("string")))
        .withColumn("duration_seconds", scoring.seconds_between("start_time", "end_time"))
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "sessions",
        lambda: session_rows(interval_signals(spark, sf_dir).filter("session_id is not null")),
    )


def interval_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval signals with the number of their work segment."""
    from worklens.operators.segments import mark_segments

    return stored(
        spark, sf_dir, "interval_segments",
        lambda: mark_segments(interval_signals(spark, sf_dir), SPLIT_GAP_MINUTES),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worklens.operators.segments import segment_features

    return stored(
        spark, sf_dir, "segments",
        lambda: segment_features(interval_segments(spark, sf_dir), MIN_SEGMENT_MINUTES),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lookup(F.col("event_type"), {
        "click": "ACTIVE", "view": "ACTIVE", "purchase": "PAUSED", "signup": "COMPLETED", "error": "ABANDONED",
    })
    return events(spark, sf_dir).select(
        "user_id", "ts", "event_id", F.concat(F.lit("T"), (F.col("k") % 5).cast("string")).alias("task_id"), state.alias("state"),
    )


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir).filter(F.col("event_type").isin("error", "signup"))
        .select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "IDLE").otherwise("ACTIVE_ALIGNED").alias("state"))
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select(
        "user_id", "ts", "event_id",
        F.when(k < 30, "IDLE").when(k < 60, "ACTIVE_UNALIGNED").otherwise("ACTIVE_ALIGNED").alias("candidate"),
    )


def raw_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_input_columns(events(spark, sf_dir))


def raw_input_columns(ev: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "key").otherwise("move")
    return ev.select(
        "user_id", "ts", "event_id", kind.alias("kind"), F.col("value").alias("amount"),
        lookup(F.col("event_type"), APP_OF_EVENT).alias("app"),
        F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("k") % 10) + 1).alias("window_title"), "k",
    )


# fixed values: task ids and reasons of the stored task segments
SEGMENT_TASKS = ["Administrative Work - ChatGPT", "deep_development", "Technical Research: docs", "T3", "team_meeting | zoom.exe", "Strategic Planning"]
SEGMENT_REASONS = [
    "initial_administrative_work", "continuing_deep_development", "window_change", "behavioral_transition_admin_to_coding",
    "app_change_a_to_b", "transition", "behavioral_team_meeting",
]


def task_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored output of the online classifier: one row per foreground interval. Some are still open,
    some carry a feature text that is not JSON."""
    k = F.col("k")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    vector = F.to_json(F.struct(F.col("app").alias("active_app"), F.col("window_title").alias("active_window_title"), (k / 10.0).alias("input_rate_per_minute"), (k % 2 == 0).alias("has_browser")))
    return interval_signals(spark, sf_dir).filter("session_id is not null").select(
        F.col("event_id").alias("segment_id"), "user_id", "session_id", pick(SEGMENT_TASKS, k % 6).alias("task_id"),
        F.col("timestamp_start").alias("start_time"), F.when(k % 17 != 0, F.col("timestamp_end")).alias("end_time"),
        (((k * 37) % 100) / 100.0).alias("confidence"), pick(SEGMENT_REASONS, k % 7).alias("reason"), ((k % 50) / 100.0).alias("distance"),
        F.when(k % 29 == 0, F.lit("not json")).otherwise(vector).alias("feature_vector"),
    )


def session_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute buckets of each session: keys, clicks, mouse distance."""
    return interval_signals(spark, sf_dir).filter("session_id is not null").groupBy(
        "user_id", "session_id", F.date_trunc("minute", "timestamp_start").alias("minute")).agg(
        F.sum(F.col("keyboard_intensity").cast("long")).alias("keys"), F.sum("mouse_clicks").alias("clicks"),
        F.sum(F.col("mouse_distance").cast("long")).alias("mouse_distance"))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State-change events with their payload columns."""
    k = F.col("k")
    return (
        events(spark, sf_dir).filter(F.col("event_type").isin("error", "signup"))
        .select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "IDLE").when(k < 50, "ACTIVE_UNALIGNED").otherwise("ACTIVE_ALIGNED").alias("state"),
                F.concat(F.lit("T"), (k % 5).cast("string")).alias("active_task"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("reason"),
                (k / 100.0).alias("confidence"))
        .withColumn("payload", F.struct("state", "active_task", "reason", "confidence"))
    )


def intervals_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long overlapping spans: line items of a supplier from ship date, quantity days long."""
    schema = "l_suppkey bigint, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string"
    rows = spark.read.schema(schema).parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("start_time"),
        F.timestamp_micros(F.unix_micros("l_shipdate") + F.col("l_quantity").cast("long") * 86_400_000_000).alias("end_time"),
        F.col("l_returnflag").alias("app"), F.col("l_quantity").cast("long").alias("keys"), F.col("l_linenumber").cast("long").alias("clicks"),
        F.col("l_extendedprice").cast("long").alias("mouse_distance"), F.col("l_linestatus").alias("intent"), F.col("l_orderkey"), F.col("l_linenumber"),
    )


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted session commands: three sessions per user."""
    command = lookup(F.col("event_type"), {"click": "START", "view": "PAUSE", "purchase": "RESUME", "signup": "END", "error": "REOPEN"})
    return events(spark, sf_dir).select(
        "user_id", F.concat(F.lit("S"), (F.col("k") % 3).cast("string")).alias("session_id"), "ts", "event_id", command.alias("command"))
