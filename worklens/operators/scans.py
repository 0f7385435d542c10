"""Scans of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring, text
from worklens.functions.ranges import overlap_join
from worklens.functions.sequence import day_chunk, scan_rows
from worklens.session import cut_lineage


def newest(df: DataFrame, ts: str, limit: int | None, *tie: str) -> DataFrame:
    """newest rows first; with a limit Spark keeps only that many rows per task."""
    ordered = df.orderBy(F.desc(ts), *[F.desc(t) for t in tie])
    return ordered if limit is None else ordered.limit(limit)


def events_of_type(events: DataFrame, event_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Events newest first, their JSON payload as a map, the raw text where it is no JSON."""
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    parsed = F.from_json("props", "map<string,string>")
    rows = rows.withColumn("payload", F.coalesce(parsed, F.create_map(F.lit("raw"), F.col("props"))))
    return newest(rows, "ts", limit, "event_id")


def in_period(df: DataFrame, start_col: str, end_col: str, start: str | None, end: str | None, overlap: bool = True, closed: bool = False) -> DataFrame:
    """Rows that overlap a period (half-open, or with both ends), or with
    ``overlap=False`` rows inside it. Plain comparisons, so they reach the Parquet scan."""
    lo, hi = (start_col, end_col) if not overlap else (end_col, start_col)
    if start is not None:
        s = F.lit(start).cast("timestamp")
        df = df.filter(F.col(lo) >= s if closed or not overlap else F.col(lo) > s)
    if end is not None:
        e = F.lit(end).cast("timestamp")
        df = df.filter(F.col(hi) <= e if closed or not overlap else F.col(hi) < e)
    return df


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key as one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows of each key; Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def fill_interval_defaults(df: DataFrame) -> DataFrame:
    """What the interval sink stores for missing values."""
    numbers = ["keyboard_intensity", "mouse_clicks", "mouse_distance", "copy_count", "paste_count", "cut_count", "audio_volume", "cpu_usage", "ram_usage"]
    flags = ["mic_active", "camera_active", "is_weekend", "is_work_hours"]
    return df.na.fill(0, numbers).na.fill(False, flags).na.fill({"time_of_day": "unknown"})


def segment_listing(segments: DataFrame, sessions: DataFrame, min_seconds: float = 0, limit: int | None = None, limit_first: bool = True) -> DataFrame:
    """Segments with their session's times, newest first. The limit is taken before
    the duration filter, as the studied listing does."""
    spans = sessions.select("session_id", F.col("start_time").alias("session_start"), F.col("end_time").alias("session_end"))
    rows = segments
    seconds = F.coalesce(scoring.seconds_between("start_time", "end_time"), F.lit(0.0))
    if limit is not None and limit_first:
        rows = newest(rows, "start_time", limit, "segment_id")
    rows = rows.withColumn("duration_seconds", seconds).filter(F.col("duration_seconds") >= min_seconds)
    if limit is not None and not limit_first:
        rows = newest(rows, "start_time", limit, "segment_id")
    vector = F.from_json("feature_vector", "active_app string, active_window_title string")
    named = rows.withColumn("v", vector).withColumns({
        "app": F.coalesce("v.active_app", F.lit("unknown")), "window_title": F.coalesce("v.active_window_title", F.lit(""))})
    return named.withColumns({
        "normalized_title": text.clean_title(F.col("window_title")), "generic_task": text.generic_task(F.col("reason"), F.col("task_id")),
    }).drop("v", "feature_vector").join(spans, "session_id", "left")


def session_segments_flat(segments: DataFrame, sessions: DataFrame, since: Column) -> DataFrame:
    """Sessions that start after ``since`` with their segments. The nested list of the studied
    reader is given as one row per segment with its position, so a long session is never one row."""
    recent = sessions.filter(F.col("start_time") >= since).select("session_id", F.col("start_time").alias("session_start"))
    placed = scan_rows(segments, ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"), run_sum={"position": F.lit(1)})
    return recent.join(placed, "session_id", "left")


def segment_metrics(segments: DataFrame, intervals: DataFrame, widen_seconds: int = 120) -> DataFrame:
    """Mean cpu, ram, gpu and volume and the input of the session's intervals that overlap a
    segment; where cpu, ram and gpu are all 0 the segment is widened on both sides and tried again."""
    iv = intervals.filter("session_id is not null").select(
        "session_id", "timestamp_start", "timestamp_end", "cpu_usage", "ram_usage", "gpu_usage", "audio_volume", "keyboard_intensity", "mouse_clicks")

    def measured(rows: DataFrame, mark: str) -> DataFrame:
        # spans last hours: narrower buckets would repeat each of them many times
        pairs = overlap_join(rows, iv, ["session_id"], ("s", "e"), ("timestamp_start", "timestamp_end"), bucket_seconds=21600)
        zero = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0))
        return pairs.groupBy("segment_id").agg(
            zero("cpu_usage").alias(f"cpu{mark}"), zero("ram_usage").alias(f"ram{mark}"), F.coalesce(F.avg("gpu_usage"), F.lit(0.0)).alias(f"gpu{mark}"),
            zero("audio_volume").alias(f"audio{mark}"), (F.sum("keyboard_intensity") + F.sum("mouse_clicks")).alias(f"input{mark}"))

    spans = segments.filter("end_time is not null").select("segment_id", "session_id", F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    first = cut_lineage(measured(spans, "1"))  # read twice
    dark = (F.col("cpu1") == 0) & (F.col("ram1") == 0) & (F.col("gpu1") == 0)
    reach = F.expr(f"interval {widen_seconds} seconds")
    again = spans.join(first.filter(dark).select("segment_id"), "segment_id", "left_semi").withColumns({"s": F.col("s") - reach, "e": F.col("e") + reach})
    both = first.join(measured(again, "2"), "segment_id", "left")
    pick = lambda n: F.coalesce(F.col(f"{n}2"), F.col(f"{n}1"))
    return both.select("segment_id", pick("cpu").alias("avg_cpu"), pick("ram").alias("avg_ram"), pick("gpu").alias("avg_gpu"),
                       F.col("audio1").alias("avg_audio"), (pick("input") + 1e-9).cast("long").alias("event_count"))  # whole sums stay whole in any order of adding


def segment_context(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Dominant app and title and the number of inputs among the events of the same session inside
    a segment, both ends included. ``events`` has session_id, ts, event_id, is_window, app, title."""
    point = events.select("session_id", F.col("ts").alias("t0"), F.col("ts").alias("t1"), "event_id", "is_window", "app", "title")
    spans = segments.filter("end_time is not null").select("session_id", "segment_id", F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    pairs = overlap_join(point, spans, ["session_id"], ("t0", "t1"), ("s", "e"), bucket_seconds=3600, closed=True)
    order = F.min(F.struct("t0", "event_id"))
    counts = pairs.groupBy("segment_id", "app", "title").agg(
        F.sum(F.col("is_window").cast("int")).alias("n"), F.sum((~F.col("is_window")).cast("int")).alias("inputs"),
        F.min(F.when(F.col("is_window"), F.struct("t0", "event_id"))).alias("first"))
    by_app = Window.partitionBy("segment_id", "app")
    by_title = Window.partitionBy("segment_id", "title")
    ranked = counts.withColumns({
        "app_n": F.sum("n").over(by_app), "app_first": F.min("first").over(by_app), "title_n": F.sum("n").over(by_title), "title_first": F.min("first").over(by_title)})
    top = lambda v, n, f: F.coalesce(F.min_by(v, F.when(F.col(n) > 0, F.struct(-F.col(n), f))), F.lit("unknown" if v == "app" else ""))
    return ranked.groupBy("segment_id").agg(
        top("app", "app_n", "app_first").alias("app"), top("title", "title_n", "title_first").alias("window_title"), F.sum("inputs").alias("input_count"))


def training_rows(segments: DataFrame, min_seconds: float = 30, confidence: float = 0.5) -> DataFrame:
    """Closed, confident, long enough segments with features out of their JSON."""
    vector = F.from_json("feature_vector", """active_app string, active_window_title string, input_rate_per_minute double, typing_ratio double, mouse_ratio double,
        window_switches_per_minute double, time_in_current_window_seconds double, clipboard_events_per_minute double, has_coding_app boolean, has_browser boolean, has_communication_app boolean""")
    seconds = scoring.seconds_between("start_time", "end_time")
    rows = segments.filter((F.col("confidence") >= confidence) & F.col("end_time").isNotNull()).withColumns({"duration_seconds": seconds, "v": vector})
    parts = F.split("reason", "_", 2)
    category = F.when((F.size(parts) == 2) & parts[0].isin("initial", "continuing", "transition"), parts[1]).otherwise(F.col("task_id"))
    zero = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(0.0))
    no = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(False))
    title = F.coalesce("v.active_window_title", F.lit(""))
    return rows.filter(F.col("duration_seconds") >= min_seconds).select(
        "segment_id", "session_id", "start_time", "end_time", "duration_seconds", F.coalesce("v.active_app", F.lit("")).alias("app"), title.alias("window_title"),
        text.clean_title(title).alias("normalized_title"), category.alias("generic_task"), F.col("task_id").alias("smart_name"), "confidence", "reason",
        zero("input_rate_per_minute").alias("input_rate"), zero("typing_ratio").alias("typing_ratio"), zero("mouse_ratio").alias("mouse_ratio"),
        zero("window_switches_per_minute").alias("window_switches"), zero("time_in_current_window_seconds").alias("time_in_window"),
        zero("clipboard_events_per_minute").alias("clipboard_events"), no("has_coding_app").alias("has_coding_app"), no("has_browser").alias("has_browser"),
        no("has_communication_app").alias("has_communication_app"))


def training_stats(rows: DataFrame) -> DataFrame:
    """Counts per category beside the totals of the set."""
    return rows.groupBy("generic_task").agg(
        F.count(F.lit(1)).alias("segments"), F.avg("duration_seconds").alias("avg_duration_seconds"), F.avg("confidence").alias("avg_confidence"),
        F.countDistinct(F.when(F.col("app") != "", F.col("app"))).alias("unique_apps"))


def closed_segments(segments: DataFrame) -> DataFrame:
    """Closed segments with app, cleaned title and the category of an initial or continuing reason."""
    vector = F.from_json("feature_vector", "active_app string, active_window_title string")
    parts = F.split(F.coalesce("reason", F.lit("")), "_")
    task = F.when((F.size(parts) > 1) & parts[0].isin("initial", "continuing"), F.array_join(F.slice(parts, 2, F.size(parts)), "_")).otherwise("unknown")
    return segments.filter("end_time is not null").withColumn("v", vector).select(
        "segment_id", "user_id", "session_id", "task_id", "start_time", "end_time", scoring.seconds_between("start_time", "end_time").alias("duration_seconds"),
        F.coalesce("v.active_app", F.lit("unknown")).alias("app"), F.coalesce("v.active_window_title", F.lit("")).alias("window_title"),
        text.clean_title(F.coalesce("v.active_window_title", F.lit(""))).alias("normalized_title"), task.alias("generic_task"), "confidence")


def fragmentation(segments: DataFrame) -> DataFrame:
    """Switches and short segments of a session (the first segment is not counted as short but is
    in the ratio), with distinct apps and tasks. A session's segments follow one another in time."""
    seen = scan_rows(segments, ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"),
                     lag={"p": F.struct(F.col("app").alias("a"), F.col("normalized_title").alias("t"), F.col("generic_task").alias("g"))})
    diff = lambda f, c: F.sum(F.when(F.col(f"p.{f}") != F.col(c), 1).otherwise(0))
    n, minutes = F.count(F.lit(1)), F.sum("duration_seconds") / 60.0
    short = F.sum(F.when(F.col("p").isNotNull() & (F.col("duration_seconds") < F.lit(120)), 1).otherwise(0))
    return seen.groupBy("session_id").agg(
        n.alias("total_segments"), minutes.alias("total_minutes"), (minutes / n).alias("avg_minutes"), diff("a", "app").alias("app_switches"),
        diff("t", "normalized_title").alias("window_switches"), diff("g", "generic_task").alias("task_switches"), short.alias("short_segments"),
        (short / n).alias("short_segment_ratio"), F.countDistinct("app").alias("apps_used"), F.countDistinct("generic_task").alias("tasks_detected"))


def export_rows(sessions: DataFrame, minutes: DataFrame, now: Column) -> DataFrame:
    """Session end is its latest minute bucket, else now while it is in progress."""
    last = minutes.groupBy("session_id").agg(F.max("minute").alias("m"))
    end = F.coalesce("m", F.when(F.col("in_progress"), now).otherwise(F.col("end_time")))
    rows = sessions.join(last, "session_id", "left").withColumn("end", end)
    seconds = scoring.seconds_between("start_time", "end")
    return rows.select("session_id", F.col("start_time").alias("start"), "end", seconds.alias("duration_seconds"), (seconds / 60.0).alias("duration_minutes"), "device_id", "in_progress")
