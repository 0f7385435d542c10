"""Work segments: runs of intervals of one activity, with their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring
from worklens.functions.apps import neighbour_similarity
from worklens.functions.sequence import day_chunk, islands

KEY = ["user_id", "segment_no"]


def mark_segments(
    intervals: DataFrame, split_gap_minutes: float = 5.0, similarity_threshold: float = 0.7
) -> DataFrame:
    """Number the segments of each user. A segment breaks after a gap longer than
    ``split_gap_minutes`` or when the app changes to an unrelated one. ``earlier_app`` is the last
    app used before in the same segment."""
    gap = lambda: scoring.minutes_between("__end", "timestamp_start") > split_gap_minutes
    switch = lambda: F.coalesce(
        (F.col("__app") != F.col("app"))
        & (neighbour_similarity(F.col("__app"), F.col("app")) < similarity_threshold),
        F.lit(False),
    )
    return islands(
        intervals, ["user_id"], ["timestamp_start", "event_id"], day_chunk("timestamp_start"),
        lambda: F.when(F.col("__end").isNull(), F.lit(True)).otherwise(gap() | switch()),
        out="segment_no", lag={"__app": F.col("app"), "__end": F.col("timestamp_end")},
        uses=["app", "timestamp_start"], within={"earlier_app": F.col("app")},
    )


def _parts(marked: DataFrame) -> DataFrame:
    """One row per (segment, app, title): everything the segment features need, pre-aggregated."""
    minutes = scoring.minutes_between("timestamp_start", "timestamp_end")
    order = F.struct("timestamp_start", "event_id")
    total = lambda c, name: F.sum(c).alias(name)
    return marked.groupBy(*KEY, "app", "window_title").agg(
        F.min(order).alias("first"),
        F.max(F.struct("timestamp_start", "event_id", "timestamp_end")).alias("last"),
        F.min_by(F.struct("session_id", "time_of_day", "is_weekend", "is_work_hours"), order).alias("context"),
        F.count(F.lit(1)).alias("n"),
        total(minutes, "minutes"),
        total("copy_count", "copies"), total("paste_count", "pastes"), total("cut_count", "cuts"),
        total("mouse_clicks", "clicks"), total("mouse_distance", "distance"),
        total("keyboard_intensity", "kb"), total((F.col("keyboard_intensity") * minutes).cast("long"), "keys"),
        total("cpu_usage", "cpu"), F.max("cpu_usage").alias("cpu_max"),
        total("ram_usage", "ram"), F.max("ram_usage").alias("ram_max"),
        total("gpu_usage", "gpu"), F.count("gpu_usage").alias("gpu_n"),
        F.max("audio_volume").alias("volume"),
        total(F.col("mic_active").cast("int"), "mic"), total(F.col("camera_active").cast("int"), "camera"),
        total((F.col("earlier_app") != F.col("app")).cast("int"), "switches"),
    )


def segment_features(marked: DataFrame, min_segment_minutes: float = 10.0) -> DataFrame:
    """One row per segment of at least ``min_segment_minutes``.

    The intervals are aggregated once per (segment, app, title); the primary app, the modal title
    and the distinct counts come from those few rows, so no list of intervals is ever built.
    """
    parts = _parts(marked).repartition(*KEY)  # one shuffle serves the windows and the final groups
    by_app = Window.partitionBy(*KEY, "app")
    by_title = Window.partitionBy(*KEY, "window_title")
    ranked = parts.withColumns({
        "app_minutes": F.sum("minutes").over(by_app), "app_first": F.min("first").over(by_app),
        "title_n": F.sum("n").over(by_title), "title_first": F.min("first").over(by_title),
        "new_app": F.when(F.col("app").isNotNull() & (F.row_number().over(by_app.orderBy("first")) == 1), 1).otherwise(0),
        "new_title": F.when(F.col("window_title").isNotNull() & (F.row_number().over(by_title.orderBy("first")) == 1), 1).otherwise(0),
    })
    # earliest wins on equal weight: smaller (-weight, first seen) is better
    seg = ranked.groupBy(*KEY).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("context", "first").alias("context"),
        F.sum("n").alias("interval_count"),
        F.sum("copies").alias("total_copy_events"), F.sum("pastes").alias("total_paste_events"),
        F.sum("cuts").alias("total_cut_events"), F.sum("keys").alias("total_keyboard_keys"),
        F.sum("clicks").alias("total_mouse_clicks"), F.sum("distance").alias("total_mouse_distance"),
        (F.sum("kb") / F.sum("n")).alias("keyboard_intensity_avg"),
        (F.sum("cpu") / F.sum("n")).alias("mean_cpu_usage"), F.max("cpu_max").alias("max_cpu_usage"),
        (F.sum("ram") / F.sum("n")).alias("mean_ram_usage"), F.max("ram_max").alias("max_ram_usage"),
        F.when(F.sum("gpu_n") > 0, F.sum("gpu") / F.sum("gpu_n")).alias("mean_gpu_usage"),
        F.max("volume").alias("max_audio_volume"),
        (F.sum("mic") / F.sum("n")).alias("mic_active_ratio"), (F.sum("camera") / F.sum("n")).alias("camera_active_ratio"),
        F.min_by("app", F.when(F.col("app").isNotNull(), F.struct(-F.col("app_minutes"), "app_first"))).alias("primary_app"),
        F.min_by("window_title", F.when(F.col("window_title").isNotNull(), F.struct(-F.col("title_n"), "title_first"))).alias("primary_window_title"),
        F.sum("new_app").alias("unique_apps"), F.sum("new_title").alias("unique_titles"),
        F.coalesce(F.sum("switches"), F.lit(0)).alias("app_switches"),
    )
    start, end = F.col("first.timestamp_start"), F.col("last.timestamp_end")
    timed = (
        seg.withColumns({"start_time": start, "end_time": end})
        .withColumn("duration_minutes", scoring.minutes_between("start_time", "end_time"))
        .filter(F.col("duration_minutes") >= min_segment_minutes)
        .withColumns({c: F.col(f"context.{c}") for c in ("session_id", "time_of_day", "is_weekend", "is_work_hours")})
        .withColumn("segment_id", F.concat_ws("_", F.lit("seg"), F.date_format("start_time", "yyyyMMdd_HHmmss"), F.col("segment_no").cast("string")))
        .drop("first", "last", "context")
    )
    return behaviour(timed)


def behaviour(segments: DataFrame) -> DataFrame:
    """D09 multitasking score and flag, D10 activity score and active / passive flags."""
    per_minute = lambda c: F.when(F.col("duration_minutes") > 0, c / F.col("duration_minutes")).otherwise(0.0)
    cap = lambda c: F.least(F.lit(1.0), c)
    return (
        segments.withColumn("mouse_intensity_avg", per_minute(F.col("total_mouse_clicks")))
        .withColumn("multitasking_score", (cap(F.col("unique_apps") / 5.0) + cap(per_minute(F.col("app_switches")))) / 2.0)
        .withColumn("is_multitasking", F.col("multitasking_score") > 0.5)
        .withColumn("activity_score", (cap(F.col("keyboard_intensity_avg") / 60.0) + cap(F.col("mouse_intensity_avg") / 10.0)) / 2.0)
        .withColumn("is_active_work", F.col("activity_score") > 0.3)
        .withColumn("is_passive_work", ~F.col("is_active_work"))
    )


def app_time(marked: DataFrame, min_segment_minutes: float = 10.0) -> DataFrame:
    """Minutes per app of each kept segment, one row per (segment, app)."""
    minutes = scoring.minutes_between("timestamp_start", "timestamp_end")
    last = F.max_by("timestamp_end", F.struct("timestamp_start", "event_id"))
    parts = marked.groupBy(*KEY, "app").agg(
        F.sum(minutes).alias("minutes"), F.min("timestamp_start").alias("s"),
        F.max(F.struct("timestamp_start", "event_id", "timestamp_end")).alias("e"),
    )
    w = Window.partitionBy(*KEY)
    span = scoring.minutes_between(F.min("s").over(w), F.max("e").over(w)["timestamp_end"])
    return (
        parts.withColumn("span", span).filter((F.col("span") >= min_segment_minutes) & F.col("app").isNotNull())
        .select(*KEY, "app", "minutes")
    )


def active_segments(segments: DataFrame, min_activity_score: float = 0.1) -> DataFrame:
    """B06."""
    return segments.filter(F.col("activity_score") >= min_activity_score)


def segment_totals(segments: DataFrame) -> DataFrame:
    """Counts, hours and mean minutes over segments, with active, passive and multitask shares."""
    share = lambda flag: F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))
    return segments.agg(
        F.count(F.lit(1)).alias("segments"), (F.sum("duration_minutes") / 60.0).alias("hours"),
        F.avg("duration_minutes").alias("avg_minutes"), share("is_active_work").alias("active_ratio"),
        share("is_passive_work").alias("passive_ratio"), share("is_multitasking").alias("multitask_ratio"),
        F.avg("mean_cpu_usage").alias("avg_cpu"), F.avg("mean_ram_usage").alias("avg_ram"),
    )


def productivity_ratio(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of segment time that is active work, and the focused / multitasking split."""
    d = F.col("duration_minutes")
    part = lambda cond: F.sum(F.when(cond, d).otherwise(0.0))
    return segments.groupBy(*(keys or [])).agg(
        (part(F.col("is_active_work")) / F.sum(d)).alias("active_ratio"),
        part(F.col("is_multitasking")).alias("multitasking_minutes"),
        part(~F.col("is_multitasking")).alias("focused_minutes"),
    )
