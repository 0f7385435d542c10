"""Reports over interval signals: hourly series, switches, focus periods, resource use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.functions.sequence import day_chunk, islands, scan_rows

ORDER = ["timestamp_start", "event_id"]


def _hour() -> Column:
    return F.hour("timestamp_start").alias("hour")


def _flag(name: str) -> Column:
    return F.when(F.col(name), 1.0).otherwise(0.0)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def peak_hours(intervals: DataFrame) -> DataFrame:
    """Mean focus score per hour of day, best first."""
    return (
        intervals.groupBy(_hour())
        .agg(F.avg(scoring.focus_score()).alias("avg_focus_score"), F.count(F.lit(1)).alias("interval_count"))
        .orderBy(F.desc("avg_focus_score"), "hour")
    )


def fill_hours(hourly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """24 rows per key; hours without rows get 0.0. The 24-row side is fixed, so it is broadcast."""
    spark = hourly.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    if keys:
        frame = hourly.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        filled = frame.join(hourly, [*keys, "hour"], "left")
    else:
        filled = hours.join(hourly, "hour", "left")
    values = [c for c in hourly.columns if c not in ("hour", *(keys or []))]
    return filled.select(*(keys or []), "hour", *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])


def interaction_trends(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys, clicks and copy-paste events per minute for every hour of day."""
    minutes = scoring.interval_minutes()
    sums = intervals.groupBy(*(keys or []), _hour()).agg(
        F.sum(minutes).alias("m"),
        F.sum((F.col("keyboard_intensity") * minutes).cast("long")).alias("k"),
        F.sum("mouse_clicks").alias("c"),
        F.sum(F.col("copy_count") + F.col("paste_count")).alias("cp"),
    )
    return fill_hours(
        sums.select(
            *(keys or []), "hour", (F.col("k") / F.col("m")).alias("keys_per_min"),
            (F.col("c") / F.col("m")).alias("clicks_per_min"), (F.col("cp") / F.col("m")).alias("copy_paste_density"),
        ), keys,
    )


def audio_video_series(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of intervals with microphone and camera on, mean volume, per hour of day."""
    return fill_hours(
        intervals.groupBy(*(keys or []), _hour()).agg(
            F.avg(_flag("mic_active")).alias("mic_ratio"),
            F.avg(_flag("camera_active")).alias("camera_ratio"),
            F.avg(_zero("audio_volume")).alias("audio_avg"),
        ), keys,
    )


def system_series(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean cpu, ram and (measured) gpu per hour of day."""
    return fill_hours(
        intervals.groupBy(*(keys or []), _hour()).agg(
            F.avg(_zero("cpu_usage")).alias("cpu_avg"),
            F.avg(_zero("ram_usage")).alias("ram_avg"),
            F.avg("gpu_usage").alias("gpu_avg"),
        ), keys,
    )


def heatmap(intervals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean focus, input, system and volume per hour of day."""
    return fill_hours(
        intervals.groupBy(*(keys or []), _hour()).agg(
            F.avg(scoring.focus_score()).alias("focus_avg"),
            F.avg(scoring.input_score()).alias("input_avg"),
            F.avg(scoring.system_score()).alias("system_avg"),
            F.avg(_zero("audio_volume")).alias("audio_avg"),
        ), keys,
    )


def heatmap_sums(intervals: DataFrame, by: list[str]) -> DataFrame:
    """What ``heatmap`` needs of its intervals, as sums by ``by`` that can be added up: rows, and sum and count of each mean."""
    of = {"focus": scoring.focus_score(), "input": scoring.input_score(), "system": scoring.system_score(), "audio": _zero("audio_volume")}
    return intervals.groupBy(*by).agg(F.max("timestamp_start").alias("newest"), *[f(c).alias(f"{n}_{m}") for n, c in of.items() for m, f in (("sum", F.sum), ("count", F.count))])


def heatmap_of(sums: DataFrame) -> DataFrame:
    """``heatmap`` out of sums that have an hour."""
    mean = lambda n: (F.sum(f"{n}_sum") / F.sum(f"{n}_count")).alias(f"{n}_avg")
    return fill_hours(sums.groupBy("hour").agg(*[mean(n) for n in ("focus", "input", "system", "audio")]), None)


def system_by_session(intervals: DataFrame) -> DataFrame:
    """Resource use per session; intervals without a session fall under 'unassigned'."""
    return intervals.groupBy(F.coalesce("session_id", F.lit("unassigned")).alias("session_id")).agg(
        F.avg(_zero("cpu_usage")).alias("cpu_avg"),
        F.avg(_zero("ram_usage")).alias("ram_avg"),
        F.avg("gpu_usage").alias("gpu_avg"),
        F.count(F.lit(1)).alias("interval_count"),
    )


def task_resource_usage(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the segment means per task; gpu over segments that measured it."""
    return segments.groupBy(*keys).agg(
        F.avg("mean_cpu_usage").alias("cpu_avg"),
        F.avg("mean_ram_usage").alias("ram_avg"),
        F.avg("mean_gpu_usage").alias("gpu_avg"),
        F.sum("duration_minutes").alias("duration_minutes"),
    )


def audio_engagement(intervals: DataFrame, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Minutes and share of time with volume at or above ``threshold``."""
    minutes = scoring.interval_minutes()
    engaged = F.sum(F.when(_zero("audio_volume") >= threshold, minutes).otherwise(0.0))
    return intervals.groupBy(*(keys or [])).agg(
        F.lit(threshold).alias("threshold"), engaged.alias("engaged_minutes"),
        F.coalesce(engaged / F.sum(minutes), F.lit(0.0)).alias("engaged_ratio"),
    )


def meeting_periods(segments: DataFrame) -> DataFrame:
    """Segments with the microphone on for 60 % or the camera for 40 % of their intervals."""
    return segments.filter((F.col("mic_active_ratio") >= 0.6) | (F.col("camera_active_ratio") >= 0.4)).select(
        "user_id", "segment_id", "start_time", "end_time", "duration_minutes", "primary_app",
        F.col("mic_active_ratio").alias("mic_ratio"), F.col("camera_active_ratio").alias("camera_ratio"),
    )


def heavy_segments(segments: DataFrame) -> DataFrame:
    """Segments with cpu >= .7, ram >= .8 or gpu >= .6 (unmeasured gpu counts as 0)."""
    heavy = scoring.at_least(F.col("mean_cpu_usage"), 0.7) | scoring.at_least(F.col("mean_ram_usage"), 0.8) | scoring.at_least(_zero("mean_gpu_usage"), 0.6)
    return segments.filter(heavy).select(
        "segment_id", "primary_app", F.col("mean_cpu_usage").alias("cpu_avg"),
        F.col("mean_ram_usage").alias("ram_avg"), F.col("mean_gpu_usage").alias("gpu_avg"),
    )


def heavy_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with cpu >= .7 or ram >= .8."""
    return tasks.filter(scoring.at_least(F.col("cpu_avg"), 0.7) | scoring.at_least(F.col("ram_avg"), 0.8))


def context_switches(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """App changes per key and hour of day. Rows without an app are looked through."""
    seen = scan_rows(intervals, keys, ORDER, day_chunk("timestamp_start"), known_before={"last_app": F.col("app")})
    changed = seen.filter(F.col("app").isNotNull() & (F.col("last_app") != F.col("app")))
    return changed.groupBy(*keys, _hour()).agg(F.count(F.lit(1)).alias("switches"))


def app_streaks(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Longest and mean run of one app, in minutes, and the number of switches."""
    runs = islands(
        intervals, keys, ORDER, day_chunk("timestamp_start"),
        lambda: F.col("__app") != F.col("app"), out="run", lag={"__app": F.col("app")}, uses=["app"],
    )
    per_run = runs.groupBy(*keys, "run").agg(F.sum(scoring.interval_minutes()).alias("minutes"))
    return per_run.groupBy(*keys).agg(
        F.max("minutes").alias("max_streak_minutes"), F.avg("minutes").alias("avg_streak_minutes"),
        (F.count(F.lit(1)) - 1).alias("switches"),
    )


def focus_periods(
    intervals: DataFrame, keys: list[str], focus_threshold: float = 0.6, max_gap_minutes: float = 1.5
) -> DataFrame:
    """Runs of intervals whose focus score reaches the threshold, broken by a lower score or by
    a gap longer than ``max_gap_minutes`` to the interval before."""
    scored = intervals.withColumn("score", scoring.focus_score())
    scored = scored.withColumn("ok", F.col("score") >= focus_threshold)
    broken = lambda: (
        ~F.col("ok") | ~F.col("__ok")
        | (scoring.minutes_between("__end", "timestamp_start") > max_gap_minutes)
    )
    runs = islands(
        scored, keys, ORDER, day_chunk("timestamp_start"), broken, out="period",
        lag={"__ok": F.col("ok"), "__end": F.col("timestamp_end")}, uses=["ok", "timestamp_start"],
    ).filter("ok")
    order = F.struct(*ORDER)
    per_app = runs.groupBy(*keys, "period", "app").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(F.struct(*ORDER, "timestamp_end")).alias("last"), F.sum("score").alias("score"))
    named = F.col("app").isNotNull()
    periods = per_app.groupBy(*keys, "period").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), (F.sum("score") / F.sum("n")).alias("avg_focus_score"), F.sum("n").alias("interval_count"),
        F.min_by("app", F.when(named, F.struct(-F.col("n"), F.col("first")))).alias("primary_app"), F.count("app").alias("n_apps"))
    return (
        periods.withColumns({"start_time": F.col("first.timestamp_start"), "end_time": F.col("last.timestamp_end")})
        .withColumn("duration_minutes", scoring.minutes_between("start_time", "end_time"))
        .drop("period", "first", "last")
    )


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation, NULL below two rows or without variance."""
    usable = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.when(usable, F.corr(x, y)).alias("corr"))


def report_rows(section: str, df: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """A result as (section, key, metric, value) rows."""
    one = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), one.alias("m")).select("section", "key", "m.metric", "m.value")


def insights_report(intervals: DataFrame, segments: DataFrame, chained: DataFrame, tasks: DataFrame, keys: list[str], focus_threshold: float = 0.6,
                    max_gap_minutes: float = 1.5, audio_threshold: float = 0.5) -> DataFrame:
    """The interval, segment and task reports of a period in one table of (section, key, metric, value).

    ``chained`` are the segments with their cluster (``tasks.chain_segments``), ``tasks`` the tasks made of them. The parts
    share the scans of stored tables; each is reduced to at most a few rows per hour, session or task."""
    hour, whole = F.col("hour"), F.lit("all")
    cluster = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("cluster").cast("string"))
    minutes = scoring.interval_minutes()
    scored = intervals.withColumns({"focus": scoring.focus_score(), "mic": _flag("mic_active"), "camera": _flag("camera_active"), "audio": _zero("audio_volume")})
    periods = focus_periods(intervals, keys, focus_threshold, max_gap_minutes).groupBy().agg(
        F.count(F.lit(1)).alias("periods"), F.avg("duration_minutes").alias("avg_minutes"), F.avg("avg_focus_score").alias("avg_focus_score"),
        F.coalesce(F.sum("duration_minutes"), F.lit(0.0)).alias("focus_minutes"))
    copied = _zero("copy_count") + _zero("paste_count")
    totals = scored.groupBy().agg(
        F.sum(minutes).alias("active_minutes"), F.avg("focus").alias("avg_focus_score"), F.sum(copied).alias("copy_paste_events"), (F.sum(copied) / F.sum(minutes)).alias("copy_paste_density"))
    focus = periods.select("focus_minutes").join(F.broadcast(totals.select("active_minutes")))  # one row beside one row
    focus = focus.withColumn("focus_ratio", F.when(F.col("active_minutes") > 0, F.col("focus_minutes") / F.col("active_minutes")).otherwise(0.0))
    hourly = context_switches(intervals, keys).groupBy("hour").agg(F.sum("switches").alias("switches"))
    meetings = meeting_periods(segments).groupBy().agg(F.count(F.lit(1)).alias("meetings"), F.coalesce(F.sum("duration_minutes"), F.lit(0.0)).alias("meeting_minutes"))
    heavy = heavy_segments(segments).groupBy().agg(F.count(F.lit(1)).alias("heavy_segments"))
    use = task_resource_usage(chained, [*keys, "cluster"])
    parts = [
        report_rows("peak_hours", peak_hours(intervals), hour, ["avg_focus_score", "interval_count"]),
        report_rows("interaction", interaction_trends(intervals), hour, ["keys_per_min", "clicks_per_min", "copy_paste_density"]),
        report_rows("interaction", totals, whole, ["copy_paste_events", "copy_paste_density"]),
        report_rows("audio_video", audio_video_series(intervals), hour, ["mic_ratio", "camera_ratio", "audio_avg"]),
        report_rows("system", system_series(intervals), hour, ["cpu_avg", "ram_avg", "gpu_avg"]),
        report_rows("system_by_session", system_by_session(intervals), F.col("session_id"), ["cpu_avg", "ram_avg", "gpu_avg", "interval_count"]),
        report_rows("system_by_task", use, cluster, ["cpu_avg", "ram_avg", "gpu_avg", "duration_minutes"]),
        report_rows("heatmap", heatmap(intervals), hour, ["focus_avg", "input_avg", "system_avg", "audio_avg"]),
        report_rows("context_switches", hourly, hour, ["switches"]),
        report_rows("focus_periods", periods, whole, ["periods", "avg_minutes", "avg_focus_score"]),
        report_rows("productivity", focus, whole, ["focus_minutes", "active_minutes", "focus_ratio"]),
        report_rows("productivity", totals, whole, ["avg_focus_score"]),
        report_rows("audio_engagement", audio_engagement(intervals, audio_threshold), whole, ["engaged_minutes", "engaged_ratio"]),
        report_rows("meetings", meetings, whole, ["meetings", "meeting_minutes"]),
        report_rows("heavy_computation", heavy, whole, ["heavy_segments"]),
        report_rows("heavy_tasks", heavy_tasks(use), cluster, ["cpu_avg", "ram_avg"]),
        report_rows("task_timeline", tasks, cluster, ["duration_minutes", "avg_activity", "confidence"]),
        *[report_rows("correlation", pearson(scored, x, "focus").withColumnRenamed("corr", f"{x}_focus"), whole, [f"{x}_focus"]) for x in ("mic", "camera", "audio")],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
