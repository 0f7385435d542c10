"""Assembled reports, exports and time parsing."""

import uuid

from pyspark.sql import functions as F

from worklens.operators import insights, trends
from worklens.plans import daily_queries as days
from worklens.plans import feature_queries, insight_queries, segment_queries, task_queries  # noqa: F401  (define the views)
from worklens.plans.prelude import with_views
from worklens.plans.registry import query
from worklens.session import shared_folder
from worklens.sources import sinks
from worklens.sources import tables as src


def hour_rows(section: str, names: dict[str, str], fill: bool = True) -> str:
    agg = ", ".join(f"{e} AS {n}" for n, e in names.items())
    parts = []
    for n in names:
        value = f"round(coalesce(a.{n}, 0.0), 6)" if fill else f"round(a.{n}, 6)"
        base = f"range(24) h(h) LEFT JOIN (SELECT hour(timestamp_start) AS hr, {agg} FROM scored GROUP BY 1) a ON a.hr = h.h" if fill else f"(SELECT hour(timestamp_start) AS h, {agg} FROM scored GROUP BY 1) a"
        parts.append(f"SELECT '{section}' AS section, {'h.h' if fill else 'a.h'}::VARCHAR AS key, '{n}' AS metric, {value}::DOUBLE AS value FROM {base}")
    return " UNION ALL ".join(parts)


FP = """fp AS (SELECT user_id, period, avg(focus_score) AS s, (epoch_us(max_by(timestamp_end, epoch_us(timestamp_start))) - epoch_us(min(timestamp_start))) / 6e7 AS d FROM focus_runs GROUP BY 1, 2),
sw AS (SELECT hour(timestamp_start) AS h, count(*) AS n FROM (SELECT *, lag(app) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS prev FROM scored) t WHERE prev <> app GROUP BY 1)"""


MEANS = {"cpu_avg": "round(avg(cpu_usage), 6)", "ram_avg": "round(avg(ram_usage), 6)", "gpu_avg": "round(avg(gpu_usage), 6)"}
TASK_MEANS = {m: e.replace("avg(", "avg(mean_") for m, e in MEANS.items()}


@query("insights_report", "D39", with_views("focus_runs", "seg", "iv", "chained", "task_rows") + ",\n" + FP + "\n" + " UNION ALL ".join([
    hour_rows("peak_hours", {"avg_focus_score": "avg(focus_score)", "interval_count": "count(*)"}, fill=False),
    hour_rows("interaction", {"keys_per_min": "sum(trunc(keyboard_intensity * minutes)) / sum(minutes)", "clicks_per_min": "sum(mouse_clicks) / sum(minutes)", "copy_paste_density": "sum(copy_count + paste_count) / sum(minutes)"}),
    hour_rows("audio_video", {"mic_ratio": "avg(mic_active::INT)", "camera_ratio": "avg(camera_active::INT)", "audio_avg": "avg(audio_volume)"}),
    hour_rows("system", {"cpu_avg": "avg(cpu_usage)", "ram_avg": "avg(ram_usage)", "gpu_avg": "avg(gpu_usage)"}),
    hour_rows("heatmap", {"focus_avg": "avg(focus_score)", "input_avg": "avg(input_score)", "system_avg": "avg(system_score)", "audio_avg": "avg(audio_volume)"}),
    "SELECT 'context_switches', h::VARCHAR, 'switches', n::DOUBLE FROM sw",
    "SELECT 'focus_periods', 'all', 'periods', count(*)::DOUBLE FROM fp", "SELECT 'focus_periods', 'all', 'avg_minutes', round(avg(d), 6) FROM fp", "SELECT 'focus_periods', 'all', 'avg_focus_score', round(avg(s), 6) FROM fp",
    "SELECT 'audio_engagement', 'all', 'engaged_minutes', round(sum(CASE WHEN audio_volume >= 0.5 THEN minutes ELSE 0 END), 6) FROM scored",
    "SELECT 'audio_engagement', 'all', 'engaged_ratio', round(sum(CASE WHEN audio_volume >= 0.5 THEN minutes ELSE 0 END) / sum(minutes), 6) FROM scored",
    "SELECT 'meetings', 'all', 'meetings', count(*)::DOUBLE FROM seg WHERE mic_active_ratio >= 0.6 OR camera_active_ratio >= 0.4",
    "SELECT 'meetings', 'all', 'meeting_minutes', round(sum(duration_minutes), 5) FROM seg WHERE mic_active_ratio >= 0.6 OR camera_active_ratio >= 0.4",
    "SELECT 'heavy_computation', 'all', 'heavy_segments', count(*)::DOUBLE FROM seg WHERE mean_cpu_usage >= 0.7 OR mean_ram_usage >= 0.8 OR coalesce(mean_gpu_usage, 0) >= 0.6",
    "SELECT 'interaction', 'all', 'copy_paste_events', sum(copy_count + paste_count)::DOUBLE FROM scored",
    "SELECT 'interaction', 'all', 'copy_paste_density', round(sum(copy_count + paste_count) / sum(minutes), 6) FROM scored",
    *[f"SELECT 'system_by_session', coalesce(session_id, 'unassigned'), '{m}', {e} FROM iv GROUP BY 2" for m, e in {**MEANS, "interval_count": "count(*)::DOUBLE"}.items()],
    *[f"SELECT 'system_by_task', user_id::VARCHAR || '/' || cluster::VARCHAR, '{m}', {e} FROM chained GROUP BY 2" for m, e in {**TASK_MEANS, "duration_minutes": "round(sum(duration_minutes), 6)"}.items()],
    *[f"SELECT 'heavy_tasks', user_id::VARCHAR || '/' || cluster::VARCHAR, '{m}', {TASK_MEANS[m]} FROM chained GROUP BY 2 HAVING avg(mean_cpu_usage) >= 0.7 OR avg(mean_ram_usage) >= 0.8" for m in ("cpu_avg", "ram_avg")],
    *[f"SELECT 'task_timeline', user_id::VARCHAR || '/' || cluster::VARCHAR, '{m}', round({m}, 6) FROM task_rows" for m in ("duration_minutes", "avg_activity", "confidence")],
    "SELECT 'productivity', 'all', 'focus_minutes', round(sum(d), 4) FROM fp", "SELECT 'productivity', 'all', 'active_minutes', round(sum(minutes), 4) FROM scored",
    "SELECT 'productivity', 'all', 'focus_ratio', round((SELECT sum(d) FROM fp) / sum(minutes), 6) FROM scored", "SELECT 'productivity', 'all', 'avg_focus_score', round(avg(focus_score), 6) FROM scored",
    *[f"SELECT 'correlation', 'all', '{n}_focus', round(corr({e}, focus_score), 6) FROM scored" for n, e in {"mic": "mic_active::INT", "camera": "camera_active::INT", "audio": "audio_volume"}.items()]]))
def insights_report(spark, sf):
    out = insights.insights_report(src.interval_signals(spark, sf), src.segments(spark, sf), task_queries.chained(spark, sf), task_queries.task_table(spark, sf),
                                   ["user_id"], max_gap_minutes=src.FOCUS_GAP_MINUTES)
    total = F.col("metric").isin("focus_minutes", "active_minutes")
    return out.withColumn("value", F.when(F.col("metric") == "meeting_minutes", F.round("value", 5)).when(total, F.round("value", 4)).otherwise(F.col("value")))


@query("day_report", "D59", with_views("numday") + f"""
SELECT user_id, day::VARCHAR AS day, session_count, round(total_active_seconds, 6) AS total_active_seconds, most_used_app, round(focus_ratio, 6) AS focus_ratio, {days.DELTAS}, {days.PATTERNS} FROM numday {days.WINDOWS}""")
def day_report(spark, sf):
    rows = trends.pattern_flags(trends.day_deltas(days.daily_table(spark, sf)))
    return rows.select("user_id", "day", "session_count", "total_active_seconds", "most_used_app", "focus_ratio", *days.DELTA_NAMES, "patterns")


@query("exported_segments", "A25 A26", with_views("seg") + """
SELECT kind, count(*) AS segments, round(sum(duration_minutes), 4) AS minutes, count(DISTINCT primary_app) AS apps FROM seg, (VALUES ('csv'), ('json')) k(kind) GROUP BY 1""")
def exported_segments(spark, sf):
    base = f"{shared_folder(spark)}/worklens-export-{uuid.uuid4().hex[:8]}"
    rows = src.segments(spark, sf).select("segment_id", "primary_app", "duration_minutes", "keyboard_intensity_avg", "mean_cpu_usage", "activity_score", "is_multitasking", "is_active_work")
    sinks.export_csv(rows, f"{base}/csv")
    sinks.export_json(rows, f"{base}/json")
    schema = rows.schema
    back = spark.read.schema(schema).option("header", True).csv(f"{base}/csv").withColumn("kind", F.lit("csv")).unionByName(
        spark.read.schema(schema).json(f"{base}/json").withColumn("kind", F.lit("json")))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration_minutes"), 4).alias("minutes"), F.countDistinct("primary_app").alias("apps"))


@query("parsed_timestamps", "H35 H36", with_views("ev") + """
SELECT event_id, CASE WHEN k % 2 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS parsed, CAST(CASE WHEN k % 2 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS DATE)::VARCHAR AS day, k % 10 <> 9 AS readable FROM ev WHERE k % 10 <> 9
UNION ALL SELECT event_id, NULL, NULL, false FROM ev WHERE k % 10 = 9""")
def parsed_timestamps(spark, sf):
    ev = src.events(spark, sf)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = F.when(F.col("k") % 10 == 9, "no time").when(F.col("k") % 2 == 0, F.concat(iso, F.lit("+02:00"))).otherwise(iso)
    rows = ev.select("event_id", F.try_to_timestamp(written).alias("parsed"))
    return rows.select("event_id", "parsed", F.to_date("parsed").alias("day"), F.col("parsed").isNotNull().alias("readable"))
