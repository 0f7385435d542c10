"""Interval scores, hourly series, focus periods and resource reports."""

from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.operators import insights
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.sources import tables as src

S = with_views("scored")


@query("interval_scores", "H18 H20 H21 H38", S + """
SELECT event_id, minutes, round(input_score, 6) AS input_score, round(system_score, 6) AS system_score,
  round(audio_context_score, 6) AS audio_context_score, round(focus_score, 6) AS focus_score, time_of_day,
  day_of_week::BIGINT AS day_of_week, is_weekend, is_work_hours
FROM scored""")
def interval_scores(spark, sf):
    iv = src.intervals_flat(spark, sf)
    return iv.select(
        "event_id", scoring.interval_minutes().alias("minutes"), scoring.input_score().alias("input_score"),
        scoring.system_score().alias("system_score"), scoring.audio_context_score().alias("audio_context_score"),
        scoring.focus_score().alias("focus_score"), "time_of_day", "day_of_week", "is_weekend", "is_work_hours",
    )


@query("peak_hours", "D31 F02", S + """
SELECT hour(timestamp_start)::BIGINT AS hour, round(avg(focus_score), 6) AS avg_focus_score, count(*) AS interval_count
FROM scored GROUP BY 1 ORDER BY 2 DESC, 1""")
def peak_hours(spark, sf):
    return insights.peak_hours(src.intervals_flat(spark, sf))


def hourly_sql(values: str, names: list[str], user: bool = False) -> str:
    cols = ", ".join(f"round(coalesce({n}, 0.0), 6) AS {n}" for n in names)
    if user:
        return with_views("scored") + f""", agg AS (SELECT user_id, hour(timestamp_start) AS h, {values} FROM scored GROUP BY 1, 2)
SELECT u.user_id, hours.h::BIGINT AS hour, {cols} FROM (SELECT DISTINCT user_id FROM scored) u
CROSS JOIN range(24) hours(h) LEFT JOIN agg ON agg.user_id = u.user_id AND agg.h = hours.h"""
    return with_views("scored") + f""", agg AS (SELECT hour(timestamp_start) AS h, {values} FROM scored GROUP BY 1)
SELECT hours.h::BIGINT AS hour, {cols} FROM range(24) hours(h) LEFT JOIN agg ON agg.h = hours.h"""


TREND = """sum(trunc(keyboard_intensity * minutes)) / sum(minutes) AS keys_per_min, sum(mouse_clicks) / sum(minutes) AS clicks_per_min,
  sum(copy_count + paste_count) / sum(minutes) AS copy_paste_density"""
TREND_NAMES = ["keys_per_min", "clicks_per_min", "copy_paste_density"]


@query("hourly_interaction", "D32", hourly_sql(TREND, TREND_NAMES))
def hourly_interaction(spark, sf):
    return insights.interaction_trends(src.intervals_flat(spark, sf))


@query("hourly_interaction_by_user", "D32", hourly_sql(TREND, TREND_NAMES, user=True))
def hourly_interaction_by_user(spark, sf):
    return insights.interaction_trends(src.intervals_flat(spark, sf), ["user_id"])


@query("hourly_audio_video", "D33", hourly_sql(
    "avg(mic_active::INT) AS mic_ratio, avg(camera_active::INT) AS camera_ratio, avg(audio_volume) AS audio_avg",
    ["mic_ratio", "camera_ratio", "audio_avg"]))
def hourly_audio_video(spark, sf):
    return insights.audio_video_series(src.intervals_flat(spark, sf))


@query("hourly_system", "D34", hourly_sql(
    "avg(cpu_usage) AS cpu_avg, avg(ram_usage) AS ram_avg, avg(gpu_usage) AS gpu_avg", ["cpu_avg", "ram_avg", "gpu_avg"]))
def hourly_system(spark, sf):
    return insights.system_series(src.intervals_flat(spark, sf))


@query("hourly_heatmap", "D35", hourly_sql(
    "avg(focus_score) AS focus_avg, avg(input_score) AS input_avg, avg(system_score) AS system_avg, avg(audio_volume) AS audio_avg",
    ["focus_avg", "input_avg", "system_avg", "audio_avg"]))
def hourly_heatmap(spark, sf):
    return insights.heatmap(src.intervals_flat(spark, sf))


@query("hourly_heatmap_by_user", "D35", hourly_sql(
    "avg(focus_score) AS focus_avg, avg(input_score) AS input_avg, avg(system_score) AS system_avg, avg(audio_volume) AS audio_avg",
    ["focus_avg", "input_avg", "system_avg", "audio_avg"], user=True))
def hourly_heatmap_by_user(spark, sf):
    return insights.heatmap(src.intervals_flat(spark, sf), ["user_id"])


@query("audio_engagement", "B10", S + """
SELECT 0.5::DOUBLE AS threshold, round(sum(CASE WHEN audio_volume >= 0.5 THEN minutes ELSE 0 END), 6) AS engaged_minutes,
  round(sum(CASE WHEN audio_volume >= 0.5 THEN minutes ELSE 0 END) / sum(minutes), 6) AS engaged_ratio FROM scored""")
def audio_engagement(spark, sf):
    return insights.audio_engagement(src.intervals_flat(spark, sf))


@query("system_by_session", "D36", with_views("iv") + """
SELECT coalesce(session_id, 'unassigned') AS session_id, round(avg(cpu_usage), 6) AS cpu_avg, round(avg(ram_usage), 6) AS ram_avg,
  round(avg(gpu_usage), 6) AS gpu_avg, count(*) AS interval_count FROM iv GROUP BY 1""")
def system_by_session(spark, sf):
    return insights.system_by_session(src.interval_signals(spark, sf))


@query("context_switches_by_hour", "G05", S + """
SELECT user_id, hour(timestamp_start)::BIGINT AS hour, count(*) AS switches FROM (
  SELECT *, lag(app) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS prev FROM scored) t
WHERE prev <> app GROUP BY 1, 2""")
def context_switches_by_hour(spark, sf):
    return insights.context_switches(src.intervals_flat(spark, sf), ["user_id"])


@query("app_streaks", "G06", S + """, runs AS (
  SELECT *, sum(CASE WHEN prev = app THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS run FROM (
    SELECT *, lag(app) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS prev FROM scored) t),
per_run AS (SELECT user_id, run, sum(minutes) AS m FROM runs GROUP BY 1, 2)
SELECT user_id, round(max(m), 6) AS max_streak_minutes, round(avg(m), 6) AS avg_streak_minutes, count(*) - 1 AS switches
FROM per_run GROUP BY 1""")
def app_streaks(spark, sf):
    return insights.app_streaks(src.intervals_flat(spark, sf), ["user_id"])


view("focus_runs", ["scored"], """
SELECT * FROM (SELECT *, sum(CASE WHEN ok AND prev_ok AND (epoch_us(timestamp_start) - epoch_us(prev_end)) / 6e7 <= 300 THEN 0 ELSE 1 END)
    OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS period FROM (
  SELECT *, focus_score >= 0.6 AS ok, lag(focus_score >= 0.6) OVER w AS prev_ok, lag(timestamp_end) OVER w AS prev_end
  FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_start, event_id)) a) b WHERE ok
""")


@query("focus_periods", "G04 F03 S03", with_views("focus_runs") + """,
apps AS (SELECT user_id, period, app, count(*) AS n, min(timestamp_start) AS f FROM focus_runs GROUP BY 1, 2, 3),
prim AS (SELECT user_id, period, app, count(*) OVER (PARTITION BY user_id, period) AS n_apps,
  row_number() OVER (PARTITION BY user_id, period ORDER BY n DESC, f) AS r FROM apps),
spans AS (SELECT user_id, period, min(timestamp_start) AS start_time, max_by(timestamp_end, epoch_us(timestamp_start)) AS end_time,
  avg(focus_score) AS s, count(*) AS interval_count FROM focus_runs GROUP BY 1, 2)
SELECT user_id, start_time, end_time, round(s, 6) AS avg_focus_score, interval_count, app AS primary_app, n_apps,
  round((epoch_us(end_time) - epoch_us(start_time)) / 6e7, 6) AS duration_minutes
FROM spans JOIN prim USING (user_id, period) WHERE r = 1""")
def focus_periods(spark, sf):
    return insights.focus_periods(src.intervals_flat(spark, sf), ["user_id"], max_gap_minutes=src.FOCUS_GAP_MINUTES)


@query("pearson_by_user", "D38", S + """
SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 2 AND stddev_pop(cpu_usage) > 0 AND stddev_pop(keyboard_intensity) > 0
  THEN corr(cpu_usage, keyboard_intensity) END, 6) AS corr FROM scored GROUP BY 1""")
def pearson_by_user(spark, sf):
    return insights.pearson(src.intervals_flat(spark, sf), "cpu_usage", "keyboard_intensity", ["user_id"])


@query("sessions", "G02 S03", with_views("sess") + """
SELECT user_id, session_id, start_time, end_time, keys, clicks, mouse_distance, total_events, n_apps,
  array_to_string(apps, ',') AS apps, task_id, round(focus_continuity, 6) AS focus_continuity, round(entropy, 6) AS entropy,
  device_id, round(duration_seconds, 6) AS duration_seconds FROM sess""")
def sessions(spark, sf):
    return src.sessions(spark, sf).withColumn("apps", F.array_join("apps", ","))
