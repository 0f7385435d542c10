"""Work segments and what is derived from them."""

from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.operators import insights, segments
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.sources import tables as src

BROWSERS = "['chrome', 'firefox', 'edge', 'safari', 'msedge', 'opera']"
IDES = "['vscode', 'code', 'pycharm', 'idea', 'eclipse', 'sublime']"


def similarity_sql(a: str, b: str) -> str:
    wa, wb = (f"string_split(replace(lower({x}), '.exe', ''), '_')" for x in (a, b))
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN list_has_any({wa}, {wb}) THEN 0.8
      WHEN list_has_any({wa}, {BROWSERS}) AND list_has_any({wb}, {BROWSERS}) THEN 0.9
      WHEN list_has_any({wa}, {IDES}) AND list_has_any({wb}, {IDES}) THEN 0.9 ELSE 0.3 END"""


view("marked", ["iv"], f"""
SELECT *, sum(CASE WHEN prev_end IS NULL OR (epoch_us(timestamp_start) - epoch_us(prev_end)) / 6e7 > 300
    OR (prev_app <> app AND {similarity_sql('prev_app', 'app')} < 0.7) THEN 1 ELSE 0 END) OVER w AS segment_no
FROM (SELECT *, lag(timestamp_end) OVER w AS prev_end, lag(app) OVER w AS prev_app FROM iv
      WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_start, event_id)) t
WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_start, event_id)
""")

view("seg_apps", ["marked"], """
SELECT user_id, segment_no, app, sum(minutes) AS m, min(timestamp_start) AS f FROM marked GROUP BY 1, 2, 3
""")

view("seg", ["marked", "seg_apps"], """
SELECT *, least(1.0, keyboard_intensity_avg / 60.0) / 2.0 + least(1.0, mouse_intensity_avg / 10.0) / 2.0 AS activity_score,
  (least(1.0, unique_apps / 5.0) + least(1.0, app_switches / duration_minutes)) / 2.0 AS multitasking_score,
  'seg_' || strftime(start_time, '%Y%m%d_%H%M%S') || '_' || segment_no::VARCHAR AS segment_id
FROM (SELECT *, total_mouse_clicks / duration_minutes AS mouse_intensity_avg FROM (
  SELECT user_id, segment_no, min(timestamp_start) AS start_time, arg_max(timestamp_end, epoch_us(timestamp_start)) AS end_time,
    (epoch_us(arg_max(timestamp_end, epoch_us(timestamp_start))) - epoch_us(min(timestamp_start))) / 6e7 AS duration_minutes,
    count(*) AS interval_count, sum(copy_count)::BIGINT AS total_copy_events, sum(paste_count)::BIGINT AS total_paste_events,
    sum(cut_count)::BIGINT AS total_cut_events, sum(trunc(keyboard_intensity * minutes))::BIGINT AS total_keyboard_keys,
    sum(mouse_clicks)::BIGINT AS total_mouse_clicks, sum(mouse_distance) AS total_mouse_distance,
    avg(keyboard_intensity) AS keyboard_intensity_avg, avg(cpu_usage) AS mean_cpu_usage, max(cpu_usage) AS max_cpu_usage,
    avg(ram_usage) AS mean_ram_usage, max(ram_usage) AS max_ram_usage, avg(gpu_usage) AS mean_gpu_usage,
    max(audio_volume) AS max_audio_volume, avg(mic_active::INT) AS mic_active_ratio, avg(camera_active::INT) AS camera_active_ratio,
    count(DISTINCT app) AS unique_apps, count(DISTINCT window_title) AS unique_titles,
    (SELECT app FROM seg_apps a WHERE a.user_id = marked.user_id AND a.segment_no = marked.segment_no ORDER BY m DESC, f LIMIT 1) AS primary_app,
    arg_min(session_id, epoch_us(timestamp_start)) FILTER (WHERE true) AS any_session,
    arg_min(time_of_day, epoch_us(timestamp_start)) AS time_of_day,
    arg_min(is_weekend, epoch_us(timestamp_start)) AS is_weekend, arg_min(is_work_hours, epoch_us(timestamp_start)) AS is_work_hours
  FROM marked GROUP BY user_id, segment_no) a
  JOIN (SELECT user_id, segment_no, window_title AS primary_window_title FROM (
      SELECT user_id, segment_no, window_title, row_number() OVER (PARTITION BY user_id, segment_no ORDER BY count(*) DESC, min(timestamp_start)) AS r
      FROM marked GROUP BY 1, 2, 3) x WHERE r = 1) b USING (user_id, segment_no)
  JOIN (SELECT user_id, segment_no, count(CASE WHEN prev <> app THEN 1 END) AS app_switches FROM (
      SELECT *, lag(app) OVER (PARTITION BY user_id, segment_no ORDER BY timestamp_start, event_id) AS prev FROM marked) y GROUP BY 1, 2) c
    USING (user_id, segment_no)
  JOIN (SELECT user_id, segment_no, session_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, segment_no ORDER BY timestamp_start, event_id) AS r
      FROM marked) z WHERE r = 1) d USING (user_id, segment_no)
  WHERE duration_minutes >= 600) t
""")

SEG = with_views("seg")


marked = src.interval_segments
seg = src.segments


SEG_NUM = ["duration_minutes", "total_mouse_distance", "keyboard_intensity_avg", "mouse_intensity_avg", "mean_cpu_usage", "max_cpu_usage",
           "mean_ram_usage", "max_ram_usage", "mean_gpu_usage", "max_audio_volume", "mic_active_ratio", "camera_active_ratio",
           "multitasking_score", "activity_score"]
SEG_TEXT = ["user_id", "segment_no", "segment_id", "session_id", "start_time", "end_time", "interval_count", "total_copy_events",
            "total_paste_events", "total_cut_events", "total_keyboard_keys", "total_mouse_clicks", "primary_app", "primary_window_title",
            "unique_apps", "unique_titles", "app_switches", "time_of_day", "is_weekend", "is_work_hours"]


@query("work_segments", "G03 B07 D05 D06 D07 D08 D09 D10 H08", SEG + "SELECT " + ", ".join(SEG_TEXT).replace("segment_no,", "segment_no::BIGINT AS segment_no,")
       + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in SEG_NUM)
       + ", multitasking_score > 0.5 AS is_multitasking, activity_score > 0.3 AS is_active_work, NOT activity_score > 0.3 AS is_passive_work FROM seg")
def work_segments(spark, sf):
    return seg(spark, sf).select(*SEG_TEXT, *SEG_NUM, "is_multitasking", "is_active_work", "is_passive_work")


@query("segment_app_time", "D08 D50", SEG + """
SELECT user_id, segment_no::BIGINT AS segment_no, app, round(m, 6) AS minutes FROM seg_apps SEMI JOIN seg USING (user_id, segment_no)""")
def segment_app_time(spark, sf):
    return segments.app_time(marked(spark, sf), src.MIN_SEGMENT_MINUTES)


@query("time_per_app", "D50 F05", SEG + """
SELECT app, round(sum(m), 6) AS minutes FROM seg_apps SEMI JOIN seg USING (user_id, segment_no) GROUP BY 1""")
def time_per_app(spark, sf):
    return segments.app_time(marked(spark, sf), src.MIN_SEGMENT_MINUTES).groupBy("app").agg(F.sum("minutes").alias("minutes"))


@query("active_segments", "B06", SEG + "SELECT user_id, segment_id, round(activity_score, 6) AS activity_score FROM seg WHERE activity_score >= 0.1")
def active_segments(spark, sf):
    return segments.active_segments(seg(spark, sf)).select("user_id", "segment_id", "activity_score")


@query("meeting_periods", "B08", SEG + """
SELECT user_id, segment_id, start_time, end_time, round(duration_minutes, 6) AS duration_minutes, primary_app,
  round(mic_active_ratio, 6) AS mic_ratio, round(camera_active_ratio, 6) AS camera_ratio
FROM seg WHERE mic_active_ratio >= 0.6 OR camera_active_ratio >= 0.4""")
def meeting_periods(spark, sf):
    return insights.meeting_periods(seg(spark, sf))


@query("heavy_segments", "B09", SEG + """
SELECT segment_id, primary_app, round(mean_cpu_usage, 6) AS cpu_avg, round(mean_ram_usage, 6) AS ram_avg, round(mean_gpu_usage, 6) AS gpu_avg
FROM seg WHERE mean_cpu_usage >= 0.7 OR mean_ram_usage >= 0.8 OR coalesce(mean_gpu_usage, 0) >= 0.6""")
def heavy_segments(spark, sf):
    return insights.heavy_segments(seg(spark, sf))


@query("segment_filters", "B11", SEG + """
SELECT user_id, segment_id, primary_app, round(duration_minutes, 6) AS duration_minutes FROM seg
WHERE primary_app IN ('code.exe', 'chrome.exe') AND activity_score > 0.3 AND duration_minutes > 720 AND is_work_hours AND mean_cpu_usage > 0.4""")
def segment_filters(spark, sf):
    wanted = (
        F.col("primary_app").isin("code.exe", "chrome.exe") & F.col("is_active_work") & (F.col("duration_minutes") > 720)
        & F.col("is_work_hours") & scoring.above(F.col("mean_cpu_usage"), 0.4)
    )
    return seg(spark, sf).filter(wanted).select("user_id", "segment_id", "primary_app", "duration_minutes")


@query("productivity_by_user", "B13", SEG + """
SELECT user_id, round(sum(CASE WHEN activity_score > 0.3 THEN duration_minutes ELSE 0 END) / sum(duration_minutes), 6) AS active_ratio,
  round(sum(CASE WHEN multitasking_score > 0.5 THEN duration_minutes ELSE 0 END), 6) AS multitasking_minutes,
  round(sum(CASE WHEN multitasking_score > 0.5 THEN 0 ELSE duration_minutes END), 6) AS focused_minutes FROM seg GROUP BY 1""")
def productivity_by_user(spark, sf):
    return segments.productivity_ratio(seg(spark, sf), ["user_id"])


@query("segment_totals", "D50", SEG + """
SELECT count(*) AS segments, round(sum(duration_minutes) / 60.0, 6) AS hours, round(avg(duration_minutes), 6) AS avg_minutes,
  round(avg((activity_score > 0.3)::INT), 6) AS active_ratio, round(avg((NOT activity_score > 0.3)::INT), 6) AS passive_ratio,
  round(avg((multitasking_score > 0.5)::INT), 6) AS multitask_ratio, round(avg(mean_cpu_usage), 6) AS avg_cpu,
  round(avg(mean_ram_usage), 6) AS avg_ram FROM seg""")
def segment_totals(spark, sf):
    return segments.segment_totals(seg(spark, sf))


@query("segments_by_time_of_day", "D50", SEG + """
SELECT time_of_day, count(*) AS segments, round(avg(activity_score), 6) AS avg_activity FROM seg GROUP BY 1""")
def segments_by_time_of_day(spark, sf):
    return seg(spark, sf).groupBy("time_of_day").agg(F.count(F.lit(1)).alias("segments"), F.avg("activity_score").alias("avg_activity"))
