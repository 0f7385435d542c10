"""Scans, sinks, retention and maintenance of the stored tables."""

import datetime
import uuid

from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.operators import insights, retention, scans, segments
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.plans.text_queries import clean_sql
from worklens.session import shared_folder, stored
from worklens.sources import dated, sinks
from worklens.sources import tables as src

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("newest_error_events", "A02 F01", with_views("ev") + "SELECT event_id, ts, k::VARCHAR AS k FROM ev WHERE event_type = 'error' ORDER BY ts DESC LIMIT 100")
def newest_error_events(spark, sf):
    return scans.events_of_type(src.events(spark, sf), "error", 100).select("event_id", "ts", F.col("payload")["k"].alias("k"))


@query("session_events", "A03", with_views("front") + """
SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_start, event_id) AS position FROM front""")
def session_events(spark, sf):
    from worklens.functions.sequence import day_chunk, scan_rows

    rows = src.interval_signals(spark, sf).filter("session_id is not null").select("event_id", "session_id", "timestamp_start")
    return scan_rows(rows, ["session_id"], ["timestamp_start", "event_id"], day_chunk("timestamp_start"), run_sum={"position": F.lit(1)}).drop("timestamp_start")


@query("background_events", "A04", with_views("iv") + "SELECT event_id, timestamp_start AS ts FROM iv WHERE session_id IS NULL")
def background_events(spark, sf):
    return src.interval_signals(spark, sf).filter("session_id is null").select("event_id", F.col("timestamp_start").alias("ts"))


@query("interval_defaults", "A05", with_views("flat") + """
SELECT event_id, CASE WHEN k % 3 = 0 THEN 0.0 ELSE cpu_usage END AS cpu_usage, CASE WHEN k % 4 = 0 THEN false ELSE mic_active END AS mic_active,
  CASE WHEN k % 5 = 0 THEN 'unknown' ELSE time_of_day END AS time_of_day, gpu_usage FROM flat""")
def interval_defaults(spark, sf):
    iv = src.intervals_flat(spark, sf)
    holes = iv.withColumns({
        "cpu_usage": F.when(F.col("k") % 3 != 0, F.col("cpu_usage")), "mic_active": F.when(F.col("k") % 4 != 0, F.col("mic_active")),
        "time_of_day": F.when(F.col("k") % 5 != 0, F.col("time_of_day"))})
    return scans.fill_interval_defaults(holes).select("event_id", "cpu_usage", "mic_active", "time_of_day", "gpu_usage")


@query("intervals_overlapping_period", "A06 B12", with_views("flat") + """
SELECT event_id, timestamp_start, timestamp_end FROM flat WHERE timestamp_start < TIMESTAMP '2024-01-12 00:00:00' AND timestamp_end > TIMESTAMP '2024-01-10 00:00:00'
ORDER BY timestamp_start DESC, event_id DESC LIMIT 1000""")
def intervals_overlapping_period(spark, sf):
    rows = scans.in_period(src.intervals_flat(spark, sf), "timestamp_start", "timestamp_end", "2024-01-10", "2024-01-12")
    return scans.newest(rows, "timestamp_start", 1000, "event_id").select("event_id", "timestamp_start", "timestamp_end")


@query("sessions_in_dates", "B12 A32", with_views("sess") + "SELECT session_id FROM sess WHERE end_time >= TIMESTAMP '2024-01-10 00:00:00' AND start_time <= TIMESTAMP '2024-01-12 00:00:00'")
def sessions_in_dates(spark, sf):
    return scans.in_period(src.sessions(spark, sf), "start_time", "end_time", "2024-01-10", "2024-01-12", closed=True).select("session_id")


@query("state_history_range", "A07 A27", with_views("state_changes") + """
SELECT event_id, ts, state, active_task FROM state_changes WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def state_history_range(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-20"))
    return src.state_changes(spark, sf).filter(F.col("ts").between(lo, hi)).orderBy("ts").select("event_id", "ts", "state", "active_task")


@query("segments_inside_period", "A10", with_views("seg") + """
SELECT segment_id, user_id, start_time, end_time FROM seg WHERE start_time >= TIMESTAMP '2024-01-08 00:00:00' AND end_time <= TIMESTAMP '2024-01-20 00:00:00'
ORDER BY start_time DESC, segment_id DESC LIMIT 500""")
def segments_inside_period(spark, sf):
    rows = scans.in_period(src.segments(spark, sf), "start_time", "end_time", "2024-01-08", "2024-01-20", overlap=False)
    return scans.newest(rows, "start_time", 500, "segment_id").select("segment_id", "user_id", "start_time", "end_time")


@query("latest_state_per_user", "A12 A14 A15 A33", with_views("state_changes") + """
SELECT user_id, max(ts) AS ts, max_by(state, epoch_us(ts)) AS state, max_by(active_task, epoch_us(ts)) AS active_task FROM state_changes GROUP BY 1""")
def latest_state_per_user(spark, sf):
    rows = src.state_changes(spark, sf).select("user_id", "ts", "event_id", "state", "active_task")
    return scans.latest_per_key(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "state", "active_task")


@query("newest_predictions", "A16", with_views("task_segments") + """
SELECT * FROM (SELECT user_id, segment_id, task_id, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, segment_id DESC) AS rank FROM task_segments) t WHERE rank <= 10""")
def newest_predictions(spark, sf):
    rows = src.task_segments(spark, sf).select("user_id", "segment_id", "task_id", "start_time")
    return scans.newest_per_key(rows, ["user_id"], ["start_time", "segment_id"], 10).drop("start_time")


@query("upserted_sessions", "A18", with_views("sess") + """
SELECT session_id, CASE WHEN user_id % 2 = 0 THEN keys + 1000 ELSE keys END AS keys, CASE WHEN user_id % 2 = 0 THEN end_time + INTERVAL 1 HOUR ELSE end_time END AS updated_at FROM sess""")
def upserted_sessions(spark, sf):
    old = src.sessions(spark, sf).select("session_id", "keys", F.col("end_time").alias("updated_at"), "user_id")
    new = old.filter("user_id % 2 = 0").withColumns({"keys": F.col("keys") + 1000, "updated_at": F.col("updated_at") + F.expr("interval 1 hour")})
    return sinks.upsert(old.drop("user_id"), new.drop("user_id"), ["session_id"], ["updated_at"])


@query("replaced_segments", "A19", with_views("task_segments") + """
SELECT segment_id, session_id, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE task_id END AS task_id FROM task_segments WHERE user_id % 3 <> 0 OR segment_id % 4 <> 0""")
def replaced_segments(spark, sf):
    old = src.task_segments(spark, sf).select("segment_id", "session_id", "task_id", "user_id")
    fresh = old.filter("user_id % 3 = 0").withColumn("task_id", F.when(F.col("segment_id") % 4 != 0, "new"))
    return sinks.replace_by_key(old, fresh, ["session_id"], ["task_id"]).drop("user_id")


@query("sessions_after_delete", "A22", with_views("sess", "task_segments") + """
SELECT 'sessions' AS table, count(*) AS rows FROM sess WHERE keys % 7 <> 0
UNION ALL SELECT 'segments', count(*) FROM task_segments WHERE session_id IN (SELECT session_id FROM sess WHERE keys % 7 <> 0)""")
def sessions_after_delete(spark, sf):
    rows = src.sessions(spark, sf)
    gone = rows.filter("keys % 7 = 0").select("session_id")
    count = lambda df, name: sinks.delete_keys(df, gone, ["session_id"]).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
    return count(rows, "sessions").unionByName(count(src.task_segments(spark, sf), "segments"))


@query("appended_events_by_date", "A01 A05 A08 A11 A13 A17 A28", with_views("ev") + """
SELECT CAST(ts AS DATE)::VARCHAR AS date, count(*) AS events, max(ts) AS newest FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1""")
def appended_events_by_date(spark, sf):
    path = f"{shared_folder(spark)}/worklens-append-{uuid.uuid4().hex[:8]}"
    ev = src.events(spark, sf).select("event_id", "ts", "event_type", "props")
    sinks.append(ev.filter("event_type <> 'view'"), path, "ts")
    sinks.append(ev.filter("event_type = 'view'"), path, "ts")
    stored = spark.read.parquet(path)
    return stored.filter(F.col("date") >= F.lit("2024-01-10").cast("date")).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/worklens-{name}-{uuid.uuid4().hex[:8]}"


@query("state_change_log", "A08", with_views("state_changes") + """
SELECT CAST(ts AS DATE)::VARCHAR AS date, 'dev' || (user_id % 3)::VARCHAR AS session_id, state, count(*) AS changes, min(ts) AS first_ts, max(ts) AS last_ts FROM state_changes GROUP BY 1, 2, 3""")
def state_change_log(spark, sf):
    path = _folder(spark, "states")
    sinks.log_state_changes(src.state_changes(spark, sf).withColumn("session_id", F.concat(F.lit("dev"), (F.col("user_id") % 3).cast("string"))), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"), "session_id", "state").agg(
        F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("analytics_snapshots", "A11 D39", with_views("scored") + """
SELECT hour(timestamp_start)::BIGINT AS hour, round(avg(focus_score), 6) AS focus_avg, TIMESTAMP '2024-01-31 00:00:00' AS ts, TIMESTAMP '2024-01-01 00:00:00' AS start_time FROM scored GROUP BY 1""")
def analytics_snapshots(spark, sf):
    """The hourly focus report saved as snapshots and read back out of its payload."""
    path = _folder(spark, "snapshots")
    reports = insights.heatmap(src.intervals_flat(spark, sf)).withColumn("ts", src.as_of())
    sinks.save_snapshots(reports, path, F.lit("2024-01-01").cast("timestamp"), src.as_of())
    back = spark.read.parquet(path).withColumn("r", F.from_json("payload", "hour int, focus_avg double"))
    seen = src.intervals_flat(spark, sf).select(F.hour("timestamp_start").alias("hour")).distinct()
    return back.select("r.hour", "r.focus_avg", "ts", "start_time").join(seen, "hour", "left_semi")


@query("segments_with_position", "A20 G16", with_views("task_segments", "sess") + """
SELECT s.session_id, s.start_time AS session_start, t.segment_id, t.task_id, t.position FROM sess s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_time, segment_id) AS position FROM task_segments) t ON t.session_id = s.session_id
WHERE s.start_time >= TIMESTAMP '2024-01-10 00:00:00'""")
def segments_with_position(spark, sf):
    since = F.lit("2024-01-10").cast("timestamp")
    return scans.session_segments_flat(src.task_segments(spark, sf), src.sessions(spark, sf), since).select("session_id", "session_start", "segment_id", "task_id", "position")


MEASURED = """SELECT t.segment_id, avg(f.cpu_usage) AS cpu, avg(f.ram_usage) AS ram, coalesce(avg(f.gpu_usage), 0.0) AS gpu, avg(f.audio_volume) AS audio, sum(f.keyboard_intensity) + sum(f.mouse_clicks) AS input
FROM task_segments t JOIN {0} f ON f.session_id = t.session_id AND f.timestamp_start < t.end_time + INTERVAL {1} SECOND AND f.timestamp_end > t.start_time - INTERVAL {1} SECOND GROUP BY 1"""
PICKED = """SELECT a.segment_id, round(CASE WHEN dark THEN coalesce(b.cpu, a.cpu) ELSE a.cpu END, 6) AS avg_cpu, round(CASE WHEN dark THEN coalesce(b.ram, a.ram) ELSE a.ram END, 6) AS avg_ram, round(CASE WHEN dark THEN coalesce(b.gpu, a.gpu) ELSE a.gpu END, 6) AS avg_gpu,
  round(a.audio, 6) AS avg_audio, trunc(CASE WHEN dark THEN coalesce(b.input, a.input) ELSE a.input END + 1e-7)::BIGINT AS event_count FROM (SELECT *, cpu = 0 AND ram = 0 AND gpu = 0 AS dark FROM m1) a LEFT JOIN m2 b USING (segment_id)"""


def measured_sql(table: str) -> str:
    return f",\nm1 AS ({MEASURED.format(table, 0)}),\nm2 AS ({MEASURED.format(table, 120)})\n{PICKED}"


@query("segment_metrics", "A21", with_views("task_segments", "front") + measured_sql("front"))
def segment_metrics(spark, sf):
    return stored(spark, sf, "segment_metrics", lambda: scans.segment_metrics(src.task_segments(spark, sf), src.interval_signals(spark, sf)))


view("dark_front", ["front"], "SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE cpu_usage END AS cpu_usage, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE ram_usage END AS ram_usage, CASE WHEN event_id % 2 = 0 THEN NULL ELSE gpu_usage END AS gpu_usage) FROM front")


@query("dark_segment_metrics", "A21", with_views("task_segments", "dark_front") + measured_sql("dark_front"))
def dark_segment_metrics(spark, sf):
    """Half of the intervals without measured values, so that many segments are tried again in a wider span."""
    dark = F.col("event_id") % 2 == 0
    iv = lambda: src.interval_signals(spark, sf).withColumns({c: F.when(~dark, F.col(c)).otherwise(0.0 if c != "gpu_usage" else None) for c in ("cpu_usage", "ram_usage", "gpu_usage")})
    return stored(spark, sf, "dark_segment_metrics", lambda: scans.segment_metrics(src.task_segments(spark, sf), iv()))


@query("segment_contexts", "C06", with_views("task_segments", "front") + """,
p AS (SELECT t.segment_id, f.app, f.window_title, f.event_id % 3 <> 0 AS win, f.timestamp_start AS ts FROM task_segments t JOIN front f ON f.session_id = t.session_id AND f.timestamp_start BETWEEN t.start_time AND t.end_time),
a AS (SELECT segment_id, app, row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, min(ts)) AS r FROM p WHERE win GROUP BY 1, 2),
w AS (SELECT segment_id, window_title, row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, min(ts)) AS r FROM p WHERE win GROUP BY 1, 2)
SELECT g.segment_id, coalesce(a.app, 'unknown') AS app, coalesce(w.window_title, '') AS window_title, g.n AS input_count FROM (SELECT segment_id, count(CASE WHEN NOT win THEN 1 END) AS n FROM p GROUP BY 1) g
LEFT JOIN a ON a.segment_id = g.segment_id AND a.r = 1 LEFT JOIN w ON w.segment_id = g.segment_id AND w.r = 1""")
def segment_contexts(spark, sf):
    ev = src.interval_signals(spark, sf).filter("session_id is not null").select(
        "session_id", F.col("timestamp_start").alias("ts"), "event_id", (F.col("event_id") % 3 != 0).alias("is_window"), "app", F.col("window_title").alias("title"))
    return scans.segment_context(ev, src.task_segments(spark, sf))


GENERIC = """CASE WHEN first_task IN ('unknown', 'context_change') THEN coalesce(CASE WHEN contains(lower(task_id), 'administrative work') THEN 'administrative_work' WHEN contains(lower(task_id), 'deep development') THEN 'deep_development'
  WHEN contains(lower(task_id), 'technical research') THEN 'technical_research' WHEN contains(lower(task_id), 'context switching') THEN 'context_switching' WHEN contains(lower(task_id), 'team meeting') THEN 'team_meeting'
  WHEN contains(lower(task_id), 'strategic planning') THEN 'strategic_planning' END, first_task) ELSE first_task END"""
view("listed", ["task_segments"], f"""
SELECT *, {GENERIC} AS generic_task FROM (
  SELECT *, CASE WHEN is_json THEN app ELSE 'unknown' END AS seg_app, CASE WHEN is_json THEN {clean_sql('window_title')} ELSE '' END AS normalized_title,
    CASE WHEN end_time IS NULL THEN 0.0 ELSE minutes * 60 END AS duration_seconds,
    CASE WHEN NOT contains(reason, '_') THEN 'unknown' WHEN split_part(reason, '_', 1) IN ('initial', 'continuing', 'behavioral') THEN substr(reason, length(split_part(reason, '_', 1)) + 2)
      WHEN contains(split_part(reason, '_', 1), 'transition') THEN 'unknown' WHEN split_part(reason, '_', 1) IN ('window', 'app', 'context') THEN 'context_change' ELSE 'unknown' END AS first_task FROM task_segments) t
""")


@query("segment_listing", "A23 C07 H17 H37", with_views("listed", "sess") + """
SELECT l.segment_id, l.session_id, s.start_time AS session_start, s.end_time AS session_end, l.task_id, l.start_time, l.end_time, round(l.duration_seconds, 6) AS duration_seconds,
  l.seg_app AS app, l.normalized_title, l.generic_task, l.confidence FROM listed l LEFT JOIN sess s ON s.session_id = l.session_id WHERE l.duration_seconds >= 3600""")
def segment_listing(spark, sf):
    rows = scans.segment_listing(src.task_segments(spark, sf), src.sessions(spark, sf), min_seconds=3600)
    return rows.select("segment_id", "session_id", "session_start", "session_end", "task_id", "start_time", "end_time", "duration_seconds", "app", "normalized_title", "generic_task", "confidence")


@query("recent_segments", "A23 D57", with_views("listed") + """
SELECT segment_id, start_time, round(duration_seconds, 6) AS duration_seconds FROM (SELECT * FROM listed ORDER BY start_time DESC, segment_id DESC LIMIT 200) t WHERE duration_seconds >= 3600""")
def recent_segments(spark, sf):
    rows = scans.segment_listing(src.task_segments(spark, sf), src.sessions(spark, sf), min_seconds=3600, limit=200)
    return rows.select("segment_id", "start_time", "duration_seconds")


@query("segment_statistics", "D19", with_views("listed") + """,
x AS (SELECT * FROM listed WHERE duration_seconds >= 30)
SELECT 'all' AS kind, 'segments per session' AS value, count(*) AS segments, round(count(*) / count(DISTINCT session_id), 6) AS number FROM x
UNION ALL SELECT 'task', generic_task, count(*), round(sum(duration_seconds) / 60, 6) FROM x GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'app', seg_app, count(*), 0.0 FROM x GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) y""")
def segment_statistics(spark, sf):
    rows = scans.segment_listing(src.task_segments(spark, sf), src.sessions(spark, sf), min_seconds=30).select("session_id", "generic_task", "app", "duration_seconds")
    n = F.count(F.lit(1))
    whole = rows.groupBy("session_id").agg(n.alias("c")).agg(
        F.lit("all").alias("kind"), F.lit("segments per session").alias("value"), F.sum("c").alias("segments"), (F.sum("c") / F.count(F.lit(1))).alias("number"))
    tasks = rows.groupBy(F.lit("task").alias("kind"), F.col("generic_task").alias("value")).agg(n.alias("segments"), (F.sum("duration_seconds") / 60).alias("number"))
    apps = rows.groupBy(F.lit("app").alias("kind"), F.col("app").alias("value")).agg(n.alias("segments"), F.lit(0.0).alias("number")).orderBy(F.desc("segments"), "value").limit(10)
    return whole.unionByName(tasks).unionByName(apps)


@query("session_segment_summary", "D57 D54 D56", with_views("listed") + """
SELECT session_id, count(*) AS segments, round(sum(duration_seconds) / 60, 6) AS minutes, count(DISTINCT seg_app) AS unique_apps, count(DISTINCT generic_task) AS unique_tasks FROM listed GROUP BY 1""")
def session_segment_summary(spark, sf):
    rows = scans.segment_listing(src.task_segments(spark, sf), src.sessions(spark, sf))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("segments"), (F.sum("duration_seconds") / 60).alias("minutes"), F.countDistinct("app").alias("unique_apps"), F.countDistinct("generic_task").alias("unique_tasks"))


@query("session_task_summary", "D54 D60 G17", with_views("task_segments") + """,
x AS (SELECT *, lag(task_id) OVER (PARTITION BY session_id ORDER BY start_time, segment_id) AS prev FROM task_segments)
SELECT session_id, task_id, count(*) AS segments, round(sum(CASE WHEN end_time IS NULL THEN 0 ELSE minutes * 60 END), 6) AS seconds, max(confidence) AS max_confidence,
  count(CASE WHEN prev <> task_id AND confidence >= 0.6 THEN 1 END) AS transitions_into FROM x GROUP BY 1, 2""")
def session_task_summary(spark, sf):
    from worklens.functions.sequence import day_chunk, scan_rows

    rows = src.task_segments(spark, sf).select("session_id", "task_id", "segment_id", "start_time", "end_time", "confidence")
    seen = scan_rows(rows, ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"), lag={"prev": F.col("task_id")})
    moved = (F.col("prev") != F.col("task_id")) & (F.col("confidence") >= 0.6)
    return seen.groupBy("session_id", "task_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce(scoring.seconds_between("start_time", "end_time"), F.lit(0.0))).alias("seconds"),
        F.max("confidence").alias("max_confidence"), F.sum(F.when(moved, 1).otherwise(0)).alias("transitions_into"))


view("closed", ["task_segments"], f"""
SELECT segment_id, user_id, session_id, task_id, start_time, end_time, minutes * 60 AS duration_seconds, CASE WHEN is_json THEN app ELSE 'unknown' END AS app, CASE WHEN is_json THEN window_title ELSE '' END AS window_title,
  CASE WHEN is_json THEN {clean_sql('window_title')} ELSE '' END AS normalized_title, CASE WHEN split_part(reason, '_', 1) IN ('initial', 'continuing') AND contains(reason, '_')
  THEN substr(reason, length(split_part(reason, '_', 1)) + 2) ELSE 'unknown' END AS generic_task, confidence FROM task_segments WHERE end_time IS NOT NULL
""")


@query("closed_segments", "A31 H01 H17", with_views("closed") + "SELECT segment_id, round(duration_seconds, 6) AS duration_seconds, app, window_title, normalized_title, generic_task, confidence FROM closed")
def closed_segments(spark, sf):
    return scans.closed_segments(src.task_segments(spark, sf)).select("segment_id", "duration_seconds", "app", "window_title", "normalized_title", "generic_task", "confidence")


@query("session_fragmentation", "D18", with_views("closed") + """,
x AS (SELECT *, lag(app) OVER w AS pa, lag(normalized_title) OVER w AS pt, lag(generic_task) OVER w AS pg, row_number() OVER w AS rn FROM closed WINDOW w AS (PARTITION BY session_id ORDER BY start_time, segment_id))
SELECT session_id, count(*) AS total_segments, round(sum(duration_seconds) / 60, 6) AS total_minutes, round(sum(duration_seconds) / 60 / count(*), 6) AS avg_minutes, count(CASE WHEN pa <> app THEN 1 END) AS app_switches,
  count(CASE WHEN pt <> normalized_title THEN 1 END) AS window_switches, count(CASE WHEN pg <> generic_task THEN 1 END) AS task_switches, count(CASE WHEN rn > 1 AND duration_seconds < 120 THEN 1 END) AS short_segments,
  round(count(CASE WHEN rn > 1 AND duration_seconds < 120 THEN 1 END) / count(*), 6) AS short_segment_ratio, count(DISTINCT app) AS apps_used, count(DISTINCT generic_task) AS tasks_detected FROM x GROUP BY 1""")
def session_fragmentation(spark, sf):
    return scans.fragmentation(scans.closed_segments(src.task_segments(spark, sf)))


view("training", ["task_segments"], f"""
SELECT *, minutes * 60 AS duration_seconds, CASE WHEN is_json THEN app ELSE '' END AS t_app, CASE WHEN is_json THEN {clean_sql('window_title')} ELSE '' END AS normalized_title,
  CASE WHEN contains(reason, '_') AND split_part(reason, '_', 1) IN ('initial', 'continuing', 'transition') THEN substr(reason, length(split_part(reason, '_', 1)) + 2) ELSE task_id END AS category,
  CASE WHEN is_json THEN k / 10.0 ELSE 0.0 END AS input_rate, is_json AND k % 2 = 0 AS has_browser FROM task_segments WHERE confidence >= 0.5 AND end_time IS NOT NULL AND minutes * 60 >= 30
""")


@query("training_rows", "A24 A30 H37", with_views("training") + """
SELECT segment_id, round(duration_seconds, 6) AS duration_seconds, t_app AS app, normalized_title, category AS generic_task, task_id AS smart_name, confidence, round(input_rate, 6) AS input_rate, has_browser, 0.0::DOUBLE AS typing_ratio FROM training""")
def training_rows(spark, sf):
    return scans.training_rows(src.task_segments(spark, sf)).select(
        "segment_id", "duration_seconds", "app", "normalized_title", "generic_task", "smart_name", "confidence", "input_rate", "has_browser", "typing_ratio")


@query("training_stats", "D20", with_views("training") + """
SELECT category AS generic_task, count(*) AS segments, round(avg(duration_seconds), 6) AS avg_duration_seconds, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT nullif(t_app, '')) AS unique_apps FROM training GROUP BY 1""")
def training_stats(spark, sf):
    return scans.training_stats(scans.training_rows(src.task_segments(spark, sf)))


@query("session_export", "A29 D56", with_views("sess", "session_minutes") + """
SELECT s.session_id, s.start_time AS start, m.m AS end, round((epoch_us(m.m) - epoch_us(s.start_time)) / 1e6, 6) AS duration_seconds, round((epoch_us(m.m) - epoch_us(s.start_time)) / 6e7, 6) AS duration_minutes, device_id, keys % 2 = 0 AS in_progress
FROM sess s JOIN (SELECT session_id, max(minute) AS m FROM session_minutes GROUP BY 1) m ON m.session_id = s.session_id""")
def session_export(spark, sf):
    rows = src.sessions(spark, sf).withColumn("in_progress", F.col("keys") % 2 == 0)
    return scans.export_rows(rows, src.session_minutes(spark, sf), src.as_of())


@query("events_per_session", "D01", with_views("iv") + "SELECT coalesce(session_id, 'background') AS session_id, count(*) AS events FROM iv GROUP BY 1 ORDER BY 2 DESC")
def events_per_session(spark, sf):
    return src.interval_signals(spark, sf).groupBy(F.coalesce("session_id", F.lit("background")).alias("session_id")).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"))


@query("intensity_stats", "D02 D03 A17", with_views("front") + """
SELECT session_id, count(*) AS samples, round(avg(keyboard_intensity), 6) AS average, min(keyboard_intensity) AS lowest, max(keyboard_intensity) AS highest, max_by(keyboard_intensity, epoch_us(timestamp_start)) AS latest FROM front GROUP BY 1""")
def intensity_stats(spark, sf):
    v = "keyboard_intensity"
    return src.interval_signals(spark, sf).filter("session_id is not null").groupBy("session_id").agg(
        F.count(v).alias("samples"), F.avg(v).alias("average"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.max_by(v, F.struct("timestamp_start", "event_id")).alias("latest"))


@query("storage_stats", "D04", with_views("flat", "sess", "task_segments") + """
SELECT 'events' AS table, count(*) AS rows, min(ts) AS oldest, max(ts) AS newest FROM events UNION ALL SELECT 'interval_signals', count(*), min(timestamp_start), max(timestamp_start) FROM flat
UNION ALL SELECT 'sessions', count(*), min(start_time), max(start_time) FROM sess UNION ALL SELECT 'task_segments', count(*), min(start_time), max(start_time) FROM task_segments""")
def storage_stats(spark, sf):
    stat = lambda df, name, ts: df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))
    return (
        stat(src.events(spark, sf), "events", "ts").unionByName(stat(src.interval_signals(spark, sf), "interval_signals", "timestamp_start"))
        .unionByName(stat(src.sessions(spark, sf), "sessions", "start_time")).unionByName(stat(src.task_segments(spark, sf), "task_segments", "start_time")))


@query("retention_counts", "B01 B02 B03", with_views("flat", "task_segments") + f"""
SELECT 'intervals' AS table, count(CASE WHEN timestamp_start < {NOW} - INTERVAL 20 DAY THEN 1 END) AS deleted, count(CASE WHEN timestamp_start >= {NOW} - INTERVAL 20 DAY THEN 1 END) AS kept FROM flat
UNION ALL SELECT 'enriched_tasks', count(CASE WHEN coalesce(end_time, start_time) < {NOW} - INTERVAL 10 DAY THEN 1 END), count(CASE WHEN coalesce(end_time, start_time) >= {NOW} - INTERVAL 10 DAY THEN 1 END) FROM task_segments
UNION ALL SELECT 'live_predictions', count(CASE WHEN start_time < {NOW} - INTERVAL 7 DAY THEN 1 END), count(CASE WHEN start_time >= {NOW} - INTERVAL 7 DAY THEN 1 END) FROM task_segments""")
def retention_counts(spark, sf):
    now, seg = src.as_of(), src.task_segments(spark, sf)
    return (
        retention.retention_counts(src.intervals_flat(spark, sf), F.col("timestamp_start"), now, 20, "intervals")
        .unionByName(retention.retention_counts(seg, F.coalesce("end_time", "start_time"), now, 10, "enriched_tasks"))
        .unionByName(retention.retention_counts(seg, F.col("start_time"), now, retention.KEEP_DAYS["live_predictions"], "live_predictions")))


@query("stale_session_stats", "B04 S05", with_views("sess") + f""",
x AS (SELECT *, end_time < {NOW} - INTERVAL 15 DAY AND keys % 3 <> 0 AND clicks % 480 <> 0 AS gone, CASE WHEN clicks % 480 <> 0 THEN end_time END AS e FROM sess)
SELECT count(CASE WHEN gone THEN 1 END) AS deleted_count, count(CASE WHEN gone THEN 1 END) AS archived_count, count(CASE WHEN NOT gone THEN 1 END) AS kept_count,
  min(CASE WHEN NOT gone THEN e END) AS oldest_kept, max(CASE WHEN gone THEN e END) AS newest_deleted FROM x""")
def stale_session_stats(spark, sf):
    rows = src.sessions(spark, sf).withColumns({"in_progress": F.col("keys") % 3 == 0, "end_time": F.when(F.col("clicks") % 480 != 0, F.col("end_time"))})
    return retention.stale_session_stats(retention.stale_sessions(rows, src.as_of(), 15))


view("raw_sessions", ["sess"], """
SELECT session_id AS id, CASE WHEN keys % 11 = 0 THEN 'not a time' WHEN keys % 7 = 0 THEN strftime(end_time, '%Y-%m-%d %H:%M:%S') ELSE strftime(start_time, '%Y-%m-%d %H:%M:%S') END AS s,
  CASE WHEN keys % 13 = 0 THEN NULL WHEN keys % 7 = 0 THEN strftime(start_time, '%Y-%m-%d %H:%M:%S') ELSE strftime(end_time, '%Y-%m-%d %H:%M:%S') END AS e,
  CASE WHEN keys % 5 = 0 THEN '' ELSE device_id END AS device_id FROM sess
""")


def raw_sessions(spark, sf):
    """Sessions as text rows of the first schema, some of them broken."""
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    k = F.col("keys")
    return src.sessions(spark, sf).select(
        F.col("session_id").alias("id"), F.when(k % 11 == 0, "not a time").when(k % 7 == 0, t("end_time")).otherwise(t("start_time")).alias("start"),
        F.when(k % 13 == 0, None).when(k % 7 == 0, t("start_time")).otherwise(t("end_time")).alias("end"), F.when(k % 5 == 0, "").otherwise(F.col("device_id")).alias("device_id"),
        "apps", F.col("total_events").alias("event_count"), k.alias("input_events"), F.lit(None).cast("string").alias("timeline"), F.lit(None).cast("string").alias("intent_breakdown"))


view("validated", ["raw_sessions"], """
SELECT *, CASE WHEN s IS NULL OR e IS NULL OR device_id = '' THEN 'missing fields' WHEN a IS NULL OR b IS NULL THEN 'invalid datetime' WHEN a > b THEN 'start > end' END AS error
FROM (SELECT *, try_cast(s AS TIMESTAMP) AS a, try_cast(e AS TIMESTAMP) AS b FROM raw_sessions) t
""")


@query("validated_sessions", "L01", with_views("validated") + """
SELECT id, error IS NULL AS valid, error, CASE WHEN error IS NULL AND epoch(b) - epoch(a) > 86400 THEN 'unusually long' END AS warning FROM validated""")
def validated_sessions(spark, sf):
    return retention.validate_sessions(raw_sessions(spark, sf)).select("id", "valid", "error", "warning")


view("repaired", ["validated"], """
SELECT id, CASE WHEN device_id = '' THEN 'unknown' ELSE device_id END AS device_id, least(a, b) AS start_time, greatest(a, b) AS end_time, a IS NULL OR b IS NULL AS removed,
  (device_id = '')::BIGINT + CASE WHEN a > b THEN 1 ELSE 0 END AS repairs, error FROM validated
""")


@query("repaired_sessions", "L02", with_views("repaired") + "SELECT id, device_id, start_time, end_time, repairs FROM repaired WHERE NOT removed")
def repaired_sessions(spark, sf):
    return retention.repair_sessions(raw_sessions(spark, sf)).filter(~F.col("removed")).drop("removed")


@query("migrated_sessions", "L03", with_views("raw_sessions") + """
SELECT id, s AS start, e AS end, device_id, '2.0' AS schema_version FROM raw_sessions""")
def migrated_sessions(spark, sf):
    raw = raw_sessions(spark, sf)
    new = raw.filter("length(id) % 2 = 1").select("id", "start", "end", "device_id").withColumn("schema_version", F.lit("2.0"))
    return retention.read_compatible(raw.filter("length(id) % 2 = 0"), new)


@query("maintenance_run", "L04", with_views("repaired") + f"""
SELECT CASE WHEN end_time < {NOW} - INTERVAL 15 DAY THEN 'archive' ELSE 'keep' END AS action, error IS NULL AS valid, count(*) AS sessions, sum(repairs)::BIGINT AS repairs FROM repaired WHERE NOT removed GROUP BY 1, 2""")
def maintenance_run(spark, sf):
    done = retention.maintain(raw_sessions(spark, sf), src.as_of(), 15)
    return done.groupBy("action", "valid").agg(F.count(F.lit(1)).alias("sessions"), F.sum("repairs").alias("repairs"))


@query("mouse_moves_kept", "B15", with_views("raw_inputs") + "SELECT event_id, round(amount, 6) AS amount FROM raw_inputs WHERE kind = 'move' AND amount > 50")
def mouse_moves_kept(spark, sf):
    return src.raw_inputs(spark, sf).filter((F.col("kind") == "move") & (F.col("amount") > 50)).select("event_id", "amount")


# ---- changes of tables kept by date --------------------------------------------------------------------

def dated_sessions(spark, sf, name):
    path = _folder(spark, name)
    dated.create(src.sessions(spark, sf).select("session_id", "user_id", "keys", "start_time", "end_time", F.col("end_time").alias("updated_at")), path, "start_time")
    return path


def dated_segments(spark, sf, name):
    path = _folder(spark, name)
    dated.create(src.task_segments(spark, sf).select("segment_id", "session_id", "task_id", "start_time", "end_time"), path, "start_time")
    return path


@query("sessions_upserted_by_date", "A18", with_views("sess") + """
SELECT session_id, CAST(start_time AS DATE)::VARCHAR AS date, CASE WHEN user_id % 5 = 0 AND start_time >= TIMESTAMP '2024-01-20' THEN keys + 1000 ELSE keys END AS keys,
  CASE WHEN user_id % 5 = 0 AND start_time >= TIMESTAMP '2024-01-20' THEN end_time + INTERVAL 1 HOUR ELSE end_time END AS updated_at FROM sess""")
def sessions_upserted_by_date(spark, sf):
    path = dated_sessions(spark, sf, "sessions")
    some = src.sessions(spark, sf).filter("user_id % 5 = 0 AND start_time >= TIMESTAMP '2024-01-20'")
    changes = some.select("session_id", "user_id", (F.col("keys") + 1000).alias("keys"), "start_time", "end_time", (F.col("end_time") + F.expr("interval 1 hour")).alias("updated_at"))
    dated.upsert(spark, path, changes, ["session_id"], ["updated_at"], "start_time")
    return dated.read(spark, path).select("session_id", F.col("date").cast("string").alias("date"), "keys", "updated_at")


@query("segments_replaced_by_date", "A19", with_views("task_segments") + """
SELECT segment_id, session_id, CASE WHEN hash THEN 'new' ELSE task_id END AS task_id, CAST(start_time AS DATE)::VARCHAR AS date FROM (SELECT *, user_id % 3 = 0 AS hash FROM task_segments) x WHERE NOT hash OR segment_id % 4 <> 0""")
def segments_replaced_by_date(spark, sf):
    path = dated_segments(spark, sf, "segments")
    some = src.task_segments(spark, sf).filter("user_id % 3 = 0").withColumn("task_id", F.when(F.col("segment_id") % 4 != 0, "new"))
    dated.replace(spark, path, some.select("segment_id", "session_id", "task_id", "start_time", "end_time"), ["session_id"], ["task_id"], "start_time")
    return dated.read(spark, path).select("segment_id", "session_id", "task_id", F.col("date").cast("string").alias("date"))


@query("sessions_deleted_by_date", "A22", with_views("sess", "task_segments") + """
SELECT 'sessions' AS table, CAST(start_time AS DATE)::VARCHAR AS date, count(*) AS rows FROM sess WHERE keys % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'segments', CAST(start_time AS DATE)::VARCHAR, count(*) FROM task_segments WHERE session_id IN (SELECT session_id FROM sess WHERE keys % 7 <> 0) GROUP BY ALL""")
def sessions_deleted_by_date(spark, sf):
    gone = src.sessions(spark, sf).filter("keys % 7 = 0")
    out = []
    for name, path in (("sessions", dated_sessions(spark, sf, "gone-sessions")), ("segments", dated_segments(spark, sf, "gone-segments"))):
        dated.delete(spark, path, gone, ["session_id"])
        out.append(dated.read(spark, path).groupBy(F.lit(name).alias("table"), F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("rows")))
    return out[0].unionByName(out[1])


@query("retained_dates", "B01 B02 B03", with_views("flat", "task_segments") + f"""
SELECT 'intervals' AS table, CAST(timestamp_start AS DATE)::VARCHAR AS date, count(*) AS rows FROM flat WHERE timestamp_start >= {NOW} - INTERVAL 20 DAY GROUP BY ALL
UNION ALL SELECT 'enriched_tasks', CAST(e AS DATE)::VARCHAR, count(*) FROM (SELECT coalesce(end_time, start_time) AS e FROM task_segments) x WHERE e >= {NOW} - INTERVAL 10 DAY GROUP BY ALL
UNION ALL SELECT 'live_predictions', CAST(start_time AS DATE)::VARCHAR, count(*) FROM task_segments WHERE start_time >= {NOW} - INTERVAL 7 DAY GROUP BY ALL""")
def retained_dates(spark, sf):
    segments = src.task_segments(spark, sf).select("segment_id", "start_time", F.coalesce("end_time", "start_time").alias("closed"))
    tables = {"intervals": (src.intervals_flat(spark, sf).select("event_id", "timestamp_start"), "timestamp_start", 20), "enriched_tasks": (segments, "closed", 10),
              "live_predictions": (segments, "start_time", retention.KEEP_DAYS["live_predictions"])}
    out = None
    for name, (rows, ts, days) in tables.items():
        path = _folder(spark, name)
        dated.create(rows, path, ts)
        dated.expire(spark, path, ts, datetime.datetime.fromisoformat(src.AS_OF), days)
        kept = dated.read(spark, path).groupBy(F.lit(name).alias("table"), F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("rows"))
        out = kept if out is None else out.unionByName(kept)
    return out
