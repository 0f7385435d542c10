"""Baselines, estimates and risks."""

from pyspark.sql import functions as F

from worklens.operators import baselines, daily, predict
from worklens.plans import daily_queries  # noqa: F401  (defines the session views)
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.session import stored
from worklens.sources import tables as src

KEYS = ["user_id", "task_id"]


def classed(spark, sf):
    return daily.with_class(src.sessions(spark, sf))


def task_base(spark, sf):
    return stored(spark, sf, "task_baselines", lambda: baselines.task_baselines(classed(spark, sf), KEYS))


def hour_base(spark, sf):
    return stored(spark, sf, "hour_baselines", lambda: baselines.hour_baselines(classed(spark, sf)))


def pct(col: str, p: int) -> str:
    return f"list_sort(list({col}))[least(CAST(floor(count(*) * {p / 100.0}) AS BIGINT), count(*) - 1) + 1]"


view("task_base", ["sess_class"], f"""
SELECT user_id, task_id, count(*) AS session_count, round_even(avg(s_minutes), 2) AS duration_mean_minutes, round_even(coalesce(stddev_samp(s_minutes), 0.0), 2) AS duration_std_minutes,
  round_even(avg(input_per_minute), 2) AS input_intensity_mean, round_even(avg(entropy), 3) AS entropy_mean, round_even(avg(focus_continuity), 3) AS continuity_mean,
  min(start_time) AS first_seen, max(start_time) AS last_updated, round_even({pct('input_per_minute', 50)}, 2) AS intensity_p50, round_even({pct('input_per_minute', 90)}, 2) AS intensity_p90
FROM sess_class GROUP BY 1, 2
""")
view("hour_base", ["sess_class"], """
SELECT a.*, class AS dominant_classification FROM (SELECT hour(start_time)::BIGINT AS hour, count(*) AS session_count, round_even(avg(s_minutes), 2) AS avg_duration_minutes,
    round_even(coalesce(stddev_samp(s_minutes), 0.0), 2) AS duration_std_minutes, round_even(avg(input_per_minute), 2) AS avg_input_intensity,
    round_even(avg(focus_continuity), 3) AS avg_focus_continuity FROM sess_class GROUP BY 1) a
JOIN (SELECT hour(start_time) AS hour, class, row_number() OVER (PARTITION BY hour(start_time) ORDER BY count(*) DESC, min(start_time)) AS r FROM sess_class GROUP BY 1, 2) b
  ON a.hour = b.hour AND r = 1
""")
view("task_ok", ["task_base"], "SELECT * FROM task_base WHERE session_count >= 3")
view("hour_ok", ["hour_base"], "SELECT * FROM hour_base WHERE session_count >= 2")
view("typical", ["sess_class"], """
SELECT * FROM (SELECT user_id, task_id, app, count(*) AS sessions, row_number() OVER (PARTITION BY user_id, task_id ORDER BY count(*) DESC, app) AS rank
  FROM (SELECT user_id, task_id, unnest(apps) AS app FROM sess_class) x GROUP BY 1, 2, 3) y WHERE rank <= 3
""")


@query("task_baselines", "D41 D44 J22", with_views("task_base") + "SELECT * FROM task_base")
def task_baselines(spark, sf):
    return task_base(spark, sf)


@query("hour_baselines", "D42 D46", with_views("hour_base") + "SELECT * FROM hour_base")
def hour_baselines(spark, sf):
    return hour_base(spark, sf)


@query("session_quality", "D43 D44", with_views("sess_class") + f"""
SELECT count(*) AS total_sessions, round_even(avg(s_minutes), 2) AS duration_mean_minutes, round_even(stddev_samp(s_minutes), 2) AS duration_std_minutes,
  round_even(avg(input_per_minute), 2) AS avg_input_intensity, round_even(avg(entropy), 3) AS avg_entropy, round_even(avg(focus_continuity), 3) AS avg_continuity,
  count(CASE WHEN class = 'focused' THEN 1 END) AS focused_sessions, count(CASE WHEN class = 'passive' THEN 1 END) AS passive_sessions,
  count(CASE WHEN class = 'mixed' THEN 1 END) AS mixed_sessions, count(CASE WHEN class = 'idle-heavy' THEN 1 END) AS idle_heavy_sessions,
  round_even({pct('s_minutes', 25)}, 2) AS p25, round_even({pct('s_minutes', 50)}, 2) AS p50, round_even({pct('s_minutes', 75)}, 2) AS p75, round_even({pct('s_minutes', 95)}, 2) AS p95
FROM sess_class""")
def session_quality(spark, sf):
    return baselines.quality_distribution(classed(spark, sf))


@query("typical_apps", "D45 F05", with_views("typical") + "SELECT * FROM typical")
def typical_apps(spark, sf):
    return baselines.typical_apps(classed(spark, sf), KEYS)


@query("best_focus_hours", "D46 H34", with_views("hour_base") + """
SELECT hour, session_count, avg_focus_continuity, CASE WHEN avg_focus_continuity > 0.7 THEN 'high' WHEN avg_focus_continuity > 0.5 THEN 'medium' ELSE 'low' END AS productivity_level
FROM hour_base ORDER BY avg_focus_continuity DESC, hour LIMIT 3""")
def best_focus_hours(spark, sf):
    top = baselines.best_hours(hour_base(spark, sf))
    return top.select("hour", "session_count", "avg_focus_continuity", baselines.productivity_level(F.col("avg_focus_continuity")).alias("productivity_level"))


@query("session_breakdown", "D40", with_views("sess_class") + """
SELECT 'hour' AS kind, hour(start_time)::VARCHAR AS value, count(*) AS sessions, round(avg(s_minutes), 6) AS avg_minutes FROM sess_class GROUP BY 1, 2
UNION ALL SELECT 'device', device_id, count(*), round(avg(s_minutes), 6) FROM sess_class GROUP BY 1, 2
UNION ALL SELECT 'date', day::VARCHAR, count(*), round(avg(s_minutes), 6) FROM sess_class GROUP BY 1, 2
UNION ALL SELECT 'all', 'all', count(*), round(avg(s_minutes), 6) FROM sess_class""")
def session_breakdown(spark, sf):
    return baselines.session_breakdown(classed(spark, sf))


def running(spark, sf):
    """Every session, seen half way through."""
    return classed(spark, sf).select(
        *KEYS, "session_id", (F.col("minutes") / 2).alias("elapsed_minutes"), F.hour("start_time").alias("hour"), src.as_of().alias("now"))


view("estimates", ["sess_class", "task_ok", "hour_ok"], """
SELECT user_id, task_id, session_id, elapsed, hour, n, f AS time_factor, greatest(0.0, duration_mean_minutes * f - elapsed) AS minutes_remaining,
  least(n / 10.0, 1.0) * (1.0 / (1.0 + duration_std_minutes / greatest(duration_mean_minutes, 1.0))) AS confidence, start_time FROM (
  SELECT s.user_id, s.task_id, s.session_id, s.s_minutes / 2 AS elapsed, hour(s.start_time)::BIGINT AS hour, t.session_count AS n, t.duration_mean_minutes, t.duration_std_minutes, s.start_time,
    CASE WHEN h.avg_focus_continuity IS NOT NULL AND t.continuity_mean > 0 THEN t.continuity_mean / greatest(h.avg_focus_continuity, 0.1) ELSE 1.0 END AS f
  FROM sess_class s JOIN task_ok t ON t.user_id = s.user_id AND t.task_id = s.task_id LEFT JOIN hour_ok h ON h.hour = hour(s.start_time)) x
""")


@query("completion_estimates", "J15 C16 J24", with_views("estimates") + """
SELECT session_id, round(elapsed, 6) AS elapsed_minutes, round(time_factor, 6) AS time_factor, round(minutes_remaining, 6) AS minutes_remaining, round(confidence, 6) AS confidence,
  'Based on ' || n::VARCHAR || ' historical sessions' || CASE WHEN time_factor <> 1.0 THEN ', adjusted for time-of-day productivity' ELSE '' END AS reason FROM estimates""")
def completion_estimates(spark, sf):
    return predict.completion_estimates(running(spark, sf), task_base(spark, sf), hour_base(spark, sf), KEYS).select(
        "session_id", "elapsed_minutes", "time_factor", "minutes_remaining", "confidence", "reason")


@query("estimates_at_assignment", "J24", with_views("estimates") + """
SELECT session_id, round(minutes_remaining + CASE WHEN minutes_remaining > 0 THEN elapsed ELSE 0 END, 6) AS minutes_remaining FROM (
  SELECT e.session_id, greatest(0.0, t.duration_mean_minutes * e.time_factor) AS minutes_remaining, 0.0 AS elapsed FROM estimates e JOIN task_ok t USING (user_id, task_id)) x""")
def estimates_at_assignment(spark, sf):
    fresh = running(spark, sf).withColumn("elapsed_minutes", F.lit(0.0))
    return predict.completion_estimates(fresh, task_base(spark, sf), hour_base(spark, sf), KEYS).select("session_id", "minutes_remaining")


@query("daily_workload", "J16", with_views("sess_class", "task_ok") + """
SELECT user_id, round(coalesce(sum(duration_mean_minutes), 0.0), 6) AS total_minutes, count(session_count) AS estimated_tasks, count(*) - count(session_count) AS insufficient_tasks,
  coalesce(sum(duration_mean_minutes), 0.0) <= 384 AS feasible, round(coalesce(sum(duration_mean_minutes), 0.0) / 384, 6) AS utilization
FROM (SELECT DISTINCT user_id, task_id FROM sess_class) p LEFT JOIN task_ok USING (user_id, task_id) GROUP BY 1""")
def daily_workload(spark, sf):
    planned = src.sessions(spark, sf).select(*KEYS).distinct()
    return predict.daily_workload(planned, task_base(spark, sf), KEYS, ["user_id"])


view("risks", ["sess_class", "task_ok", "typical"], """
SELECT user_id, task_id, session_id, start_time, unnest(list_filter([
  CASE WHEN z > 2 THEN {'risk_level': CASE WHEN z < 3 THEN 'medium' ELSE 'high' END, 'category': 'anomaly',
    'message': 'Task duration ' || CASE WHEN s_minutes > duration_mean_minutes THEN 'longer' ELSE 'shorter' END || ' than usual', 'evidence': z} END,
  CASE WHEN continuity_mean > 0 AND focus_continuity < continuity_mean * 0.7 THEN {'risk_level': 'medium', 'category': 'degradation', 'message': 'Focus continuity degraded',
    'evidence': (1.0 - focus_continuity / continuity_mean) * 100.0} END,
  CASE WHEN overlap < 0.3 THEN {'risk_level': 'low', 'category': 'anomaly', 'message': 'Using unusual apps for this task', 'evidence': overlap} END], lambda r: r IS NOT NULL)) AS r
FROM (SELECT s.*, t.duration_mean_minutes, t.continuity_mean, CASE WHEN duration_std_minutes > 0 AND s_minutes > 0 THEN abs(s_minutes - duration_mean_minutes) / duration_std_minutes END AS z,
    len(list_intersect(apps, tops))::DOUBLE / greatest(len(apps), 1) AS overlap
  FROM sess_class s JOIN task_ok t USING (user_id, task_id) LEFT JOIN (SELECT user_id, task_id, list(app) AS tops FROM typical GROUP BY 1, 2) y USING (user_id, task_id)) x
""")


def risk_rows(spark, sf):
    rows = classed(spark, sf)
    typical = baselines.typical_apps(rows, KEYS).groupBy(*KEYS).agg(F.collect_list("app").alias("typical_apps"))  # three apps per task
    return predict.task_risks(rows, task_base(spark, sf), typical, KEYS)


@query("task_risks", "J17 S02", with_views("risks") + """
SELECT user_id, task_id, session_id, r.risk_level AS risk_level, r.category AS category, r.message AS message, round(r.evidence, 6) AS evidence FROM risks""")
def task_risks(spark, sf):
    return risk_rows(spark, sf)


@query("schedule_risks", "J18", with_views("sess_class", "hour_ok") + """
SELECT session_id, h.hour, 'low' AS risk_level, 'schedule' AS category, 'Hour ' || h.hour::VARCHAR || ' historically has low focus' AS message, h.avg_focus_continuity AS evidence
FROM sess_class s JOIN hour_ok h ON h.hour = hour(s.start_time) WHERE h.avg_focus_continuity < 0.54""")
def schedule_risks(spark, sf):
    return predict.schedule_risks(running(spark, sf), hour_base(spark, sf), low_focus=0.54)


view("stuck", ["task_events"], """
SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_activity)) / 3.6e9 AS hours_since FROM (
  SELECT user_id, task_id, max(ts) AS last_activity, max_by(state, epoch_us(ts)) AS state FROM task_events GROUP BY 1, 2) t
WHERE state = 'ACTIVE' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_activity) > 86400000000
""")


@query("stuck_tasks", "J19", with_views("stuck") + """
SELECT user_id, task_id, last_activity, state, round(hours_since, 6) AS hours_since, CASE WHEN hours_since < 48 THEN 'medium' ELSE 'high' END AS severity, 'stuck_task' AS type FROM stuck""")
def stuck_tasks(spark, sf):
    return predict.stuck_tasks(src.task_events(spark, sf), KEYS, src.as_of())


view("systemic", ["sess_class", "hour_ok"], """
SELECT h.hour, r.n AS recent_sessions, r.c AS recent_continuity, h.avg_focus_continuity AS baseline_continuity FROM (
  SELECT hour(start_time) AS hour, count(*) AS n, avg(focus_continuity) AS c FROM sess_class WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND n_apps > 1 GROUP BY 1) r
JOIN hour_ok h ON h.hour = r.hour WHERE r.n >= 3 AND r.c < h.avg_focus_continuity * 0.7
""")


@query("systemic_bottlenecks", "J20 D61", with_views("systemic", "stuck") + """
SELECT 'systemic_time' AS type, count(*) AS bottlenecks FROM systemic HAVING count(*) > 0 UNION ALL SELECT 'stuck_task', count(*) FROM stuck HAVING count(*) > 0""")
def systemic_bottlenecks(spark, sf):
    recent = classed(spark, sf).filter((F.col("start_time") >= F.lit("2024-01-24").cast("timestamp")) & (F.col("n_apps") > 1)).withColumn("hour", F.hour("start_time"))
    found = predict.systemic_bottlenecks(recent, hour_base(spark, sf)).select("type")
    stuck = predict.stuck_tasks(src.task_events(spark, sf), KEYS, src.as_of()).select("type")
    return found.unionByName(stuck).groupBy("type").agg(F.count(F.lit(1)).alias("bottlenecks"))


@query("recent_hour_dips", "J20", with_views("sess_class", "hour_ok") + """
SELECT r.user_id, h.hour, r.n AS recent_sessions, round(r.c, 6) AS recent_continuity, h.avg_focus_continuity AS baseline_continuity FROM (
  SELECT user_id, hour(start_time) AS hour, count(*) AS n, avg(focus_continuity) AS c FROM sess_class GROUP BY 1, 2) r
JOIN hour_ok h ON h.hour = r.hour WHERE r.n >= 3 AND r.c < h.avg_focus_continuity * 0.9""")
def recent_hour_dips(spark, sf):
    by_hour = classed(spark, sf).groupBy("user_id", F.hour("start_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("recent_sessions"), F.avg("focus_continuity").alias("recent_continuity"))
    hours = F.broadcast(hour_base(spark, sf).filter("session_count >= 2").select("hour", F.col("avg_focus_continuity").alias("baseline_continuity")))
    return by_hour.filter("recent_sessions >= 3").join(hours, "hour").filter(F.col("recent_continuity") < F.col("baseline_continuity") * 0.9)


@query("alerts", "J21", with_views("risks", "hour_ok", "stuck") + """
SELECT 'risk' AS type, r.risk_level AS level, session_id AS subject, r.message AS message FROM risks WHERE r.risk_level = 'high'
UNION ALL SELECT 'schedule', 'low', session_id, 'Hour ' || h.hour::VARCHAR || ' historically has low focus' FROM sess_class s JOIN hour_ok h ON h.hour = hour(s.start_time) WHERE h.avg_focus_continuity < 0.54
UNION ALL SELECT 'bottleneck', CASE WHEN hours_since < 48 THEN 'medium' ELSE 'high' END, 'stuck-' || user_id::VARCHAR || '-' || task_id, 'No recent activity' FROM stuck""")
def alerts(spark, sf):
    return predict.alerts(
        risk_rows(spark, sf), predict.schedule_risks(running(spark, sf), hour_base(spark, sf), low_focus=0.54),
        predict.stuck_tasks(src.task_events(spark, sf), KEYS, src.as_of()))


@query("prediction_history", "J25 J21", with_views("estimates") + """
SELECT * FROM (SELECT user_id, task_id, session_id, round(minutes_remaining, 6) AS minutes_remaining, row_number() OVER (PARTITION BY user_id, task_id ORDER BY start_time DESC) AS age_rank FROM estimates) t WHERE age_rank <= 30""")
def prediction_history(spark, sf):
    made = predict.completion_estimates(
        running(spark, sf).join(src.sessions(spark, sf).select("session_id", "start_time"), "session_id"), task_base(spark, sf), hour_base(spark, sf), KEYS)
    return predict.last_per_key(made, KEYS, ["start_time"], 30).select(*KEYS, "session_id", "minutes_remaining", "age_rank")


@query("risk_history", "J25 J17", with_views("risks") + """
SELECT user_id, task_id, session_id, r.risk_level AS risk_level, r.category AS category, r.message AS message, age_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, task_id ORDER BY start_time DESC, r.message DESC) AS age_rank FROM risks) t WHERE age_rank <= 50""")
def risk_history(spark, sf):
    """The newest 50 risk signals of each task (the report's own limit)."""
    rows = risk_rows(spark, sf).join(src.sessions(spark, sf).select("session_id", "start_time"), "session_id")
    return predict.last_per_key(rows, KEYS, ["start_time", "message"], 50).select(*KEYS, "session_id", "risk_level", "category", "message", "age_rank")


@query("task_lifecycle", "J22", with_views("task_base") + """
SELECT user_id, task_id, session_count AS total_sessions, duration_mean_minutes AS avg_session_minutes, round(duration_mean_minutes * session_count, 6) AS total_minutes,
  1.0::DOUBLE AS completion_rate, continuity_mean AS focus_continuity FROM task_base""")
def task_lifecycle(spark, sf):
    return task_base(spark, sf).select(
        *KEYS, F.col("session_count").alias("total_sessions"), F.col("duration_mean_minutes").alias("avg_session_minutes"),
        (F.col("duration_mean_minutes") * F.col("session_count")).alias("total_minutes"), F.lit(1.0).alias("completion_rate"), F.col("continuity_mean").alias("focus_continuity"))
