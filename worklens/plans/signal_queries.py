"""Metric graphs, input windows, vectors and live predictions."""

import uuid

from pyspark.sql import functions as F

from worklens.operators import daily, metrics, signals, vectors
from worklens.plans import daily_queries  # noqa: F401  (defines the session views)
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.session import shared_folder
from worklens.sources import sinks
from worklens.sources import tables as src

FOCUS = metrics.Metric("focus", "keyboard_intensity")
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
FLAT = with_views("flat")


@query("metric_daily_series", "D48 D47", FLAT + """
SELECT user_id, CAST(timestamp_start AS DATE)::VARCHAR AS day, round(avg(keyboard_intensity), 6) AS value FROM flat
WHERE timestamp_start >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp_start < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1, 2""")
def metric_daily_series(spark, sf):
    lo, hi = (F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-01-25"))
    return metrics.daily_series(src.intervals_flat(spark, sf), FOCUS, "timestamp_start", lo, hi, ["user_id"])


@query("metric_window_values", "D47", FLAT + """
SELECT 'mean' AS kind, round(avg(keyboard_intensity), 6) AS value FROM flat WHERE timestamp_start >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp_start < TIMESTAMP '2024-01-31 00:00:00'
UNION ALL SELECT 'sum', round(sum(mouse_clicks), 6) FROM flat WHERE timestamp_start >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp_start < TIMESTAMP '2024-01-31 00:00:00'
UNION ALL SELECT 'count', count(gpu_usage) FROM flat WHERE timestamp_start >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp_start < TIMESTAMP '2024-01-31 00:00:00'""")
def metric_window_values(spark, sf):
    iv = src.intervals_flat(spark, sf)
    lo, hi = F.lit("2024-01-24").cast("timestamp"), F.lit("2024-01-31").cast("timestamp")
    out = None
    for m in (FOCUS, metrics.Metric("clicks", "mouse_clicks", "sum"), metrics.Metric("gpu", "gpu_usage", "count")):
        one = metrics.window_value(iv, m, "timestamp_start", lo, hi).select(F.lit(m.aggregation).alias("kind"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("metric_moving_average", "G26", FLAT + """,
d AS (SELECT user_id, CAST(timestamp_start AS DATE) AS day, avg(keyboard_intensity) AS value FROM flat GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, round(avg(coalesce(value, 0.0)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value FROM d""")
def metric_moving_average(spark, sf):
    lo, hi = F.lit("2000-01-01").cast("timestamp"), src.as_of()
    points = metrics.daily_series(src.intervals_flat(spark, sf), FOCUS, "timestamp_start", lo, hi, ["user_id"])
    return metrics.moving_average(points, ["user_id"], "day", 5)


@query("order_moving_average", "G26 D48", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT day::VARCHAR AS day, round(avg(value) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS value FROM d""")
def order_moving_average(spark, sf):
    orders = spark.read.schema("o_orderdate timestamp, o_totalprice double").parquet(f"{sf}/orders.parquet")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value")).withColumn("all", F.lit(0))
    return metrics.moving_average(days, ["all"], "day", 7).select("day", F.round("value", 4).alias("value"))


@query("metric_against_previous", "G27", FLAT + f""",
b AS (SELECT user_id, avg(CASE WHEN timestamp_start >= {NOW} - INTERVAL 7 DAY THEN keyboard_intensity END) AS c, avg(CASE WHEN timestamp_start < {NOW} - INTERVAL 7 DAY THEN keyboard_intensity END) AS p
  FROM flat WHERE timestamp_start >= {NOW} - INTERVAL 14 DAY AND timestamp_start < {NOW} GROUP BY 1)
SELECT user_id, round(c, 6) AS current, round(p, 6) AS baseline, round_even(CASE WHEN p <> 0 THEN (c - p) / abs(p) * 100 END, 2) AS delta_percent,
  CASE WHEN c > p THEN 'increase' WHEN c < p THEN 'decrease' ELSE 'no_change' END AS significance FROM b""")
def metric_against_previous(spark, sf):
    return metrics.against_previous(src.intervals_flat(spark, sf), FOCUS, "timestamp_start", src.as_of(), 7, ["user_id"])


@query("metric_against_long_term", "G28", FLAT + f""",
d AS (SELECT user_id, CAST(timestamp_start AS DATE) AS day, avg(keyboard_intensity) AS v FROM flat WHERE timestamp_start < {NOW} - INTERVAL 7 DAY AND timestamp_start >= {NOW} - INTERVAL 97 DAY GROUP BY 1, 2),
l AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s FROM d GROUP BY 1),
c AS (SELECT user_id, avg(keyboard_intensity) AS v FROM flat WHERE timestamp_start >= {NOW} - INTERVAL 7 DAY AND timestamp_start < {NOW} GROUP BY 1)
SELECT coalesce(c.user_id, l.user_id) AS user_id, round(v, 6) AS current, round(m, 6) AS long_mean, round(s, 6) AS long_std, round_even(CASE WHEN s <> 0 THEN (v - m) / s END, 3) AS z_score FROM c FULL JOIN l ON l.user_id = c.user_id""")
def metric_against_long_term(spark, sf):
    return metrics.against_long_term(src.intervals_flat(spark, sf), FOCUS, "timestamp_start", src.as_of(), 7, ["user_id"])


@query("centred_averages", "G29", FLAT + """,
d AS (SELECT user_id, CAST(timestamp_start AS DATE) AS day, avg(keyboard_intensity) AS v FROM flat GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0, 6) AS short,
  round(sum(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30.0, 6) AS long FROM d""")
def centred_averages(spark, sf):
    points = metrics.daily_series(src.intervals_flat(spark, sf), FOCUS, "timestamp_start", F.lit("2000-01-01").cast("timestamp"), src.as_of(), ["user_id"])
    short = metrics.centred_average(points, ["user_id"], "day", 5, "value", "short")
    return metrics.centred_average(short, ["user_id"], "day", 30, "value", "long").select("user_id", "day", "short", "long")


@query("peak_session_hours", "D49", with_views("sess_class") + """
SELECT hour(start_time)::BIGINT AS hour, round(sum(s_minutes), 4) AS minutes FROM sess_class GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def peak_session_hours(spark, sf):
    rows = daily.with_class(src.sessions(spark, sf))
    return rows.groupBy(F.hour("start_time").alias("hour")).agg(F.round(F.sum("minutes"), 4).alias("minutes")).orderBy(F.desc("minutes")).limit(3)


@query("longest_sessions", "D49 F05", with_views("sess_class") + "SELECT session_id, round(s_minutes, 6) AS minutes FROM sess_class ORDER BY s_minutes DESC, session_id LIMIT 3")
def longest_sessions(spark, sf):
    return daily.with_class(src.sessions(spark, sf)).orderBy(F.desc("minutes"), "session_id").limit(3).select("session_id", "minutes")


view("hour_inputs", ["raw_inputs"], """
SELECT user_id, date_trunc('hour', ts) AS w, count(CASE WHEN kind = 'key' THEN 1 END) / 60.0 AS kb, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0) AS dist,
  max_by(app, epoch_us(ts)) AS app, max_by(window_title, epoch_us(ts)) AS title FROM raw_inputs GROUP BY 1, 2
""")


@query("tumbling_intervals", "G01 I01", with_views("hour_inputs") + """,
f AS (SELECT user_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM hour_inputs GROUP BY 1)
SELECT f.user_id, f.w AS timestamp_start, round(coalesce(kb, 0), 6) AS keyboard_intensity, coalesce(clicks, 0) AS mouse_clicks, round(coalesce(dist, 0), 6) AS mouse_distance,
  last_value(app IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.w) AS app, last_value(title IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.w) AS window_title FROM f LEFT JOIN hour_inputs h ON h.user_id = f.user_id AND h.w = f.w""")
def tumbling_intervals(spark, sf):
    return signals.dense_intervals(src.raw_inputs(spark, sf), 3600).drop("timestamp_end")


view("changed", ["raw_inputs"], """
SELECT *, CASE WHEN lag(app) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM app THEN 0 ELSE 1 END AS app_change FROM raw_inputs
""")


@query("sliding_intensity", "I02 H25", with_views("changed") + """,
x AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS o FROM changed),
g AS (SELECT user_id, date_trunc('hour', ts) + to_hours(o + 1) AS window_end, count(CASE WHEN kind = 'key' THEN 1 END) AS keys, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0) AS mouse_distance,
  sum(app_change)::BIGINT AS app_changes, max_by(app, epoch_us(ts)) AS active_app FROM x GROUP BY 1, 2)
SELECT *, round(keys + clicks + mouse_distance / 100.0 + app_changes * 2, 6) AS input_activity_score, round(least(1.0, n), 6) AS confidence FROM (
  SELECT user_id, window_end, keys, clicks, round(mouse_distance, 6) AS mouse_distance, app_changes, active_app,
    least(1.0, keys / (35.0 * 60)) * 0.45 + least(1.0, clicks / (6.0 * 60)) * 0.20 + least(1.0, mouse_distance / (300.0 * 60)) * 0.25 + least(1.0, app_changes / (1.5 * 60)) * 0.10 AS n FROM g) t""".replace("SELECT *, round(keys", "SELECT * EXCLUDE (n), round(keys"))
def sliding_intensity(spark, sf):
    rows = signals.with_app_changes(src.raw_inputs(spark, sf))
    return signals.sliding_metrics(rows, 5 * 3600, 3600).drop("intensity")


PRESET_SQL = " UNION ALL ".join(f"""
SELECT '{name}' AS preset, user_id, round_even((least(1.0, k / {b[0] * 288}) * {w[0]} + least(1.0, c / {b[1] * 288}) * {w[1]} + least(1.0, m / {b[2] * 288}) * {w[2]} + least(1.0, a / {b[3] * 288}) * {w[3]}) * 100, 1) AS intensity, day::VARCHAR AS day FROM d"""
    for name, (b, w) in metrics.PRESETS.items())


@query("preset_intensity", "H25 D55", with_views("changed") + f""",
d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(CASE WHEN kind = 'key' THEN 1 END) * 20.0 AS k, count(CASE WHEN kind = 'click' THEN 1 END) * 20.0 AS c, coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0) AS m, sum(app_change) * 10.0 AS a FROM changed GROUP BY 1, 2)
{PRESET_SQL}""")
def preset_intensity(spark, sf):
    rows = signals.with_app_changes(src.raw_inputs(spark, sf)).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("kind") == "key") * 20.0).alias("k"), (F.count_if(F.col("kind") == "click") * 20.0).alias("c"),
        F.coalesce(F.sum(F.when(F.col("kind") == "move", F.col("amount"))), F.lit(0.0)).alias("m"), (F.sum("app_change") * 10.0).alias("a"))
    per = F.explode(F.array(*[
        F.struct(F.lit(p).alias("preset"), metrics.intensity(F.col("k"), F.col("c"), F.col("m"), F.col("a"), 86400, p).alias("intensity")) for p in metrics.PRESETS]))
    return rows.select("user_id", "day", per.alias("p")).select("p.preset", "user_id", "day", "p.intensity")


@query("minute_timeline", "I03 D55", with_views("raw_inputs") + """
SELECT user_id, date_trunc('minute', ts) AS minute, count(CASE WHEN kind = 'key' THEN 1 END) AS keys, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, round(coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0), 6) AS mouse_distance FROM raw_inputs GROUP BY 1, 2""")
def minute_timeline(spark, sf):
    return signals.minute_timeline(src.raw_inputs(spark, sf))


@query("input_summaries", "I04", with_views("raw_inputs") + """
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS input_count, count(CASE WHEN kind = 'key' THEN 1 END) AS keyboard_events, count(CASE WHEN kind <> 'key' THEN 1 END) AS mouse_events FROM raw_inputs GROUP BY 1, 2 HAVING count(*) >= 2""")
def input_summaries(spark, sf):
    return signals.input_summaries(src.raw_inputs(spark, sf), 86400)


@query("engagement", "I05", with_views("raw_inputs") + """,
c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent,
  CASE WHEN lag(app || window_title) OVER w IS DISTINCT FROM app || window_title THEN ts END AS opened, min(ts) OVER (PARTITION BY user_id) AS started FROM raw_inputs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM c)
SELECT user_id, started, min(CASE WHEN epoch_us(ts) - epoch_us(started) >= 43200000000 AND recent >= 3 AND epoch_us(ts) - epoch_us(since) >= 1000000 THEN ts END) AS engaged_at FROM s GROUP BY 1, 2""")
def engagement(spark, sf):
    return signals.engagement(src.raw_inputs(spark, sf), ["user_id"], warmup=43200, at_least=3, within=86400, stable=1)


@query("rolling_session_features", "I08", with_views("sess", "session_minutes") + """,
r AS (SELECT m.*, s.end_time AS now, s.start_time, s.n_apps, epoch_us(s.end_time) - epoch_us(m.minute) <= 300 * 60000000::BIGINT AS recent, row_number() OVER (PARTITION BY m.session_id ORDER BY m.minute DESC) AS rn,
  bool_or(epoch_us(s.end_time) - epoch_us(m.minute) <= 300 * 60000000::BIGINT) OVER (PARTITION BY m.session_id) AS has_recent FROM session_minutes m JOIN sess s ON s.session_id = m.session_id)
SELECT session_id, count(*) AS num_windows, sum(keys + clicks)::BIGINT AS total_input, round(least(sum(keys + clicks) / (count(*) * 60.0), 1.0), 6) AS intensity, round(1.0 / (1.0 + var_pop(keys + clicks) / 1000.0), 6) AS continuity,
  round(least(any_value(n_apps) / 5.0, 1.0), 6) AS app_diversity, round(least((epoch_us(any_value(now)) - epoch_us(any_value(start_time))) / 6e7 / 60.0, 1.0), 6) AS duration FROM r WHERE recent OR (NOT has_recent AND rn <= 10) GROUP BY 1""")
def rolling_session_features(spark, sf):
    return signals.rolling_session_features(src.sessions(spark, sf), src.session_minutes(spark, sf), "end_time", within_minutes=300)


view("day_iv", ["flat"], "SELECT *, CAST(timestamp_start AS DATE) AS day FROM flat")
view("day_runs", ["day_iv"], """
SELECT user_id, day, greatest(0.0, max(d)) AS smax, avg(d) AS savg, count(*) - 1 AS switches FROM (SELECT user_id, day, run, (epoch_us(arg_max(timestamp_end, epoch_us(timestamp_start))) - epoch_us(min(timestamp_start))) / 6e7 AS d FROM (
  SELECT *, sum(CASE WHEN p = app THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, day ORDER BY timestamp_start, event_id) AS run FROM (
    SELECT *, lag(app) OVER (PARTITION BY user_id, day ORDER BY timestamp_start, event_id) AS p FROM day_iv) a) b GROUP BY 1, 2, 3) c GROUP BY 1, 2
""")
view("day_apps", ["day_iv"], """
SELECT user_id, day, count(*) AS apps, -sum(c / t * log2(c / t)) AS raw FROM (SELECT *, sum(c) OVER (PARTITION BY user_id, day) AS t FROM (SELECT user_id, day, app, count(*) AS c FROM day_iv GROUP BY 1, 2, 3) x) y GROUP BY 1, 2
""")
view("live_vec", ["day_iv", "day_runs", "day_apps"], """
SELECT b.user_id, b.day, CASE WHEN apps > 1 THEN least(1.0, greatest(0.0, raw / log2(apps))) ELSE 0.0 END AS v0, 1.0 - least(switches / greatest(n - 1, 1), 1.0) AS v1, least(smax / 300, 1.0) AS v2, least(savg / 120, 1.0) AS v3,
  1.0 / (1.0 + spread / 1000) AS v4, least(apps / 20.0, 1.0) AS v5, least(m / 480, 1.0) AS v6, least(inputs / m / 8, 1.0) AS v7
FROM (SELECT user_id, day, sum(minutes) AS m, sum(keyboard_intensity * minutes) + sum(mouse_clicks) AS inputs, var_pop(keyboard_intensity) AS spread, count(*) AS n FROM day_iv GROUP BY 1, 2) b
JOIN day_runs r ON r.user_id = b.user_id AND r.day = b.day JOIN day_apps a ON a.user_id = b.user_id AND a.day = b.day
""")
NAMES = vectors.DIMENSIONS


def vec_cols(prefix: str = "v") -> str:
    return ", ".join(f"round({prefix}{i}, 6) AS {n}" for i, n in enumerate(signals.VECTOR))


def day_intervals(spark, sf):
    return src.intervals_flat(spark, sf).withColumn("day", F.to_date("timestamp_start"))


@query("live_vectors", "I09 G06 D24", with_views("live_vec") + f"SELECT user_id, day::VARCHAR AS day, {vec_cols()} FROM live_vec")
def live_vectors(spark, sf):
    return signals.live_vectors(day_intervals(spark, sf), ["user_id", "day"])


view("act_vec", ["day_iv", "day_runs"], """
SELECT b.user_id, b.day, least((apps - 1) / 5.0, 1.0) AS v0, steady AS v1, least(smax / 300, 1.0) AS v2, least(savg / 120, 1.0) AS v3, steady AS v4, least(apps / 10.0, 1.0) AS v5, least(m / 480, 1.0) AS v6, least(clicks / m / 8, 1.0) AS v7
FROM (SELECT user_id, day, count(DISTINCT app) AS apps, 1.0 / (1.0 + var_pop(keyboard_intensity) / 1000) AS steady, sum(mouse_clicks) AS clicks,
  (epoch_us(arg_max(timestamp_end, epoch_us(timestamp_start))) - epoch_us(min(timestamp_start))) / 6e7 AS m FROM day_iv GROUP BY 1, 2) b JOIN day_runs r ON r.user_id = b.user_id AND r.day = b.day
""")


@query("activity_vectors", "I10", with_views("act_vec") + f"SELECT user_id, day::VARCHAR AS day, {vec_cols()} FROM act_vec")
def activity_vectors(spark, sf):
    return signals.activity_vectors(day_intervals(spark, sf), ["user_id", "day"])


@query("signal_windows", "I18", with_views("front") + """,
x AS (SELECT *, sum(CASE WHEN p = task_id THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY timestamp_start, event_id) AS w FROM (SELECT *, lag(task_id) OVER (PARTITION BY session_id ORDER BY timestamp_start, event_id) AS p FROM front) a)
SELECT session_id, w::BIGINT AS window_no, task_id, start_time, lead(start_time) OVER (PARTITION BY session_id ORDER BY w) AS end_time, keys, clicks, mouse_distance, active_app FROM (
  SELECT session_id, w, task_id, min(timestamp_start) AS start_time, sum(trunc(keyboard_intensity))::BIGINT AS keys, sum(mouse_clicks)::BIGINT AS clicks, sum(trunc(mouse_distance))::BIGINT AS mouse_distance, max_by(app, epoch_us(timestamp_start)) AS active_app FROM x GROUP BY 1, 2, 3) b""")
def signal_windows(spark, sf):
    return signals.signal_windows(signal_rows(spark, sf), ["session_id"])


def signal_rows(spark, sf):
    return src.interval_signals(spark, sf).filter("session_id is not null").select(
        "session_id", F.col("timestamp_start").alias("ts"), "event_id", "task_id", F.col("keyboard_intensity").cast("long").alias("keys"),
        F.col("mouse_clicks").alias("clicks"), F.col("mouse_distance").cast("long").alias("distance"), "app")


@query("activity_states", "H24", with_views("ev") + """
SELECT event_id, CASE WHEN k / 100.0 < 0.1 THEN 'IDLE' WHEN k % 4 = 0 THEN 'ACTIVE_UNALIGNED' ELSE 'ACTIVE_ALIGNED' END AS state FROM ev""")
def activity_states(spark, sf):
    ev = src.events(spark, sf).withColumn("task", F.when(F.col("k") % 4 != 0, "T"))
    state = F.when(F.col("k") / 100.0 < 0.1, "IDLE").when(F.col("task").isNull(), "ACTIVE_UNALIGNED").otherwise("ACTIVE_ALIGNED")
    return ev.select("event_id", state.alias("state"))


view("svec", ["sess_class", "daily"], """
SELECT s.session_id, s.user_id, s.task_id, s.start_time, [least(d.context_switch_entropy, 1.0), least(d.focus_continuity_score, 1.0), least(d.max_sustained_minutes / 300, 1.0), least(d.avg_focus_window_minutes / 120, 1.0),
  least(d.focus_consistency, 1.0), least(n_apps / 20.0, 1.0), least(s_minutes / 480, 1.0), least(input_per_minute / 8, 1.0)] AS vector FROM sess_class s JOIN daily d ON d.user_id = s.user_id AND d.day = s.day
""")


def svec(spark, sf):
    """The first five values are the summary of the session's day (D24, D25, D26), the others its own."""
    days = daily_queries.daily_table(spark, sf).select(
        "user_id", "day", F.col("context_switch_entropy").alias("entropy"), F.col("focus_continuity_score").alias("focus_continuity"), F.col("max_sustained_minutes").alias("max_sustained"),
        F.col("avg_focus_window_minutes").alias("avg_focus"), F.col("focus_consistency").alias("consistency"))
    rows = daily.with_class(src.sessions(spark, sf)).drop("entropy", "focus_continuity").join(days, ["user_id", "day"])
    return vectors.session_vectors(rows).select("session_id", "user_id", "task_id", "start_time", "vector")


@query("session_vectors", "J10", with_views("svec") + "SELECT session_id, " + ", ".join(f"round(vector[{i + 1}], 6) AS {n}" for i, n in enumerate(signals.VECTOR)) + " FROM svec")
def session_vectors(spark, sf):
    return svec(spark, sf).select("session_id", *[F.col("vector")[i].alias(n) for i, n in enumerate(signals.VECTOR)])


view("scen", ["svec"], """
SELECT user_id, task_id, count(*) AS members, [""" + ", ".join(f"avg(vector[{i}])" for i in range(1, 9)) + """] AS centroid FROM svec GROUP BY 1, 2
""")
view("near", ["svec", "scen"], """
SELECT session_id, s.user_id, s.start_time, c.task_id AS name, c.members, d, row_number() OVER (PARTITION BY session_id ORDER BY d, c.task_id) AS r FROM (
  SELECT s.session_id, s.user_id, s.start_time, c.task_id, c.members, least(1.0, sqrt(list_sum(list_transform(generate_series(1, 8), lambda i: pow(s.vector[i] - c.centroid[i], 2))) / 8.0)) AS d FROM svec s JOIN scen c ON c.user_id = s.user_id) x
  JOIN svec s USING (session_id) JOIN scen c ON c.user_id = s.user_id AND c.task_id = x.task_id
""".replace("SELECT session_id, s.user_id, s.start_time, c.task_id AS name, c.members, d, row_number() OVER (PARTITION BY session_id ORDER BY d, c.task_id) AS r FROM (\n", "SELECT session_id, user_id, start_time, task_id AS name, members, d, row_number() OVER (PARTITION BY session_id ORDER BY d, task_id) AS r FROM (\n").replace(") x\n  JOIN svec s USING (session_id) JOIN scen c ON c.user_id = s.user_id AND c.task_id = x.task_id", ") x"))


def nearest(spark, sf, k=4):
    rows = svec(spark, sf)
    return vectors.nearest_tasks(rows, vectors.centroids(rows, ["user_id", "task_id"]), ["user_id"], "task_id", k)


@query("nearest_task", "C12 H32", with_views("near") + "SELECT session_id, name AS task, round(d, 6) AS distance FROM near WHERE r = 1")
def nearest_task(spark, sf):
    return nearest(spark, sf, 1).select("session_id", F.col("nearest")[0]["name"].alias("task"), F.col("nearest")[0]["distance"].alias("distance"))


@query("alternative_tasks", "C14", with_views("near") + "SELECT session_id, r - 1 AS rank, name AS task, round(1 - least(d / 0.35, 1.0), 6) AS confidence FROM near WHERE r BETWEEN 2 AND 4")
def alternative_tasks(spark, sf):
    rows = nearest(spark, sf).select("session_id", F.posexplode("nearest").alias("rank", "n")).filter("rank > 0")
    return rows.select("session_id", "rank", F.col("n.name").alias("task"), vectors.match_confidence(F.col("n.distance")).alias("confidence"))


view("live", ["near"], """
SELECT * FROM (SELECT session_id, user_id, start_time, name AS task, d AS distance, least(1 - least(d / 0.35, 1.0) + least(0.15 * ln(members + 1), 0.25), 1.0) AS confidence FROM near WHERE r = 1) t
WHERE confidence >= CASE WHEN confidence < 0.5 THEN 0.45 WHEN confidence >= 0.8 THEN 0.65 ELSE 0.5 END
""")


def live(spark, sf):
    return vectors.live_predictions(nearest(spark, sf, 3).drop("vector", "task_id"))


@query("live_predictions", "I11 I12", with_views("live", "near") + """
SELECT l.session_id, l.task, round(l.distance, 6) AS distance, round(l.confidence, 6) AS confidence, coalesce(a.alts, '') AS alternatives FROM live l
LEFT JOIN (SELECT session_id, string_agg(name, ',' ORDER BY r) AS alts FROM near WHERE r BETWEEN 2 AND 3 GROUP BY 1) a USING (session_id)""")
def live_predictions(spark, sf):
    return live(spark, sf).select("session_id", "task", "distance", "confidence", "alternatives")


@query("live_prediction_log", "A13 I11", with_views("live", "near") + """
SELECT CAST(l.start_time AS DATE)::VARCHAR AS date, l.session_id, l.task AS task_id, round(l.confidence, 6) AS confidence, round(l.distance, 6) AS distance_to_centroid, 300 AS feature_window_seconds,
  coalesce(a.alts, '') AS alternatives, 8 AS features FROM live l LEFT JOIN (SELECT session_id, string_agg(name, ',' ORDER BY r) AS alts FROM near WHERE r BETWEEN 2 AND 3 GROUP BY 1) a USING (session_id)""")
def live_prediction_log(spark, sf):
    path = f"{shared_folder(spark)}/worklens-predictions-{uuid.uuid4().hex[:8]}"
    made = live(spark, sf).join(svec(spark, sf).select("session_id", "vector"), "session_id")
    sinks.log_live_predictions(made.select(
        F.col("start_time").alias("ts"), "session_id", F.col("task").alias("task_id"), "confidence", F.col("distance").alias("distance_to_centroid"), F.lit("nearest").alias("reason"),
        F.lit(300).alias("feature_window_seconds"), F.col("vector").alias("feature_vector"), F.split("alternatives", ",").alias("alternative_tasks")), path)
    back = spark.read.parquet(path)
    return back.select(F.col("date").cast("string").alias("date"), "session_id", "task_id", "confidence", "distance_to_centroid", "feature_window_seconds",
                       F.array_join(F.from_json("alternative_tasks", "array<string>"), ",").alias("alternatives"), F.size(F.from_json("feature_vector", "array<double>")).alias("features"))


@query("smoothed_predictions", "I13", with_views("live") + """
SELECT session_id, best.t AS smoothed_task, round(-best.c, 6) AS smoothed_confidence FROM (
  SELECT session_id, list_extract(list_sort(list({'c': -confidence, 'at': epoch_us(start_time), 't': task}) OVER w), 1) AS best FROM live
  WINDOW w AS (PARTITION BY user_id ORDER BY start_time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) x""")
def smoothed_predictions(spark, sf):
    return vectors.smoothed(live(spark, sf), ["user_id"], ["start_time"]).select("session_id", "smoothed_task", "smoothed_confidence")


@query("embedding_nearest_label", "C12 H32", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.label, least(1.0, sqrt(sum(pow(e.v - c.m, 2)) / 64.0)) AS d FROM e JOIN c ON c.i = e.i GROUP BY 1, 2)
SELECT vec_id, label::BIGINT AS nearest_label, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) t WHERE r = 1""")
def embedding_nearest_label(spark, sf):
    rows = src.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    near = vectors.nearest_in_space(rows.drop("label"), vectors.centroids(rows, ["label"]), "vec_id", "label", 1, dimensions=64)
    return near.select("vec_id", F.col("nearest")[0]["name"].alias("nearest_label"), F.col("nearest")[0]["distance"].alias("distance"))


@query("embedding_feature_variance", "D21", """
WITH e AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings)
SELECT position, round(var_pop(v), 6) AS variance, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM e GROUP BY 1 ORDER BY var_pop(v) DESC, 1 LIMIT 20""")
def embedding_feature_variance(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return vectors.feature_variances(rows, "v")


@query("embedding_matrix_stats", "D22", """
WITH e AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS sparsity, count(*) AS values FROM e""")
def embedding_matrix_stats(spark, sf):
    return vectors.feature_matrix_stats(src.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v")


@query("normalized_metadata", "H33", with_views("sess_class") + """
SELECT session_id, round(least(1.0, greatest(0.0, CASE WHEN c <= 1 THEN c ELSE c / 100 END)), 6) AS cpu_normalized, round(least(1.0, (keys + clicks) / CASE WHEN s_minutes > 0 THEN s_minutes ELSE 1.0 END / 8), 6) AS input_intensity_normalized,
  round(least(1.0, total_events / 300.0), 6) AS signal_quality, array_to_string(apps, ',') AS top_apps FROM (SELECT *, (keys % 300) / 100.0 AS c FROM sess_class) t""")
def normalized_metadata(spark, sf):
    rows = daily.with_class(src.sessions(spark, sf)).withColumn("avg_cpu", (F.col("keys") % 300) / 100.0).withColumns({
        "avg_ram": F.col("avg_cpu"), "avg_gpu": F.col("avg_cpu"), "event_count": F.col("total_events")})
    return vectors.normalized_metadata(rows).select(
        "session_id", "cpu_normalized", "input_intensity_normalized", "signal_quality", F.array_join("top_apps", ",").alias("top_apps"))


TRAIL = ", ".join(f"sum(CASE WHEN age < {w} THEN {c} ELSE 0 END)::BIGINT AS {c}_{w}" for w in (60, 300, 600) for c in ("keys", "clicks", "mouse_distance"))


@query("session_signal_totals", "D55", with_views("session_minutes") + f"""
SELECT session_id, {TRAIL}, sum(keys)::BIGINT AS keys_all, sum(clicks)::BIGINT AS clicks_all, sum(mouse_distance)::BIGINT AS mouse_distance_all FROM (
  SELECT *, (epoch_us(max(minute) OVER (PARTITION BY session_id)) - epoch_us(minute)) / 6e7 AS age FROM session_minutes) t GROUP BY 1""")
def session_signal_totals(spark, sf):
    return signals.trailing_totals(src.session_minutes(spark, sf), [60, 300, 600])


RECENT = ["context_switch_entropy", "focus_consistency", "max_sustained", "avg_focus_window", "app_diversity", "duration", "input_intensity"]


@query("recent_activity_vectors", "I12 J10", with_views("iv") + """,
a AS (SELECT *, to_timestamp(floor(epoch_us(timestamp_start) / 1000000 / 21600) * 21600)::TIMESTAMP AS w, coalesce(app, 'unknown') AS one FROM iv),
b AS (SELECT *, sum(CASE WHEN p = one THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, w ORDER BY timestamp_start, event_id) AS run FROM (
  SELECT *, lag(one) OVER (PARTITION BY user_id, w ORDER BY timestamp_start, event_id) AS p FROM a) x),
r AS (SELECT user_id, w, run, (epoch_us(arg_max(timestamp_end, [epoch_us(timestamp_start), event_id])) - epoch_us(min(timestamp_start))) / 6e7 AS m FROM b GROUP BY 1, 2, 3),
s AS (SELECT user_id, w, max(m) AS longest, avg(m) AS streak FROM r GROUP BY 1, 2),
g AS (SELECT user_id, w, count(DISTINCT app) AS apps, sum(keyboard_intensity * minutes + mouse_clicks) AS inputs, min(timestamp_start) AS f,
    arg_max({'e': timestamp_end, 'a': one, 't': window_title}, [epoch_us(timestamp_start), event_id]) AS l,
    coalesce(1.0 / (1.0 + var_pop(nullif(keyboard_intensity, 0)) / 1000.0), 0.5) AS focus_consistency FROM a GROUP BY 1, 2),
v AS (SELECT g.*, longest, streak, CASE WHEN epoch_us(l.e) = epoch_us(f) THEN 1.0 ELSE (epoch_us(l.e) - epoch_us(f)) / 6e7 END AS m FROM g JOIN s USING (user_id, w))
SELECT user_id, w AS window_start, l.a AS active_app, l.t AS active_window_title, round(least(greatest(apps - 1, 0) / 5.0, 1.0), 6) AS context_switch_entropy, round(focus_consistency, 6) AS focus_consistency,
  round(least(longest / 300.0, 1.0), 6) AS max_sustained, round(least(streak / 120.0, 1.0), 6) AS avg_focus_window, round(least(apps / 10.0, 1.0), 6) AS app_diversity, round(least(m / 480.0, 1.0), 6) AS duration,
  round(least(inputs / m / 8.0, 1.0), 6) AS input_intensity, hour(f)::BIGINT AS time_of_day_hour FROM v""")
def recent_activity_vectors(spark, sf):
    """Windows of six hours, as the log is sparse."""
    return signals.recent_activity_vectors(src.interval_signals(spark, sf), ["user_id"], 6 * 3600).select(
        "user_id", "window_start", "active_app", "active_window_title", *RECENT, "time_of_day_hour")


@query("window_states", "H24 C05", with_views("changed", "task_events") + """,
x AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS o FROM changed),
g AS (SELECT user_id, date_trunc('hour', ts) + to_hours(o + 1) AS window_end, count(CASE WHEN kind = 'key' THEN 1 END) AS keys, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, round(coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0), 4) AS mouse_distance,
  sum(app_change)::BIGINT AS app_changes FROM x GROUP BY 1, 2),
i AS (SELECT user_id, window_end, round_even(round((least(1.0, keys / 35.0) * 0.45 + least(1.0, clicks / 6.0) * 0.20 + least(1.0, mouse_distance / 300.0) * 0.25 + least(1.0, app_changes / 1.5) * 0.10) * 100, 9), 1) AS intensity FROM g),
a AS (SELECT user_id, ts, CASE WHEN state = 'ACTIVE' THEN task_id END AS task FROM task_events)
SELECT i.user_id, i.window_end, round(i.intensity, 6) AS intensity, a.task AS active_task, CASE WHEN i.intensity / 100 < 0.1 THEN 'IDLE' WHEN a.task IS NULL THEN 'ACTIVE_UNALIGNED' ELSE 'ACTIVE_ALIGNED' END AS state
FROM i ASOF LEFT JOIN a ON i.user_id = a.user_id AND i.window_end >= a.ts""")
def window_states(spark, sf):
    """Windows of five hours with the baselines of five minutes, as the log is sparse."""
    windows = signals.sliding_metrics(signals.with_app_changes(src.raw_inputs(spark, sf)), 5 * 3600, 3600)
    share = metrics.intensity_share(F.col("keys"), F.col("clicks"), F.round("mouse_distance", 4), F.col("app_changes"), 300)
    windows = windows.select("user_id", "window_end", F.bround(F.round(share * 100.0, 9), 1).alias("intensity"))
    log = src.task_events(spark, sf).select("user_id", "ts", "event_id", F.when(F.col("state") == "ACTIVE", F.col("task_id")).alias("task"))
    return signals.window_states(windows, log)
