"""Task attribution, interval algebra, timelines and state logs."""

from pyspark.sql import functions as F

from worklens.functions.ranges import asof_join, merge_intervals
from worklens.operators import attribution, statelog, timeline
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.session import stored
from worklens.sources import tables as src

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

view("active", ["task_events"], """
SELECT user_id, task_id, ts AS a_start, nts AS a_end FROM (
  SELECT *, lead(ts) OVER w AS nts, lead(state) OVER w AS ns FROM task_events WINDOW w AS (PARTITION BY user_id, task_id ORDER BY ts, event_id)) t
WHERE state = 'ACTIVE' AND (ns IS NULL OR ns <> 'ACTIVE')
""")


def active(spark, sf):
    return stored(spark, sf, "active_intervals", lambda: attribution.active_intervals(src.task_events(spark, sf)))


@query("active_intervals", "G09", with_views("active") + "SELECT user_id, task_id, a_start, a_end FROM active")
def active_intervals(spark, sf):
    return attribution.active_intervals(src.task_events(spark, sf))


@query("total_active_seconds", "D30 K03", with_views("active") + f"""
SELECT user_id, task_id, trunc(sum(greatest(0.0, (epoch_us(coalesce(a_end, {NOW})) - epoch_us(a_start)) / 1e6)))::BIGINT AS active_seconds FROM active GROUP BY 1, 2""")
def total_active_seconds(spark, sf):
    return attribution.total_active_seconds(active(spark, sf), src.as_of())


view("olap", ["sess", "active"], f"""
SELECT s.user_id, s.session_id, a.task_id, s.start_time, s.end_time, a.a_start,
  (epoch_us(least(s.end_time, coalesce(a.a_end, {NOW}))) - epoch_us(greatest(s.start_time, a.a_start))) AS us
FROM sess s JOIN active a ON a.user_id = s.user_id AND a.a_start < s.end_time AND coalesce(a.a_end, {NOW}) > s.start_time AND coalesce(a.a_end, {NOW}) > a.a_start
""")


@query("session_interval_overlaps", "C02", with_views("olap") + "SELECT session_id, task_id, a_start, round(us / 1e6, 6) AS seconds FROM olap WHERE us > 0")
def session_interval_overlaps(spark, sf):
    return attribution.session_overlaps(src.sessions(spark, sf), active(spark, sf), src.as_of()).select("session_id", "task_id", "a_start", "seconds")


view("attributed", ["olap", "sess"], """
SELECT user_id, session_id, task_id, us // 1000000 AS seconds FROM (
  SELECT user_id, session_id, task_id, sum(us)::BIGINT AS us FROM olap GROUP BY 1, 2, 3
  UNION ALL SELECT s.user_id, s.session_id, NULL, (epoch_us(s.end_time) - epoch_us(s.start_time) - coalesce(c.us, 0))::BIGINT FROM sess s
    LEFT JOIN (SELECT session_id, sum(us) AS us FROM olap GROUP BY 1) c ON c.session_id = s.session_id) x WHERE us > 0
""")


def attributed(spark, sf):
    return stored(spark, sf, "attributed", lambda: attribution.attribute_sessions(src.sessions(spark, sf), active(spark, sf), src.as_of()))


@query("session_attribution", "C03", with_views("attributed") + "SELECT user_id, session_id, coalesce(task_id, 'Unattributed') AS task_id, seconds::BIGINT AS seconds FROM attributed")
def session_attribution(spark, sf):
    return attributed(spark, sf).withColumn("task_id", F.coalesce("task_id", F.lit("Unattributed")))


@query("task_session_overlap", "C04", with_views("attributed") + """
SELECT a.user_id, a.task_id, a.session_id, start_time, seconds::BIGINT AS seconds, round(seconds / ((epoch_us(end_time) - epoch_us(start_time)) // 1000000) * 100, 6) AS percent,
  sum(seconds) OVER (PARTITION BY a.user_id, a.task_id)::BIGINT AS total_seconds FROM attributed a JOIN sess s ON s.session_id = a.session_id WHERE a.task_id IS NOT NULL AND seconds > 0""")
def task_session_overlap(spark, sf):
    return attribution.task_session_overlap(src.sessions(spark, sf), attributed(spark, sf)).select(
        "user_id", "task_id", "session_id", "start_time", "seconds", "percent", "total_seconds")


@query("task_stats", "D28 D29", with_views("front", "sess") + """
SELECT task_id, sum(d)::BIGINT AS seconds, count(*) AS segments, sum(trunc(keys * (d / whole) + 1e-9))::BIGINT AS keys, sum(trunc(clicks * (d / whole) + 1e-9))::BIGINT AS clicks
FROM (SELECT f.task_id, (f.minutes * 60)::BIGINT AS d, s.keys, s.clicks, greatest(1.0, s.duration_seconds) AS whole FROM front f JOIN sess s USING (session_id)) t GROUP BY 1""")
def task_stats(spark, sf):
    return attribution.task_stats(intent_segments(spark, sf), src.sessions(spark, sf))


def intent_segments(spark, sf):
    return src.interval_signals(spark, sf).filter("session_id is not null").select(
        "user_id", "session_id", "event_id", "task_id", F.col("timestamp_start").alias("start_time"), F.col("timestamp_end").alias("end_time"))


view("merged", ["flat"], """
SELECT user_id, min(timestamp_start) AS m_start, max(timestamp_end) AS m_end, count(*) AS n_merged FROM (
  SELECT *, sum(CASE WHEN timestamp_start <= seen THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id) AS g FROM (
    SELECT *, max(timestamp_end) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM flat) a) b GROUP BY user_id, g
""")


@query("merged_intervals", "G07", with_views("merged") + "SELECT user_id, m_start AS timestamp_start, m_end AS timestamp_end, n_merged FROM merged")
def merged_intervals(spark, sf):
    return merge_intervals(src.intervals_flat(spark, sf), ["user_id"], "timestamp_start", "timestamp_end")


@query("coverage_gaps", "G10", with_views("merged") + """
SELECT * FROM (SELECT user_id, m_end AS gap_start, lead(m_start) OVER w AS gap_end, (epoch_us(lead(m_start) OVER w) - epoch_us(m_end)) // 1000000 AS gap_seconds FROM merged
  WINDOW w AS (PARTITION BY user_id ORDER BY m_start)) t WHERE gap_seconds >= 18000""")
def coverage_gaps(spark, sf):
    return attribution.coverage_gaps(src.intervals_flat(spark, sf), ["user_id"], "timestamp_start", "timestamp_end", minutes=300)


view("wide_merged", ["wide"], """
SELECT *, min(start_time) OVER (PARTITION BY key, g) AS merged_start FROM (
  SELECT *, sum(CASE WHEN start_time <= seen THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY start_time, l_orderkey, l_linenumber) AS g FROM (
    SELECT *, max(end_time) OVER (PARTITION BY key ORDER BY start_time, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM wide) a) b
""")
WIDE = (["key"], "start_time", "end_time", ["l_orderkey", "l_linenumber"])


@query("merged_wide_sessions", "G08 S03", with_views("wide_merged") + """
SELECT key, merged_start, max(end_time) AS merged_end, sum(keys)::BIGINT AS keys, sum(clicks)::BIGINT AS clicks, sum(mouse_distance)::BIGINT AS mouse_distance, count(*) AS sessions,
  array_to_string(list_sort(list(DISTINCT app)), ',') AS apps FROM wide_merged GROUP BY 1, 2""")
def merged_wide_sessions(spark, sf):
    return timeline.merge_sessions(src.intervals_wide(spark, sf), *WIDE, F.trunc("start_time", "month"))


@query("merged_session_timeline", "G08", with_views("wide_merged") + """
SELECT key, merged_start, date_trunc('month', start_time)::DATE::VARCHAR AS bucket, sum(keys)::BIGINT AS keys, sum(clicks)::BIGINT AS clicks FROM wide_merged GROUP BY 1, 2, 3""")
def merged_session_timeline(spark, sf):
    """The bucket-wise counters of the sessions (buckets of a month, as the spans last weeks) by merged session."""
    month = F.trunc("start_time", "month")
    return timeline.merged_totals(timeline.mark_merged(src.intervals_wide(spark, sf), *WIDE, month), ["key"], month.alias("bucket"), ["keys", "clicks"])


@query("merged_session_intents", "G08", with_views("wide_merged") + """
SELECT key, merged_start, intent, sum((epoch_us(end_time) - epoch_us(start_time)) // 1000000)::BIGINT AS seconds FROM wide_merged GROUP BY 1, 2, 3""")
def merged_session_intents(spark, sf):
    rows = src.intervals_wide(spark, sf).withColumn("seconds", F.unix_seconds("end_time") - F.unix_seconds("start_time"))
    return timeline.merged_totals(timeline.mark_merged(rows, *WIDE, F.trunc("start_time", "month")), ["key"], "intent", ["seconds"])


@query("background_events_to_sessions", "C01 A04", with_views("ev", "sess") + """,
pairs AS (SELECT e.event_id, s.session_id, e.ts BETWEEN s.start_time AND s.end_time AS contained, s.start_time,
    CASE WHEN e.ts BETWEEN s.start_time AND s.end_time THEN 0.0 ELSE least(abs(epoch_us(e.ts) - epoch_us(s.start_time)), abs(epoch_us(e.ts) - epoch_us(s.end_time))) / 1e6 END AS gap
  FROM ev e JOIN sess s ON s.user_id = e.user_id AND e.ts >= s.start_time - INTERVAL 3 HOUR AND e.ts <= s.end_time + INTERVAL 3 HOUR WHERE e.event_type = 'view')
SELECT event_id, session_id, contained, round(gap, 6) AS gap_seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY contained DESC, gap, start_time) AS r FROM pairs) t WHERE r = 1""")
def background_events_to_sessions(spark, sf):
    back = src.events(spark, sf).filter(F.col("event_type") == "view")
    return attribution.background_to_sessions(back, src.sessions(spark, sf), max_gap_seconds=3 * 3600)


@query("state_as_of", "C05", with_views("ev", "state_changes") + """
SELECT e.event_id, s.state FROM ev e ASOF LEFT JOIN state_changes s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def state_as_of(spark, sf):
    probes = src.events(spark, sf).select("event_id", "user_id", "ts")
    return asof_join(probes, src.state_changes(spark, sf), ["user_id"], "ts", "ts", "state", "state", "event_id").select("event_id", "state")


@query("buckets_in_task_time", "C08", with_views("session_minutes", "active") + f"""
SELECT a.task_id, count(*) AS buckets, sum(m.keys + m.clicks + m.mouse_distance)::BIGINT AS total
FROM session_minutes m JOIN active a ON a.user_id = m.user_id AND a.a_start <= m.minute AND m.minute < coalesce(a.a_end, {NOW}) GROUP BY 1""")
def buckets_in_task_time(spark, sf):
    closed = active(spark, sf).withColumn("a_end", F.coalesce("a_end", src.as_of()))
    return attribution.bucket_totals_in_intervals(src.session_minutes(spark, sf), closed)


view("clipped", ["front"], """
SELECT user_id, session_id, task_id, CAST(d AS DATE) AS day, greatest(timestamp_start, d) AS c0, least(timestamp_end, d + INTERVAL 1 DAY) AS c1 FROM (
  SELECT *, unnest(generate_series(date_trunc('day', timestamp_start), date_trunc('day', timestamp_end), INTERVAL 1 DAY)) AS d FROM front) t
""")


@query("task_day_report", "C09", with_views("clipped", "session_minutes") + """,
t AS (SELECT user_id, day, task_id, sum((epoch_us(c1) - epoch_us(c0)) // 1000000)::BIGINT AS seconds, count(*) AS segments FROM clipped WHERE (epoch_us(c1) - epoch_us(c0)) // 1000000 > 0 GROUP BY 1, 2, 3),
i AS (SELECT c.user_id, c.day, c.task_id, sum(m.keys)::BIGINT AS keys, sum(m.clicks)::BIGINT AS clicks FROM clipped c JOIN session_minutes m ON m.session_id = c.session_id AND m.minute >= c.c0 AND m.minute < c.c1
  WHERE (epoch_us(c1) - epoch_us(c0)) // 1000000 > 0 GROUP BY 1, 2, 3)
SELECT user_id, day::VARCHAR AS day, task_id, seconds, segments, coalesce(keys, 0) AS keys, coalesce(clicks, 0) AS clicks FROM t LEFT JOIN i USING (user_id, day, task_id)""")
def task_day_report(spark, sf):
    return attribution.task_day_report(intent_segments(spark, sf), src.session_minutes(spark, sf))


@query("new_sessions", "C19", with_views("sess") + """
SELECT session_id FROM sess WHERE user_id % 3 <> 0 OR keys % 2 = 1""")
def new_sessions(spark, sf):
    rows = src.sessions(spark, sf)
    known = rows.filter("user_id % 3 = 0 and keys % 2 = 0").select(
        "user_id", (F.col("start_time") + F.expr("interval 700 milliseconds")).alias("start_time"), (F.col("end_time") - F.expr("interval 900 milliseconds")).alias("end_time"))
    return attribution.new_sessions(rows, known).select("session_id")


@query("best_known_task", "C17", with_views("sess") + """
SELECT session_id, CASE WHEN keys % 4 = 0 THEN 'live-' || task_id WHEN user_id % 3 = 0 THEN 'activity-' || user_id::VARCHAR WHEN user_id % 2 = 0 THEN 'intent-' || user_id::VARCHAR END AS task,
  CASE WHEN keys % 4 = 0 THEN 'session' WHEN user_id % 3 = 0 THEN 'activity' WHEN user_id % 2 = 0 THEN 'intent' ELSE 'none' END AS source FROM sess""")
def best_known_task(spark, sf):
    rows = src.sessions(spark, sf)
    live = rows.filter("keys % 4 = 0").select("session_id", F.concat(F.lit("live-"), "task_id").alias("live_task"))
    users = rows.select("user_id").distinct()
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    activity = users.filter("user_id % 3 = 0").select("user_id", name("activity-").alias("activity_task"))
    intent = users.filter("user_id % 2 = 0").select("user_id", name("intent-").alias("intent_task"))
    return attribution.best_task(rows, live, activity, intent)


@query("state_durations", "G11 A07", with_views("state_changes") + f"""
SELECT user_id, ts, state, coalesce(lead(ts) OVER w, {NOW}) AS until, (epoch_us(coalesce(lead(ts) OVER w, {NOW})) - epoch_us(ts)) // 1000000 AS seconds
FROM state_changes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def state_durations(spark, sf):
    return statelog.state_durations(src.state_changes(spark, sf), src.as_of(), ["user_id"]).select("user_id", "ts", "state", "until", "seconds")


@query("window_durations", "G12", with_views("raw_inputs") + """
SELECT event_id, app, window_title, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6, 6) AS seconds FROM raw_inputs""")
def window_durations(spark, sf):
    return statelog.window_durations(src.raw_inputs(spark, sf), ["user_id"]).select("event_id", "app", "window_title", "seconds")


@query("window_changes_only", "B16", with_views("raw_inputs") + """
SELECT event_id, app FROM (SELECT *, lag(app) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM raw_inputs) t WHERE p IS NULL OR p <> app""")
def window_changes_only(spark, sf):
    return statelog.change_only(src.raw_inputs(spark, sf), ["user_id"], ["app"]).select("event_id", "app")


@query("idle_edges", "B17 H24", with_views("raw_inputs") + """
SELECT event_id, CASE WHEN idle THEN 'IDLE_ENTER' ELSE 'IDLE_EXIT' END AS edge FROM (
  SELECT *, k / 100.0 < 0.1 AS idle, coalesce(lag(k / 100.0 < 0.1) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM raw_inputs) t WHERE idle <> was""")
def idle_edges(spark, sf):
    return statelog.idle_edges(src.raw_inputs(spark, sf), ["user_id"], F.col("k") / 100.0 < 0.1).select("event_id", "edge")


HOLDS = "CASE candidate WHEN 'IDLE' THEN 36000 WHEN 'ACTIVE_UNALIGNED' THEN 18000 ELSE 0 END"


@query("committed_states", "G32 I06", with_views("cand") + f""",
runs AS (SELECT *, sum(CASE WHEN p = candidate THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT *, lag(candidate) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM cand) a),
st AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM runs),
com AS (SELECT user_id, run, min(ts) AS ts, any_value(candidate) AS to_state, any_value(since) AS since FROM st
  WHERE run = 1 OR (ts > since AND (epoch_us(ts) - epoch_us(since)) / 1e6 >= {HOLDS}) GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT *, lag(to_state) OVER (PARTITION BY user_id ORDER BY run) AS p FROM com) b WHERE p IS NULL OR p <> to_state)
SELECT user_id, ts, lag(to_state) OVER w AS from_state, to_state, since, coalesce((epoch_us(ts) - epoch_us(lag(since) OVER w)) // 1000000, 0) AS duration_prev FROM kept
WINDOW w AS (PARTITION BY user_id ORDER BY run)""")
def committed_states(spark, sf):
    return statelog.committed_states(src.candidates(spark, sf), ["user_id"], {"IDLE": 36000, "ACTIVE_UNALIGNED": 18000, "ACTIVE_ALIGNED": 0})


@query("replayed_tasks", "K01", with_views("task_events") + """,
c AS (SELECT *, epoch_us(ts) AS o FROM task_events),
f AS (SELECT user_id, task_id, min(CASE WHEN state = 'ACTIVE' THEN o END) AS fa, min(CASE WHEN state = 'ABANDONED' THEN o END) AS fb FROM c GROUP BY 1, 2),
e AS (SELECT c.user_id, c.task_id, any_value(fb) AS fb, min(CASE WHEN state = 'COMPLETED' AND o > fa AND (fb IS NULL OR fa < fb) THEN o END) AS fc, min(CASE WHEN state = 'COMPLETED' AND o > fb THEN o END) AS f2
  FROM c JOIN f ON f.user_id = c.user_id AND f.task_id = c.task_id GROUP BY 1, 2),
k AS (SELECT c.*, CASE WHEN state = 'ACTIVE' AND (t IS NULL OR o < t) THEN 'start' WHEN state = 'PAUSED' AND (t IS NULL OR o < t) THEN 'pause' WHEN o = t THEN 'end' WHEN t = fb AND o = f2 THEN 'again' END AS kind
  FROM c JOIN (SELECT *, least(fb, fc) AS t FROM e) e ON e.user_id = c.user_id AND e.task_id = c.task_id),
k2 AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN task_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM k WHERE kind IS NOT NULL),
k3 AS (SELECT *, nullif(last_value(CASE WHEN kind = 'start' THEN task_id WHEN kind IN ('pause', 'end') AND task_id = cur THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS was FROM k2)
SELECT user_id, ts, event_id, task_id, state FROM k3 WHERE (kind = 'start' AND (was IS NULL OR was <> task_id)) OR (kind = 'pause' AND was = task_id) OR kind IN ('end', 'again')
UNION ALL SELECT user_id, ts, event_id, was, 'PAUSED' FROM k3 WHERE kind = 'start' AND was <> task_id""")
def replayed_tasks(spark, sf):
    return statelog.replay_tasks(src.task_events(spark, sf))


view("snapshot", ["task_events"], """
SELECT user_id, task_id, max_by(state, epoch_us(ts)) AS state, max(CASE WHEN state = 'ACTIVE' AND event_id % 4 <> 0 THEN ts END) AS started_at FROM task_events GROUP BY 1, 2
""")


@query("reconciled_tasks", "K02", with_views("snapshot") + """
SELECT s.user_id, task_id, CASE WHEN state = 'ACTIVE' AND coalesce(task_id <> w, true) THEN 'PAUSED' ELSE state END AS state FROM snapshot s
JOIN (SELECT user_id, max_by(task_id, CASE WHEN state = 'ACTIVE' THEN epoch_us(started_at) END) AS w FROM snapshot GROUP BY 1) x ON x.user_id = s.user_id""")
def reconciled_tasks(spark, sf):
    log = src.task_events(spark, sf)
    snapshot = log.groupBy("user_id", "task_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.max(F.when((F.col("state") == "ACTIVE") & (F.col("event_id") % 4 != 0), F.col("ts"))).alias("started_at"))
    return statelog.reconcile(snapshot).select("user_id", "task_id", "state")


SESSION_STATE = {"click": "ACTIVE", "view": "FINALIZING", "purchase": "FINALIZED", "signup": "INACTIVE", "error": "ACTIVE"}


@query("invalid_session_transitions", "K04", with_views("ev") + """,
l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'FINALIZING' WHEN 'purchase' THEN 'FINALIZED' WHEN 'signup' THEN 'INACTIVE' ELSE 'ACTIVE' END AS state FROM ev)
SELECT event_id, from_state, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'INACTIVE') AS from_state FROM l) t
WHERE from_state <> state AND from_state || '>' || state NOT IN ('INACTIVE>ACTIVE', 'ACTIVE>FINALIZING', 'ACTIVE>INACTIVE', 'FINALIZING>FINALIZED', 'FINALIZING>INACTIVE', 'FINALIZED>INACTIVE')""")
def invalid_session_transitions(spark, sf):
    log = src.events(spark, sf).select("user_id", "ts", "event_id", src.lookup(F.col("event_type"), SESSION_STATE).alias("state"))
    return statelog.invalid_transitions(log, ["user_id"]).select("event_id", "from_state", "state")


@query("ghost_sessions", "K05", with_views("sess") + f""",
s AS (SELECT *, CASE WHEN keys % 3 = 0 THEN start_time END AS started_at, CASE WHEN keys % 5 = 0 THEN end_time END AS ended_at, last_value(session_id) OVER (PARTITION BY user_id ORDER BY start_time
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS act FROM sess),
g AS (SELECT *, ended_at IS NULL AND started_at IS NOT NULL AND act <> session_id AS ghost FROM s)
SELECT session_id, round(100.0 + CASE WHEN ghost THEN (epoch_us({NOW}) - epoch_us(started_at)) / 1e6 ELSE 0.0 END, 6) AS accumulated_seconds, CASE WHEN NOT ghost THEN started_at END AS started_at, ghost AS was_ghost FROM g""")
def ghost_sessions(spark, sf):
    rows = src.sessions(spark, sf)
    open_rows = rows.select("user_id", "session_id", F.lit(100.0).alias("accumulated_seconds"),
                            F.when(F.col("keys") % 3 == 0, F.col("start_time")).alias("started_at"), F.when(F.col("keys") % 5 == 0, F.col("end_time")).alias("ended_at"))
    current = rows.groupBy("user_id").agg(F.max_by("session_id", "start_time").alias("active_session"))
    return statelog.ghost_sessions(open_rows, current, src.as_of()).select("session_id", "accumulated_seconds", "started_at", "was_ghost")


@query("session_lifecycles", "K06", with_views("lifecycle_log") + f""",
sp AS (SELECT user_id, session_id, ts AS a, nts AS b FROM (SELECT *, lead(ts) OVER w AS nts, lead(command) OVER w AS nc FROM lifecycle_log WINDOW w AS (PARTITION BY user_id, session_id ORDER BY ts, event_id)) t
  WHERE command IN ('START', 'RESUME') AND (nc IS NULL OR nc IN ('PAUSE', 'END', 'REOPEN'))),
r AS (SELECT user_id, session_id, sum(CASE WHEN b IS NOT NULL THEN (epoch_us(b) - epoch_us(a)) / 1e6 ELSE 0.0 END) AS acc, max(CASE WHEN b IS NULL THEN a END) AS run FROM sp GROUP BY 1, 2),
l AS (SELECT user_id, session_id, max_by(command, epoch_us(ts)) AS last, max(ts) AS updated_at, min(CASE WHEN command IN ('START', 'RESUME') THEN ts END) AS first_started FROM lifecycle_log GROUP BY 1, 2)
SELECT l.user_id, l.session_id, CASE WHEN last IN ('START', 'RESUME') THEN 'ACTIVE' WHEN last = 'END' THEN 'ENDED' ELSE 'PAUSED' END AS state, round(coalesce(acc, 0.0), 3) AS accumulated_seconds,
  round(coalesce(acc, 0.0) + CASE WHEN run IS NOT NULL THEN (epoch_us({NOW}) - epoch_us(run)) / 1e6 ELSE 0.0 END, 3) AS duration_seconds, first_started, updated_at
FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.session_id = l.session_id""")
def session_lifecycles(spark, sf):
    done = statelog.session_lifecycles(src.lifecycle_log(spark, sf), src.as_of())
    return done.withColumns({c: F.round(c, 3) for c in ("accumulated_seconds", "duration_seconds")})


@query("collection_spans", "I19 D58", with_views("ev") + f""",
m AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'START' ELSE 'STOP' END AS marker FROM ev WHERE event_type IN ('signup', 'error')),
sp AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM m)
SELECT s.user_id, s.ts AS started, coalesce(nx, {NOW}) AS stopped, round((epoch_us(coalesce(nx, {NOW})) - epoch_us(s.ts)) / 1e6, 6) AS seconds, count(e.event_id) AS events,
  count(CASE WHEN e.event_type = 'view' THEN 1 END) AS background_events FROM sp s LEFT JOIN ev e ON e.user_id = s.user_id AND e.event_type NOT IN ('signup', 'error') AND e.ts >= s.ts AND e.ts < coalesce(nx, TIMESTAMP '2100-01-01')
WHERE marker = 'START' GROUP BY s.user_id, s.ts, s.event_id, nx""")
def collection_spans(spark, sf):
    ev = src.events(spark, sf)
    marker = F.when(F.col("event_type") == "signup", "START").otherwise("STOP")
    marks = ev.filter(F.col("event_type").isin("signup", "error")).select("user_id", "ts", "event_id", marker.alias("marker"))
    items = ev.filter(~F.col("event_type").isin("signup", "error")).select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("background"))
    return statelog.collection_spans(items, marks, ["user_id"], src.as_of())


view("sdays", ["sess"], """
SELECT user_id, session_id, CAST(d AS DATE) AS day, greatest(start_time, d) AS ds, least(end_time, d + INTERVAL 1 DAY) AS de FROM (
  SELECT *, unnest(generate_series(date_trunc('day', start_time), date_trunc('day', end_time), INTERVAL 1 DAY)) AS d FROM sess) t WHERE greatest(start_time, d) < least(end_time, d + INTERVAL 1 DAY)
""")
view("buckets", ["sdays", "session_minutes"], """
SELECT s.user_id, s.session_id, s.day, coalesce(m.minute, s.ds) AS minute, coalesce(m.keys, 0) AS keys, coalesce(m.clicks, 0) AS clicks FROM sdays s
LEFT JOIN session_minutes m ON m.session_id = s.session_id AND m.minute >= s.ds AND m.minute < s.de
""")
view("stretches", ["buckets", "state_changes"], """
SELECT * FROM (SELECT *, sum(CASE WHEN ps = state AND pt IS NOT DISTINCT FROM task THEN 0 ELSE 1 END) OVER w AS stretch FROM (
  SELECT *, lag(state) OVER w AS ps, lag(task) OVER w AS pt FROM (
    SELECT b.*, coalesce(c.state, 'unknown') AS state, c.active_task AS task, c.reason, c.confidence FROM buckets b ASOF LEFT JOIN state_changes c ON b.user_id = c.user_id AND b.minute >= c.ts) x
  WINDOW w AS (PARTITION BY user_id, session_id, day ORDER BY minute)) y
WINDOW w AS (PARTITION BY user_id, session_id, day ORDER BY minute)) z
""")
view("line", ["stretches"], """
SELECT user_id, session_id, day, stretch, state, task, min(minute) AS start_time, max(minute) + INTERVAL 1 MINUTE AS end_time, count(*) AS buckets,
  trunc((sum(keys) + sum(clicks)) / count(*))::BIGINT AS inputs_per_minute, round(avg(confidence), 6) AS confidence FROM stretches GROUP BY 1, 2, 3, 4, 5, 6
""")


def lines(spark, sf):
    return stored(spark, sf, "timeline", lambda: timeline.timeline(
        timeline.minute_states(src.sessions(spark, sf), src.session_minutes(spark, sf), src.state_changes(spark, sf))))


@query("day_timeline", "G13 D53 S04", with_views("line") + """,
fr AS (SELECT user_id, session_id, day, stretch, string_agg(reason, ',' ORDER BY m) AS reasons FROM (
  SELECT user_id, session_id, day, stretch, reason, min(minute) AS m FROM stretches WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4, 5) q GROUP BY 1, 2, 3, 4)
SELECT line.user_id, line.session_id, line.day::VARCHAR AS day, state, task, start_time, end_time, buckets, inputs_per_minute, confidence, reasons FROM line
LEFT JOIN fr ON fr.session_id = line.session_id AND fr.day = line.day AND fr.stretch = line.stretch""")
def day_timeline(spark, sf):
    return lines(spark, sf).drop("stretch")


@query("state_ratios", "D52", with_views("line") + """
SELECT user_id, day::VARCHAR AS day, round_even(sum(CASE WHEN state = 'ACTIVE_ALIGNED' THEN s ELSE 0 END) / greatest(sum(s), 1), 2) AS aligned_ratio,
  round_even(sum(CASE WHEN state = 'ACTIVE_UNALIGNED' THEN s ELSE 0 END) / greatest(sum(s), 1), 2) AS drift_ratio, round_even(sum(CASE WHEN state = 'IDLE' THEN s ELSE 0 END) / greatest(sum(s), 1), 2) AS idle_ratio
FROM (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) // 1000000 AS s FROM line) t GROUP BY 1, 2""")
def state_ratios(spark, sf):
    return timeline.state_ratios(lines(spark, sf), ["user_id", "day"])


@query("timeline_consistency", "G14", with_views("line", "sdays") + """,
a AS (SELECT user_id, day, sum((epoch_us(de) - epoch_us(ds)) // 1000000)::BIGINT AS session_seconds FROM sdays GROUP BY 1, 2),
b AS (SELECT user_id, day, sum((epoch_us(end_time) - epoch_us(start_time)) // 1000000)::BIGINT AS timeline_seconds, bool_or(coalesce(p > start_time, false)) AS has_overlap FROM (
  SELECT *, lag(end_time) OVER (PARTITION BY user_id, day ORDER BY start_time, session_id) AS p FROM line) t GROUP BY 1, 2)
SELECT a.user_id, a.day::VARCHAR AS day, session_seconds, coalesce(timeline_seconds, 0) AS timeline_seconds, coalesce(has_overlap, false) AS has_overlap,
  NOT coalesce(has_overlap, false) AND abs(session_seconds - coalesce(timeline_seconds, 0)) <= 60 AS ok FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.day = a.day""")
def timeline_consistency(spark, sf):
    return timeline.consistency(lines(spark, sf), src.sessions(spark, sf))
