"""Streams over the event file, and ordered folds."""

import uuid
from functools import partial

from pyspark.sql import functions as F

from worklens.functions import text
from worklens.operators import classify, folds, live, scans, signals, vectors
from worklens.plans import signal_queries as sig
from worklens.plans.prelude import view, with_views
from worklens.plans import attribution_queries  # noqa: F401  (registers committed_states)
from worklens.plans.registry import ORACLE, query
from worklens.plans.text_queries import name_sql, named
from worklens.session import shared_folder, stored
from worklens.sources import tables as src
from worklens.streaming import jobs, stateful

def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


YEAR = 366 * 86400


def closed_windows(spark, sf, windows):
    """All windows of the event stream, the last ones too: a closing run moves the watermark past them."""
    return stateful.run_fold(spark, jobs.event_stream(spark, sf), windows, "ts").filter("user_id is not null")


@query("stream_tumbling_inputs", "I01 A28", with_views("hour_inputs") + f"""
SELECT user_id, w AS timestamp_start, round(kb, 6) AS keyboard_intensity, clicks AS mouse_clicks, round(dist, 6) AS mouse_distance, app, title AS window_title FROM hour_inputs""")
def stream_tumbling_inputs(spark, sf):
    return closed_windows(spark, sf, partial(jobs.tumbling_inputs, seconds=3600)).drop("timestamp_end")


@query("stream_sliding_metrics", "I02", with_views("raw_inputs") + f""",
x AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS o FROM raw_inputs)
SELECT user_id, date_trunc('hour', ts) + to_hours(o + 1) AS window_end, count(CASE WHEN kind = 'key' THEN 1 END) AS keys, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, round(coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0), 6) AS mouse_distance,
  count(CASE WHEN k % 3 = 0 THEN 1 END) AS app_changes, max_by(app, epoch_us(ts)) AS active_app FROM x GROUP BY 1, 2""")
def stream_sliding_metrics(spark, sf):
    rows = closed_windows(spark, sf, partial(jobs.sliding_metrics, seconds=5 * 3600, slide=3600))
    return rows.drop("intensity", "confidence", "input_activity_score")


@query("stream_minute_timeline", "I03", with_views("raw_inputs") + f"""
SELECT user_id, date_trunc('minute', ts) AS minute, count(CASE WHEN kind = 'key' THEN 1 END) AS keys, count(CASE WHEN kind = 'click' THEN 1 END) AS clicks, round(coalesce(sum(CASE WHEN kind = 'move' THEN amount END), 0.0), 6) AS mouse_distance
FROM raw_inputs GROUP BY 1, 2""")
def stream_minute_timeline(spark, sf):
    return closed_windows(spark, sf, jobs.minute_timeline)


@query("stream_input_summaries", "I04", with_views("raw_inputs") + f"""
SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS input_count, count(CASE WHEN kind = 'key' THEN 1 END) AS keyboard_events, count(CASE WHEN kind <> 'key' THEN 1 END) AS mouse_events
FROM raw_inputs GROUP BY 1, 2 HAVING count(*) >= 2""")
def stream_input_summaries(spark, sf):
    return closed_windows(spark, sf, partial(jobs.input_summaries, seconds=86400))


@query("stream_gap_sessions", "G02", with_views("ev") + f""",
g AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) < 18000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev) t)
SELECT user_id, min(ts) AS start_time, max(ts) AS last_input, count(*) AS inputs FROM g GROUP BY user_id, s""")
def stream_gap_sessions(spark, sf):
    return closed_windows(spark, sf, partial(jobs.gap_sessions, idle_seconds=5 * 3600))


@query("stream_task_moments", "I16", with_views("ev") + """
SELECT 'T' || (k % 5)::VARCHAR AS task_id, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 2) AS m2 FROM ev GROUP BY 1""")
def stream_task_moments(spark, sf):
    return jobs.run_complete(jobs.task_moments(jobs.event_stream(spark, sf))).withColumn("m2", F.round("m2", 2))


@query("stream_committed_states", "I06", ORACLE["committed_states"])
def stream_committed_states(spark, sf):
    return committed_stream(spark, jobs.event_stream(spark, sf))


def committed_stream(spark, events, delay="10 minutes"):
    k = F.col("k")
    state = F.when(k < 30, "IDLE").when(k < 60, "ACTIVE_UNALIGNED").otherwise("ACTIVE_ALIGNED")
    rows = events.select("user_id", "ts", "event_id", state.alias("candidate"))
    hold = {"IDLE": 36000, "ACTIVE_UNALIGNED": 18000, "ACTIVE_ALIGNED": 0}
    fold = lambda df: stateful.fold_stream(df, ["user_id"], ["ts", "event_id"], partial(folds.Hysteresis, hold), f"user_id bigint, {folds.Hysteresis.SCHEMA}", delay)
    return stateful.run_fold(spark, rows, fold, "ts").filter("user_id is not null")


@query("periodic_report", "I17 D39", with_views("scored") + """,
r AS (SELECT * FROM scored WHERE epoch_us((SELECT max(timestamp_start) FROM scored)) - epoch_us(timestamp_start) <= 7200 * 60000000::BIGINT),
a AS (SELECT hour(timestamp_start) AS h, avg(focus_score) AS f, avg(input_score) AS i, avg(system_score) AS s, avg(audio_volume) AS v FROM r GROUP BY 1)
SELECT hours.h::BIGINT AS hour, round(coalesce(f, 0.0), 6) AS focus_avg, round(coalesce(i, 0.0), 6) AS input_avg, round(coalesce(s, 0.0), 6) AS system_avg, round(coalesce(v, 0.0), 6) AS audio_avg
FROM range(24) hours(h) LEFT JOIN a ON a.h = hours.h""")
def periodic_report(spark, sf):
    return jobs.periodic_report(spark, sf, lookback_minutes=7200)


@query("live_activity_tasks", "I12 I11 C13", with_views("nearest_sig") + """
SELECT event_id, best AS task, round(conf, 6) AS confidence FROM nearest_sig""")
def live_activity_tasks(spark, sf):
    def predict(batch):
        best = classify.nearest_signature(*[F.col(c) for c in ("intensity", "continuity", "num_windows", "app_diversity", "duration_hours")])
        k, minutes = F.col("k"), F.lit(10) + F.col("k") * 6
        rows = batch.select("event_id", F.col("value").alias("intensity"), ((k % 10) / 10.0).alias("continuity"), (k % 23).alias("num_windows"),
                            ((k % 8) / 8.0).alias("app_diversity"), (minutes / 120.0).alias("duration_hours")).select("event_id", best.alias("b"))
        return rows.select("event_id", F.col("b.task").alias("task"), classify.signature_confidence(F.col("b")).alias("confidence"))

    return jobs.live_scores(spark, sf, predict)


# ---- ordered folds in batch ----------------------------------------------------------------------

def latent(spark, sf):
    rows = sig.svec(spark, sf).select("user_id", "session_id", "start_time", "vector")
    return stored(spark, sf, "latent_tasks", lambda: folds.fold_rows(
        rows, ["user_id"], ["start_time", "session_id"], folds.LatentTasks, f"user_id bigint, {folds.LatentTasks.SCHEMA}"))


view("svec_n", ["svec"], "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, session_id) AS r FROM svec")
GAP = "least(1.0, sqrt(list_sum(list_transform(generate_series(1, 8), lambda j: pow(s.vector[j] - t.m[j], 2))) / 8.0))"
ZERO = "[0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]"
FRESH = f"{{'m': vector, 'v': {ZERO}, 'w': {ZERO}, 'n': 1::BIGINT, 'sure': 0.5::DOUBLE, 'drift': 0.0::DOUBLE, 'far': 0.0::DOUBLE}}"
EIGHT = "generate_series(1, 8)"
WALK = f"""
, walk AS (
  SELECT user_id, session_id, r, [{FRESH}] AS tasks, 1::BIGINT AS pos, 1.0::DOUBLE AS confidence FROM svec_n WHERE r = 1
  UNION ALL
  SELECT user_id, session_id, r, CASE WHEN joins THEN list_transform(tasks, lambda t, i: CASE WHEN i = best THEN nt ELSE t END) ELSE list_append(tasks, {FRESH}) END,
    CASE WHEN joins THEN best ELSE len(tasks) + 1 END, CASE WHEN joins THEN sure ELSE 0.5 END
  FROM (SELECT *, {{'m': nm, 'v': nv, 'w': nw, 'n': n1, 'sure': greatest(0.0, least(0.4 * least(n1 / 3.0, 1.5) + 0.35 * greatest(0.0, 1 - list_sum(nv) / 8) + 0.25 * greatest(0.0, 1 - 2 * drift), 1.0)), 'drift': drift, 'far': least(bt.far + shift, 10.0)}} AS nt
  FROM (SELECT *, greatest(0.0, least(bt.drift * 0.5 + shift * 0.3 + list_sum(nw) / 8 * 0.2, 1.0)) AS drift
  FROM (SELECT *, least(1.0, sqrt(list_sum(list_transform({EIGHT}, lambda j: pow(bt.m[j] - nm[j], 2))) / 8.0)) AS shift
  FROM (SELECT *, list_transform({EIGHT}, lambda j: bt.m[j] * (1 - a) + vector[j] * a) AS nm, list_transform({EIGHT}, lambda j: (1 - a) * (bt.v[j] + a * pow(vector[j] - bt.m[j], 2))) AS nv,
      list_transform({EIGHT}, lambda j: bt.w[j] * (1 - a) + abs(vector[j] - bt.m[j]) * a) AS nw
  FROM (SELECT *, d <= 0.35 AND sure >= 0.6 AS joins, bt.n + 1 AS n1, least(0.2, 1.0 / (bt.n + 1)) AS a
  FROM (SELECT *, tasks[best] AS bt, least(1.0, 1 - d / 0.35 + tasks[best].n / 3.0 * 0.2) AS sure FROM (
    SELECT *, list_min(ds) AS d, list_position(ds, list_min(ds))::BIGINT AS best FROM (
      SELECT s.user_id, s.session_id, s.r, s.vector, w.tasks, list_transform(w.tasks, lambda t: {GAP}) AS ds FROM walk w JOIN svec_n s ON s.user_id = w.user_id AND s.r = w.r + 1) a) b) c) d0) e) f) g) h)"""
LATENT = WALK + """
SELECT user_id, session_id, 'latent-' || user_id::VARCHAR || '-' || pos::VARCHAR AS task_id, round(confidence, 6) AS confidence, tasks[pos].n AS members FROM walk"""
CENTRES = WALK + """,
last AS (SELECT user_id, arg_max(tasks, r) AS tasks FROM walk GROUP BY 1),
cen AS (SELECT user_id, 'latent-' || user_id::VARCHAR || '-' || i::VARCHAR AS task_id, t.n AS members, t.sure AS centroid_confidence, t.drift AS drift, t.far AS drift_cumulative, list_sum(t.w) / 8 AS feature_drift_avg, t.m[1] AS entropy, t.m[2] AS continuity
  FROM (SELECT user_id, unnest(tasks) AS t, generate_subscripts(tasks, 1) AS i FROM last) x)
"""
CENTRE_COLS = "user_id, task_id, members, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("centroid_confidence", "drift", "drift_cumulative", "feature_drift_avg", "entropy", "continuity"))


@query("latent_tasks", "J05 I15", recursive(with_views("svec_n") + LATENT))
def latent_tasks(spark, sf):
    return latent(spark, sf).select("user_id", "session_id", "task_id", "confidence", "members")


@query("latent_task_summary", "J23", recursive(with_views("svec_n") + CENTRES + f"SELECT {CENTRE_COLS} FROM cen"))
def latent_task_summary(spark, sf):
    return _centroids(spark, sf)


def _centroids(spark, sf):
    return scans.latest_per_key(latent(spark, sf).drop("confidence", "session_id"), ["user_id", "task_id"], ["members"])


@query("unstable_tasks", "B14 H34", recursive(with_views("svec_n") + CENTRES + f"""SELECT {CENTRE_COLS}, CASE WHEN drift > 0.35 THEN 'critical' ELSE 'high' END AS severity FROM cen
WHERE drift > 0.15 OR drift_cumulative > 1.0 OR feature_drift_avg > 0.08"""))
def unstable_tasks(spark, sf):
    return vectors.unstable_tasks(_centroids(spark, sf))


def online_points(spark, sf):
    """Classified points of every session: app, title, task, confidence and name."""
    front = src.interval_signals(spark, sf).filter("session_id is not null").select("event_id", "session_id", F.col("timestamp_end").alias("until"))
    rows = classify.recommend(named(spark, sf).join(front, "event_id").withColumnRenamed("timestamp_start", "ts"))
    titled = text.with_task_name(rows, F.col("task"), F.col("continuity"))
    return titled.select("session_id", "ts", "event_id", "until", "app", text.clean_title(F.col("window_title")).alias("clean_title"), "task", "confidence", "task_name")


view("points", ["recommended_task", "naming", "front"], f"""
SELECT {name_sql('r.task')} AS name, f.session_id, n.timestamp_start AS ts, n.event_id, f.timestamp_end AS until, n.app, n.clean AS title, r.task, r.confidence, row_number() OVER (PARTITION BY f.session_id ORDER BY n.timestamp_start, n.event_id) AS p
FROM recommended_task r JOIN naming n USING (event_id) JOIN front f USING (event_id)
""")
STICKY = "('" + "', '".join(sorted(folds.STICKY)) + "')"
ONLINE = f"""
, walk AS (
  SELECT session_id, p, ts, until, name, task AS base, ts AS start_time, confidence AS sure, app, title, 'initial_' || task AS reason, 1::BIGINT AS seg FROM points WHERE p = 1
  UNION ALL
  SELECT session_id, p, ts, until, CASE WHEN moved OR ctx IS NOT NULL THEN name ELSE held END, CASE WHEN moved OR ctx IS NOT NULL THEN task ELSE base END, CASE WHEN moved OR ctx IS NOT NULL THEN ts ELSE start_time END,
    CASE WHEN moved OR ctx IS NOT NULL THEN confidence WHEN task = base THEN greatest(sure, confidence) ELSE sure END, app, title,
    CASE WHEN moved AND ctx IS NOT NULL THEN 'behavioral_and_context_change' WHEN ctx IS NOT NULL THEN ctx WHEN moved THEN 'behavioral_transition_' || base || '_to_' || task ELSE reason END,
    CASE WHEN moved OR ctx IS NOT NULL THEN seg + 1 ELSE seg END
  FROM (SELECT q.*, w.name AS held, w.base, w.start_time, w.sure, w.reason, w.seg,
      CASE WHEN w.base = q.task THEN false WHEN w.base IN {STICKY} THEN q.confidence - w.sure >= 0.10 OR ((epoch_us(q.ts) - epoch_us(w.start_time)) / 1e6 / 3600 >= 10 AND q.confidence - w.sure >= -0.05)
        ELSE q.confidence - w.sure > 0.03 OR (abs(q.confidence - w.sure) <= 0.15 AND (epoch_us(q.ts) - epoch_us(w.start_time)) / 1e6 / 3600 >= 3) OR ((epoch_us(q.ts) - epoch_us(w.start_time)) / 1e6 / 3600 >= 5 AND q.confidence > 0.5) END AS moved,
      CASE WHEN epoch_us(q.ts) - epoch_us(w.start_time) < 3600000000 OR q.confidence < 0.6 THEN NULL WHEN w.app <> q.app THEN 'app_change_' || w.app || '_to_' || q.app WHEN w.title <> q.title THEN 'window_change' END AS ctx
    FROM walk w JOIN points q ON q.session_id = w.session_id AND q.p = w.p + 1) x),
segs AS (SELECT session_id, seg, any_value(name) AS task_id, any_value(base) AS base_category, any_value(start_time) AS start_time, max(until) FILTER (WHERE true) AS u, arg_max(until, p) AS last_until, arg_max(sure, p) AS sure, any_value(reason) AS reason, arg_max(app, p) AS app, arg_max(title, p) AS window_title FROM walk GROUP BY 1, 2)
SELECT session_id, task_id, base_category, start_time, coalesce(lead(start_time) OVER (PARTITION BY session_id ORDER BY seg), last_until) AS end_time, round(sure, 6) AS confidence, reason, app, window_title FROM segs"""


@query("online_segments", "I07", recursive(with_views("points") + ONLINE))
def online_segments(spark, sf):
    make = partial(folds.OnlineSegments, min_seconds=3600, minute=3600.0)
    return folds.fold_rows(online_points(spark, sf), ["session_id"], ["ts", "event_id"], make, f"session_id string, {folds.OnlineSegments.SCHEMA}")


def offered(spark, sf):
    rows = sig.nearest(spark, sf, 1).join(src.sessions(spark, sf).select("session_id", (F.col("keys") + F.col("clicks")).alias("inputs")), "session_id")
    best = F.col("nearest")[0]
    return rows.select("user_id", F.col("start_time").alias("ts"), "session_id", best["name"].alias("task_id"), vectors.match_confidence(best["distance"]).alias("confidence"), "inputs")


def assignments(spark, sf):
    make = partial(folds.StreamingAssignment, every_seconds=2 * 86400)
    return folds.fold_rows(offered(spark, sf), ["user_id"], ["ts", "session_id"], make, f"user_id bigint, {folds.StreamingAssignment.SCHEMA}")


def replayed(spark, rows, name, ts, files_per_trigger=jobs.FILES_PER_TRIGGER):
    """``rows`` written as a table in the order of ``ts`` and read back as a file stream in that order, so that no file is late.
    A store that does not take the files' times gives all files as one micro-batch."""
    path = f"{shared_folder(spark)}/worklens-{name}-{uuid.uuid4().hex[:8]}"
    rows.repartitionByRange(ts).sortWithinPartitions(ts).write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    if _times_in_order(spark, path):
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _times_in_order(spark, folder):
    """Set the change times of the part files of ``folder`` a second apart in the order of their names; whether they hold."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda: sorted((f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    files = parts()
    last = max((f.getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f.getPath(), last - 1000 * (len(files) - i), -1)
    times = [f.getModificationTime() for f in parts()]
    return all(a < b for a, b in zip(times, times[1:]))


@query("stream_latent_tasks", "I15", recursive(with_views("svec_n") + LATENT))
def stream_latent_tasks(spark, sf):
    rows = sig.svec(spark, sf).select("user_id", "session_id", "start_time", "vector")
    stream = replayed(spark, rows, "vectors", "start_time").withColumn("owner", F.col("user_id"))
    fold = lambda df: stateful.fold_stream(df, ["owner"], ["start_time", "session_id"], folds.LatentTasks, f"user_id bigint, {folds.LatentTasks.SCHEMA}")
    done = stateful.run_fold(spark, stream, fold, "start_time").filter("user_id is not null")
    return done.select("user_id", "session_id", "task_id", "confidence", "members")


@query("stream_online_segments", "I07", recursive(with_views("points") + ONLINE))
def stream_online_segments(spark, sf):
    """Segments of running sessions; a session without a point for two days is finished."""
    make = partial(folds.OnlineSegments, min_seconds=3600, minute=3600.0)
    fold = lambda df: stateful.fold_stream(df, ["session_id"], ["ts", "event_id"], make, f"session_id string, {folds.OnlineSegments.SCHEMA}", close_after=2 * 86400)
    done = stateful.run_fold(spark, replayed(spark, online_points(spark, sf), "points", "ts"), fold, "ts")
    return done.filter("session_id is not null")


view("offers", ["near", "sess"], """
SELECT n.user_id, n.start_time AS ts, n.name AS task_id, 1 - least(n.d / 0.35, 1.0) AS confidence, s.keys + s.clicks AS inputs FROM near n JOIN sess s ON s.session_id = n.session_id WHERE n.r = 1
""")
view("good_offers", ["offers"], "SELECT * FROM offers WHERE inputs >= 30 AND confidence >= CASE WHEN inputs < 100 THEN 0.60 ELSE 0.70 END")
ASSIGNED = """
, taken AS (SELECT user_id, min(ts) AS ts FROM good_offers GROUP BY 1
  UNION ALL SELECT g.user_id, min(g.ts) FROM taken t JOIN good_offers g ON g.user_id = t.user_id AND g.ts >= t.ts + INTERVAL 2 DAY GROUP BY g.user_id, t.ts)
"""


@query("streaming_assignments", "I14", recursive(with_views("good_offers") + ASSIGNED + """
SELECT g.user_id, g.ts, g.task_id, round(g.confidence, 6) AS confidence, g.inputs::BIGINT AS inputs, CASE WHEN g.confidence >= 0.85 THEN 'high_confidence' WHEN g.confidence >= 0.70 THEN 'good_match' ELSE 'sufficient_data' END AS reason
FROM taken t JOIN good_offers g ON g.user_id = t.user_id AND g.ts = t.ts"""))
def streaming_assignments(spark, sf):
    return assignments(spark, sf)


@query("assignment_summary", "D60", recursive(with_views("good_offers") + ASSIGNED + """,
a AS (SELECT g.* FROM taken t JOIN good_offers g ON g.user_id = t.user_id AND g.ts = t.ts)
SELECT x.user_id, x.task_id, round(x.m, 6) AS max_confidence, x.n AS assignments, y.t AS current_task, round(y.c, 6) AS current_confidence FROM (SELECT user_id, task_id, max(confidence) AS m, count(*) AS n FROM a GROUP BY 1, 2) x
JOIN (SELECT user_id, max_by(task_id, epoch_us(ts)) AS t, max_by(confidence, epoch_us(ts)) AS c FROM a GROUP BY 1) y ON y.user_id = x.user_id"""))
def assignment_summary(spark, sf):
    rows = assignments(spark, sf)
    top = rows.groupBy("user_id", "task_id").agg(F.max("confidence").alias("max_confidence"), F.count(F.lit(1)).alias("assignments"))
    now = rows.groupBy("user_id").agg(F.max_by("task_id", "ts").alias("current_task"), F.max_by("confidence", "ts").alias("current_confidence"))
    return top.join(now, "user_id")


@query("stream_assignments", "I14", ORACLE["streaming_assignments"])
def stream_assignments(spark, sf):
    make = partial(folds.StreamingAssignment, every_seconds=2 * 86400)
    fold = lambda df: stateful.fold_stream(df, ["user_id"], ["ts", "session_id"], make, f"user_id bigint, {folds.StreamingAssignment.SCHEMA}")
    return stateful.run_fold(spark, replayed(spark, offered(spark, sf), "offers", "ts"), fold, "ts").filter("user_id is not null")


# ---- live rules in event time --------------------------------------------------------------------------

def event_fold(spark, stream, keys, order, make, schema, close_after=YEAR, delay="10 minutes"):
    """All rows of a live rule over a stream, silent keys finished."""
    fold = lambda df: stateful.fold_stream(df, keys, order, make, schema, delay, close_after)
    return stateful.run_fold(spark, stream, fold, order[0]).filter(F.col(keys[0]).isNotNull())


def engagement_stream(spark, events, close_after=YEAR):
    rows = src.raw_input_columns(events).select("user_id", "ts", "event_id", "app", "window_title")
    make = partial(live.Engagement, warmup=43200, at_least=3, within=86400, stable=1)
    return event_fold(spark, rows, ["user_id"], ["ts", "event_id"], make, f"user_id bigint, {live.Engagement.SCHEMA}", close_after)


@query("stream_engagement", "I05", like="engagement")
def stream_engagement(spark, sf):
    return engagement_stream(spark, jobs.event_stream(spark, sf))


@query("stream_smoothed_predictions", "I13 I11", like="smoothed_predictions")
def stream_smoothed_predictions(spark, sf):
    rows = sig.live(spark, sf).select("user_id", "start_time", "session_id", "task", "confidence")
    done = event_fold(spark, replayed(spark, rows, "predictions", "start_time"), ["user_id"], ["start_time", "session_id"], live.Smoothing, f"user_id bigint, {live.Smoothing.SCHEMA}")
    return done.drop("user_id")


@query("stream_signal_windows", "I18", like="signal_windows")
def stream_signal_windows(spark, sf):
    """Windows of running sessions; a session's last one is closed when it has been silent for a year, as the log is sparse."""
    stream = replayed(spark, sig.signal_rows(spark, sf), "signals", "ts")
    return event_fold(spark, stream, ["session_id"], ["ts", "event_id"], live.SignalWindows, f"session_id string, {live.SignalWindows.SCHEMA}")


def span_stream(spark, events, close_after=YEAR):
    marker = F.when(F.col("event_type") == "signup", "START").when(F.col("event_type") == "error", "STOP")
    rows = events.select("user_id", "ts", marker.alias("marker"), "event_id", (F.col("event_type") == "view").alias("background"))
    rows = rows.withColumn("side", F.when(F.col("marker").isNull(), 1).otherwise(0))
    make = partial(live.CollectionSpans, folds.seconds(src.AS_OF))
    return event_fold(spark, rows, ["user_id"], ["ts", "side", "event_id"], make, f"user_id bigint, {live.CollectionSpans.SCHEMA}", close_after)


@query("stream_collection_spans", "I19", like="collection_spans")
def stream_collection_spans(spark, sf):
    return span_stream(spark, jobs.event_stream(spark, sf))


def window_stream(spark, events, free, close_after=YEAR):
    """Windows of one day, as the log is sparse."""
    rows = src.interval_columns(events).select("user_id", "timestamp_start", "event_id", "timestamp_end", "app", "keyboard_intensity", "mouse_clicks")
    make = partial(live.WindowVectors, 86400, free)
    done = event_fold(spark, rows, ["user_id"], ["timestamp_start", "event_id"], make, f"user_id bigint, {live.WindowVectors.SCHEMA}", close_after)
    return done.withColumn("day", F.to_date("window_start").cast("string")).drop("window_start")


@query("stream_live_vectors", "I09 I11", like="live_vectors")
def stream_live_vectors(spark, sf):
    return window_stream(spark, jobs.event_stream(spark, sf), False)


@query("stream_activity_vectors", "I10 I12", like="activity_vectors")
def stream_activity_vectors(spark, sf):
    return window_stream(spark, jobs.event_stream(spark, sf), True)


@query("stream_rolling_features", "I08", like="rolling_session_features")
def stream_rolling_features(spark, sf):
    """The features of every session as they are at its end."""
    rows = src.interval_signals(spark, sf).filter("session_id is not null").select("session_id", "timestamp_start", "event_id", "timestamp_end", "app", "keyboard_intensity", "mouse_clicks")
    make = partial(live.RollingFeatures, minutes=300)
    done = event_fold(spark, replayed(spark, rows, "intervals", "timestamp_start"), ["session_id"], ["timestamp_start", "event_id"], make, f"session_id string, {live.RollingFeatures.SCHEMA}")
    return done.filter("final").drop("at", "final")


@query("stream_sliding_intensity", "I02 H25", like="sliding_intensity")
def stream_sliding_intensity(spark, sf):
    """Two streams: the first marks the inputs that open another app window, the second reads its table and keeps the windows."""
    rows = src.raw_input_columns(jobs.event_stream(spark, sf)).select("user_id", "ts", "event_id", "kind", "amount", "app")
    marked = event_fold(spark, rows, ["user_id"], ["ts", "event_id"], live.AppChanges, f"user_id bigint, {live.AppChanges.SCHEMA}", close_after=None)
    windows = lambda df: signals.sliding_metrics(df.withWatermark("ts", jobs.WATERMARK), 5 * 3600, 3600)
    done = stateful.run_fold(spark, replayed(spark, marked, "changes", "ts"), windows, "ts").filter("user_id is not null")
    return done.drop("intensity")


def session_inputs(spark, sf):
    sessions = src.interval_signals(spark, sf).filter("session_id is not null").select("event_id", "session_id")
    rows = src.raw_inputs(spark, sf).join(sessions, "event_id").select("user_id", "ts", "event_id", "session_id", "kind", "amount", "app")
    return rows.withColumn("owner", F.col("user_id"))


#: Five hours for five minutes, as the log is sparse, and three inputs for thirty.
ASSIGNING = partial(live.SessionAssignments, span=5 * 3600, every=3600, at_least=3)


@query("session_assignments", "I14")
def session_assignments(spark, sf):
    done = folds.fold_rows(session_inputs(spark, sf), ["owner"], ["ts", "event_id"], ASSIGNING, f"owner bigint, {live.SessionAssignments.SCHEMA}")
    return done.withColumnRenamed("owner", "user_id")


@query("stream_session_assignments", "I14")
def stream_session_assignments(spark, sf):
    stream = replayed(spark, session_inputs(spark, sf), "inputs", "ts")
    return event_fold(spark, stream, ["owner"], ["ts", "event_id"], ASSIGNING, f"owner bigint, {live.SessionAssignments.SCHEMA}").withColumnRenamed("owner", "user_id")


@query("stream_window_predictions", "I12 I11 C13", with_views("act_vec", "sig") + """
SELECT user_id, day::VARCHAR AS day, task, round(CASE WHEN 1 - distance < min_confidence THEN (1 - distance) * 0.7 ELSE 1 - distance END, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY distance, rank) AS r FROM (
    SELECT n.user_id, n.day, s.task, s.rank, s.min_confidence, least(1.0, sqrt(1.5 * pow(v7 - s.intensity, 2) + 1.2 * pow(v1 - s.continuity, 2) + 1.5 * pow(v5 / 2 - s.entropy, 2) + 0.8 * pow(v5 - s.diversity, 2) + 0.6 * pow(least(1, v6 * 2) - s.duration, 2)) / 3.5) AS distance
    FROM act_vec n CROSS JOIN sig s) a) b WHERE r = 1""")
def stream_window_predictions(spark, sf):
    """The nearest signature of every window of activity, from the features of the window itself."""
    rows = window_stream(spark, jobs.event_stream(spark, sf), True)
    best = classify.nearest_signature(F.col("input_intensity") * 100, F.col("focus_continuity_score"), F.col("app_diversity") * 10, F.col("app_diversity"), F.col("session_duration_minutes") * 8)
    rows = rows.select("user_id", "day", best.alias("b"))
    return rows.select("user_id", "day", F.col("b.task").alias("task"), classify.signature_confidence(F.col("b")).alias("confidence"))
