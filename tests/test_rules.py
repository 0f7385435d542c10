"""Small hand-made cases for rules with traps."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens.functions import scoring, text
from worklens.operators import attribution, classify, features, insights, metrics, retention, scans, statelog, tasks, trends
from worklens.sources import sinks

T0 = datetime(2024, 3, 1, 9, 0)
at = lambda m: T0 + timedelta(minutes=m)


@pytest.mark.parametrize("app,title,task,reason", [
    ("code.exe", "main.py", "deep_development", "app_match"),
    ("firefox.exe", "GitHub - Pull Request #123", "technical_research", "app_match"),
    ("outlook.exe", "Inbox", "email_communication", "app_match"),
    ("teams.exe", "Call - Team Meeting", "video_conferencing", "app_match"),
    ("teams.exe", "Chat - John Doe", "chat_messaging", "app_match"),
    ("chrome.exe", "YouTube - How to", "content_consumption", "app_match"),
    ("chrome.exe", "a spreadsheet", "data_analysis", "title_and_app_match"),
    ("unknown.exe", "quarterly spreadsheet", "data_analysis", "title_match"),
    ("explorer.exe", "System tray overflow window", "general_productivity", "ignored_system_ui"),
])
def test_recommendation_layers(spark, app, title, task, reason):
    row = spark.createDataFrame([(app, title, 5.0, 0.5, 3, 0.2, 0.5, 0.0, 0.0)],
                                "app string, window_title string, intensity double, continuity double, num_windows int, app_diversity double, duration_hours double, mic_ratio double, camera_ratio double")
    got = classify.recommend(row).first()
    assert (got.task, got.reason) == (task, reason)


def test_a_video_call_needs_a_sign_of_one(spark):
    schema = "app string, window_title string, intensity double, continuity double, num_windows int, app_diversity double, duration_hours double, mic_ratio double, camera_ratio double"
    calm = (20.0, 0.8, 2, 0.1, 3.0)
    rows = [("player.exe", "x", *calm, 0.0, 0.0), ("player.exe", "x", *calm, 0.5, 0.0), ("browser", "x", *calm, 0.0, 0.0)]
    got = [r.task for r in classify.recommend(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["content_consumption", "video_conferencing", "browsing_research"]


def test_titles(spark):
    df = spark.createDataFrame([("ChatGPT – Mozilla Firefox",), ("quantova - Google Search – Mozilla Firefox",), (None,), ("x – Google Chrome",)], "t string")
    assert [r[0] for r in df.select(text.clean_title(F.col("t"))).collect()] == ["ChatGPT", "quantova | GoogleSearch", "", "x | GoogleChrome"]
    assert [r[0] for r in df.select(text.clean_title(F.col("t"), keep_spaces=True)).collect()] == ["ChatGPT", "quantova | Google Search", "", "x"]
    assert spark.range(1).select(text.title_case(F.lit("deep_work-2go it's"))).first()[0] == "Deep_Work-2Go It'S"


def test_session_class_order(spark):
    rows = [(400.0, 4, 1), (60.0, 4, 1), (60.0, 3, 1), (600.0, 5000, 2), (0.0, 0, 0)]
    df = spark.createDataFrame(rows, "d double, n long, a long")
    got = [r[0] for r in df.select(scoring.session_class(F.col("d"), F.col("n"), F.col("a"))).collect()]
    assert got == ["idle-heavy", "focused", "passive", "mixed", "passive"]


def log(spark, rows):
    return spark.createDataFrame([(1, t, i, "A", s) for i, (t, s) in enumerate(rows)], "user_id long, ts timestamp, event_id long, task_id string, state string")


def test_active_intervals_reset_and_stay_open(spark):
    rows = [(at(0), "CREATED"), (at(1), "ACTIVE"), (at(2), "ACTIVE"), (at(5), "PAUSED"), (at(6), "PAUSED"), (at(7), "ACTIVE")]
    got = attribution.active_intervals(log(spark, rows)).collect()
    assert sorted((g.a_start, g.a_end) for g in got if g.a_end) == [(at(2), at(5))]
    assert [g.a_start for g in got if g.a_end is None] == [at(7)]


def test_attribution_adds_up_to_the_session(spark):
    sessions = spark.createDataFrame([(1, "s", at(0), at(100))], "user_id long, session_id string, start_time timestamp, end_time timestamp")
    spans = spark.createDataFrame([(1, "A", at(10), at(20)), (1, "A", at(15), at(30)), (1, "B", at(90), None)], "user_id long, task_id string, a_start timestamp, a_end timestamp")
    got = {r.task_id: r.seconds for r in attribution.attribute_sessions(sessions, spans, F.lit(at(500))).collect()}
    assert got == {"A": 1200, "B": 600, None: 4200}


def test_background_event_goes_to_the_containing_session_first(spark):
    sessions = spark.createDataFrame([(1, "a", at(0), at(10)), (1, "b", at(12), at(20))], "user_id long, session_id string, start_time timestamp, end_time timestamp")
    events = spark.createDataFrame([(1, 1, at(10)), (2, 1, at(11.5)), (3, 1, at(25)), (4, 1, at(25.1))], "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.session_id for r in attribution.background_to_sessions(events, sessions, 300).collect()}
    assert got == {1: "a", 2: "b", 3: "b"}


def test_listing_limits_before_the_duration_filter(spark):
    rows = [(i, 1, "s", "t", at(i), at(i) + timedelta(seconds=60 if i % 2 else 10), 0.5, "r", "{}") for i in range(6)]
    seg = spark.createDataFrame(rows, "segment_id long, user_id long, session_id string, task_id string, start_time timestamp, end_time timestamp, confidence double, reason string, feature_vector string")
    sess = spark.createDataFrame([("s", at(0), at(9))], "session_id string, start_time timestamp, end_time timestamp")
    pick = lambda **kw: sorted(r.segment_id for r in scans.segment_listing(seg, sess, min_seconds=30, limit=3, **kw).collect())
    assert pick() == [3, 5]
    assert pick(limit_first=False) == [1, 3, 5]


def test_upsert_replace_and_delete(spark):
    old = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(0))], "k string, v int, t timestamp")
    new = spark.createDataFrame([("b", 2, at(1)), ("c", None, at(1))], "k string, v int, t timestamp")
    assert sorted((r.k, r.v) for r in sinks.upsert(old, new, ["k"], ["t"]).collect() if r.k != "c") == [("a", 1), ("b", 2)]
    assert sorted((r.k, r.v) for r in sinks.replace_by_key(old, new, ["k"], ["v"]).collect()) == [("a", 1), ("b", 2)]
    assert [r.k for r in sinks.delete_keys(old, new, ["k"]).collect()] == ["a"]


def test_sinks_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, at(0), "x"), (2, at(24 * 60), "y")], "id long, ts timestamp, note string")
    sinks.append(df.limit(1), str(tmp_path / "t"), "ts")
    sinks.append(df.filter("id = 2"), str(tmp_path / "t"), "ts")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and "PartitionFilters: [isnotnull(date" in back.filter("date = DATE'2024-03-01'")._jdf.queryExecution().toString()
    sinks.export_json(df, str(tmp_path / "j"))
    sinks.export_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "ts", "note"]
    assert sinks.with_raw_json(df).filter(F.get_json_object("raw_json", "$.note") == F.col("note")).count() == 2


def test_retention_is_strict_and_keeps_sessions_in_progress(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(-1)), (3, None)], "id long, ts timestamp")
    kept = retention.split_by_age(df, F.col("ts"), F.lit(at(24 * 60)), 1)
    assert {r.id: r.kept for r in kept.collect()} == {1: True, 2: False, 3: True}
    rows = spark.createDataFrame([("a", at(-9999999), False), ("b", at(-9999999), True), ("c", None, False)], "id string, end_time timestamp, in_progress boolean")
    assert {r.id: r.action for r in retention.stale_sessions(rows, F.lit(at(0))).collect()} == {"a": "archive", "b": "keep", "c": "keep"}


def test_reconcile_keeps_the_last_start(spark):
    rows = [(1, "a", "ACTIVE", at(0)), (1, "b", "ACTIVE", at(5)), (1, "c", "PAUSED", at(9)), (2, "d", "ACTIVE", None)]
    got = statelog.reconcile(spark.createDataFrame(rows, "user_id long, task_id string, state string, started_at timestamp")).collect()
    assert {r.task_id: r.state for r in got} == {"a": "PAUSED", "b": "ACTIVE", "c": "PAUSED", "d": "PAUSED"}


def test_similarity_parts_stay_in_range_and_self_is_one(spark):
    row = [(at(0), at(30), "chrome.exe", ["a", "b"], 30.0, 2.0, 3, 1, 0.2, 0.1, 0.5, 0.3, 0.4, None, 0.2, 0.6, True)]
    cols = tasks.SIMILARITY_COLUMNS
    df = spark.createDataFrame(row, ", ".join(f"{c} {t}" for c, t in zip(cols, ["timestamp", "timestamp", "string", "array<string>", "double", "double", "int", "int"] + ["double"] * 6 + ["double", "double", "boolean"])))
    parts = tasks.similarity(F.col, F.col)
    got = df.select(*[c.alias(n) for n, c in parts.items()], tasks.total_similarity(parts).alias("all")).first()
    assert abs(got["all"] - 1.0) < 1e-9


def test_nearest_in_blocks_equals_one_array(spark):
    from worklens.operators import vectors

    rows = spark.createDataFrame([(i, [i / 10.0, (i * 7 % 10) / 10.0]) for i in range(10)], "id long, vector array<double>")
    centres = spark.createDataFrame([(f"c{i}", [i / 5.0, 1 - i / 5.0], i + 1) for i in range(6)], "name string, centroid array<double>, members long")
    pick = lambda block: {r.id: [(round(n.distance, 9), n.name) for n in r.nearest] for r in vectors.nearest_in_space(rows, centres, "id", "name", 2, dimensions=2, block=block).collect()}
    assert pick(100) == pick(2) and all(len(v) == 2 for v in pick(2).values())


def test_filters_and_columns_reach_the_scan(spark):
    from worklens.sources import tables

    df = scans.in_period(tables.intervals_flat(spark, "/root/testdata/sf0.001"), "timestamp_start", "timestamp_end", None, "2024-01-12").select("event_id", "timestamp_start")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp>" in plan


def test_means_at_a_bound_count_in_any_order_of_adding(spark):
    low = (0.7 + 0.7 + 0.7) / 3
    assert low < 0.7
    rows = spark.createDataFrame([(1, "s1", "a", low, 0.1, None, 5.0, "x"), (2, "s2", "a", 0.1, 0.7999999999999999, 0.1, 5.0, "x"), (3, "s3", "a", 0.69, 0.79, 0.59, 5.0, "x")],
                                 "user_id long, segment_id string, primary_app string, mean_cpu_usage double, mean_ram_usage double, mean_gpu_usage double, duration_minutes double, x string")
    assert sorted(r.segment_id for r in insights.heavy_segments(rows).collect()) == ["s1", "s2"]
    assert sorted(r.user_id for r in insights.heavy_tasks(insights.task_resource_usage(rows, ["user_id"])).collect()) == [1, 2]


def test_halves_of_an_intensity_fall_alike_in_any_order_of_adding(spark):
    rows = spark.createDataFrame([(145.8,), (145.79999999999998,)], "m double")
    none = F.lit(0.0)
    assert [r[0] for r in rows.select(metrics.intensity(none, none, F.col("m"), none, 300)).collect()] == [12.2, 12.2]


def test_an_app_with_half_of_the_week_dominates_in_any_order_of_adding(spark):
    days = [date(2024, 1, 1), date(2024, 1, 2)]
    daily = spark.createDataFrame([(1, d, 60.0, 0.5, 0.1, 60.0, 1.0) for d in days], "user_id long, day date, avg_session_seconds double, focus_ratio double, fragmentation_index double, total_active_seconds double, input_density double")
    apps = spark.createDataFrame([(1, days[0], "z.exe", 0.1), (1, days[1], "z.exe", 0.2), (1, days[0], "a.exe", 0.3)], "user_id long, day date, app string, app_seconds double")
    found = {r.day: r.dominant_app for r in trends.stable_patterns(daily, apps).collect()}
    assert found == {days[0]: "a.exe", days[1]: "a.exe"}


def test_whole_inputs_of_a_segment_stay_whole(spark):
    """.7 + .1 + .2 falls just short of 1."""
    from datetime import datetime, timedelta

    from worklens.operators import scans

    t0 = datetime(2024, 3, 1, 9)
    value = [0.7, 0.1, 0.2]
    iv = [("s", t0 + timedelta(minutes=i), t0 + timedelta(minutes=i + 1), 0.5, 0.5, 0.5, 0.0, v, 0) for i, v in enumerate(value)]
    signals = spark.createDataFrame(iv, "session_id string, timestamp_start timestamp, timestamp_end timestamp, cpu_usage double, ram_usage double, gpu_usage double, audio_volume double, keyboard_intensity double, mouse_clicks int").coalesce(1)
    spans = spark.createDataFrame([(1, "s", t0, t0 + timedelta(hours=1))], "segment_id long, session_id string, start_time timestamp, end_time timestamp")
    assert [r["event_count"] for r in scans.segment_metrics(spans, signals).collect()] == [1]
