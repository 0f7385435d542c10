"""Mean similarity of clusters against all their pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from worklens.operators import cohesion, tasks

T0 = datetime(2024, 3, 1, 9)


def segments(rng, cluster, n, minutes):
    rows = []
    for i in range(n):
        start = T0 + timedelta(minutes=rng.choice([rng.random() * minutes, 10 * rng.randint(0, minutes // 10)]))
        one = lambda: rng.choice([0.0, 0.25, 1.0, rng.random()])
        rows.append(Row(
            user_id=7, cluster=cluster, segment_no=i, start_time=start, end_time=start + timedelta(minutes=rng.choice([0, 10, 20, 45])),
            primary_app=rng.choice(["code.exe", "chrome.exe", "firefox.exe", "slack.exe", "odd.exe", None]),
            primary_window_title=rng.choice(["Report draft", "report numbers", "draft report", "main.py editor", "of", None, "numbers"]),
            keyboard_intensity_avg=rng.random() * 130, mouse_intensity_avg=rng.random() * 25, total_copy_events=rng.randint(0, 40), total_paste_events=rng.randint(0, 40),
            mic_active_ratio=one(), camera_active_ratio=one(), max_audio_volume=one(), mean_cpu_usage=one(), mean_ram_usage=one(), mean_gpu_usage=rng.choice([None, one()]),
            multitasking_score=one(), activity_score=one(), is_active_work=rng.random() < 0.6))
    return rows


def test_mean_similarity_equals_the_mean_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [r for k in range(12) for r in segments(rng, k, rng.choice([1, 2, 3, 12]), rng.choice([20, 200, 4000]))] + segments(rng, 99, 90, 3000)
    df = spark.createDataFrame(rows).repartition(3).persist()
    got = {r["cluster"]: (r["segments"], r["mean_similarity"]) for r in cohesion.mean_similarity(df, ["user_id", "cluster"]).collect()}
    s = tasks.with_tokens(df)
    pairs = s.alias("p").join(s.alias("c"), F.expr("p.cluster = c.cluster AND (p.start_time < c.start_time OR (p.start_time = c.start_time AND p.segment_no < c.segment_no))"))
    parts = tasks.similarity(lambda n: F.col(f"p.{n}"), lambda n: F.col(f"c.{n}"))
    want = {r["cluster"]: r["mean"] for r in pairs.groupBy(F.col("p.cluster").alias("cluster")).agg(F.avg(tasks.total_similarity(parts)).alias("mean")).collect()}
    assert {c: n for c, (n, _) in got.items()} == {c: sum(r["cluster"] == c for r in rows) for c in {r["cluster"] for r in rows}}
    for cluster, (n, mean) in got.items():
        assert mean == pytest.approx(want.get(cluster, 1.0), abs=1e-9)
    assert cohesion.mean_similarity(df.limit(0), ["user_id", "cluster"]).count() == 0
