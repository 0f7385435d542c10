"""Live rules on streams, fed from files in any order, against their batch forms."""

import os
import random
from functools import partial

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (loads the queries)
from worklens.operators import folds, live, signals
from worklens.plans import registry, signal_queries, stream_queries
from worklens.sources import tables as src
from worklens.streaming import jobs

SF = "/root/testdata/sf0.001"


def cut(folder, files, seed):
    """The event table in ``files`` files of random rows."""
    table = pq.read_table(f"{SF}/events.parquet")
    order = list(range(len(table)))
    random.Random(seed).shuffle(order)
    for i in range(files):
        pq.write_table(table.take(order[i::files]), folder / f"events{i:02}.parquet")
        os.utime(folder / f"events{i:02}.parquet", (1_700_000_000 + i,) * 2)
    return str(folder)


def picked(df):
    return sorted((tuple(r) for r in registry.tidy(df.select(sorted(df.columns))).collect()), key=repr)


@pytest.mark.parametrize("files", [1, 50])
def test_streams_over_shuffled_files_equal_the_batch(spark, tmp_path, files):
    """One file a micro-batch, the files in no order; the watermark stays a table's span behind the newest row."""
    folder = cut(tmp_path, files, files)
    events = lambda: jobs.event_stream(spark, folder, files_per_trigger=10)
    late = "60 days"
    rows = src.raw_input_columns(events()).select("user_id", "ts", "event_id", "app", "window_title")
    make = partial(live.Engagement, warmup=43200, at_least=3, within=86400, stable=1)
    got = stream_queries.event_fold(spark, rows, ["user_id"], ["ts", "event_id"], make, f"user_id bigint, {live.Engagement.SCHEMA}", delay=late)
    assert picked(got) == picked(signal_queries.engagement(spark, SF))
    vectors = src.interval_columns(events()).select("user_id", "timestamp_start", "event_id", "timestamp_end", "app", "keyboard_intensity", "mouse_clicks")
    made = stream_queries.event_fold(spark, vectors, ["user_id"], ["timestamp_start", "event_id"], partial(live.WindowVectors, 86400), f"user_id bigint, {live.WindowVectors.SCHEMA}", delay=late)
    assert picked(made.withColumn("day", F.to_date("window_start").cast("string")).drop("window_start")) == picked(signal_queries.live_vectors(spark, SF).withColumn("day", F.col("day").cast("string")))


def test_a_silent_key_is_finished_and_forgotten(spark, tmp_path):
    """With a time to live of a day a key that falls silent gets its row, and starts anew when it comes back."""
    got = stream_queries.engagement_stream(spark, jobs.event_stream(spark, cut(tmp_path, 1, 3)), close_after=86400).collect()
    whole = {r["user_id"] for r in signal_queries.engagement(spark, SF).collect()}
    assert {r["user_id"] for r in got} == whole and len(got) >= len(whole)


def fed(make, rows, store=False):
    step, out = make(), []
    for row in rows:
        out += step.feed(row)
        if store:
            step = make().load(step.dump())
    return out + step.finish()


@pytest.mark.parametrize("name", ["Engagement", "Smoothing", "SignalWindows", "CollectionSpans", "WindowVectors", "RollingFeatures", "AppChanges", "SessionAssignments"])
def test_steps_survive_being_stored_after_every_row(name):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        at = 1_700_000_000 + 7 * i + rng.randint(0, 6)
        rows.append({
            "ts": folds.stamp(at), "start_time": folds.stamp(at), "timestamp_start": folds.stamp(at), "timestamp_end": folds.stamp(at + rng.choice([0, 4, 90])), "event_id": i, "side": 0,
            "app": rng.choice(["code.exe", "chrome.exe", None]), "window_title": rng.choice("ab"), "task": rng.choice("xyz"), "task_id": rng.choice(["x", "y", None]), "session_id": str(i // 60),
            "confidence": rng.choice([0.2, 0.5, 0.9]), "keys": 1, "clicks": 2, "distance": 3, "marker": rng.choice(["START", "STOP", None, None]), "background": rng.random() < 0.5,
            "keyboard_intensity": rng.choice([None, 0.0, 40.0]), "mouse_clicks": rng.choice([None, 3]), "user_id": 1, "kind": rng.choice(["key", "click", "move"]), "amount": 4.0})
    makers = {"CollectionSpans": partial(live.CollectionSpans, 1_700_009_000.0), "SessionAssignments": partial(live.SessionAssignments, at_least=5)}
    make = makers.get(name, getattr(live, name))
    plain = fed(make, rows)
    assert plain and repr(plain) == repr(fed(make, rows, store=True))


def test_engagement_by_its_rule():
    rng = random.Random(5)
    for _ in range(200):
        at, rows = 0.0, []
        for _ in range(rng.randint(1, 40)):
            at += rng.choice([0.5, 3, 10, 30, 70])
            rows.append({"ts": folds.stamp(at), "app": rng.choice(["code.exe", "code.exe", signals.SYSTEM_PROCESSES[0]]), "window_title": rng.choice("aaab")})
        want = None
        for i, r in enumerate(rows):
            t = folds.seconds(r["ts"])
            since = next(j for j in range(i, -1, -1) if j == 0 or (rows[j - 1]["app"], rows[j - 1]["window_title"]) != (r["app"], r["window_title"]))
            recent = sum(folds.seconds(q["ts"]) > t - 30 for q in rows[: i + 1])
            if t - folds.seconds(rows[0]["ts"]) >= 30 and recent >= 5 and r["app"] not in signals.SYSTEM_PROCESSES and t - folds.seconds(rows[since]["ts"]) >= 10:
                want = r["ts"]
                break
        assert [r[1] for r in fed(live.Engagement, rows)] == [want]


def test_live_steps_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    makers = [live.Engagement, live.Smoothing, live.SignalWindows, partial(live.CollectionSpans, 1.0), live.WindowVectors, live.RollingFeatures, live.AppChanges, live.SessionAssignments]
    (tmp_path / "steps").write_bytes(cloudpickle.dumps(makers))
    code = "import pickle, sys; made = [m() for m in pickle.load(open('steps', 'rb'))]; assert 'worklens' not in sys.modules; print(len(made))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == "8", done.stderr


def test_session_assignments_by_their_rule(spark):
    """Plainly: all inputs of a session are kept, the last five minutes are taken from them, and the tasks are one list."""
    rng = random.Random(9)
    at, rows = 0.0, []
    for i in range(900):
        at += rng.choice([1, 2, 3, 9])
        rows.append({"ts": folds.stamp(at), "event_id": i, "user_id": 1, "session_id": rng.choice(["a", "a", "b", f"c{i // 300}"]), "kind": rng.choice(["key", "click", "move"]), "amount": float(rng.randint(1, 300)), "app": rng.choice(["code.exe", "chrome.exe", "slack.exe"])})
    tasks, last, seen, want = folds.LatentTasks(), {}, {}, []
    for r in rows:
        name, t = r["session_id"], folds.seconds(r["ts"])
        seen.setdefault(name, []).append(r)
        inside = [k for k, q in enumerate(seen[name]) if folds.seconds(q["ts"]) >= t - 300]
        moved = sum(k == 0 or seen[name][k - 1]["app"] != seen[name][k]["app"] for k in inside)
        of = lambda kind: [seen[name][k] for k in inside if seen[name][k]["kind"] == kind]
        if (name in last and t - last[name] < 60) or len(inside) < 30:
            continue
        share = min(1, len(of("key")) / 35) * 0.45 + min(1, len(of("click")) / 6) * 0.2 + min(1, sum(q["amount"] for q in of("move")) / 300) * 0.25 + min(1, moved / 1.5) * 0.1
        vector = [0.5, 0.5, 0, 0, 0.5, len({q["app"] for q in seen[name]}) / 10, 0, round(share * 100, 1) / 100]
        got = tasks.feed({"session_id": name, "user_id": 1, "vector": vector})[0]
        if got[2] >= (0.7 if len(inside) >= 100 else 0.6):
            last[name] = t
            want.append((name, r["ts"], got[1], got[2], len(inside)))
    assert len(want) > 10 and [r[:5] for r in fed(live.SessionAssignments, rows)] == want


def test_session_assignments_and_window_states_over_the_table(spark):
    assert picked(stream_queries.stream_session_assignments(spark, SF)) == picked(stream_queries.session_assignments(spark, SF))
    states = {r["state"] for r in signal_queries.window_states(spark, SF).select("state").distinct().collect()}
    assert states == {"IDLE", "ACTIVE_ALIGNED", "ACTIVE_UNALIGNED"}
