"""Window forms, batch folds and streams of the order-dependent rules against plain folds."""

import json
import os
import random
from functools import partial
from datetime import datetime, timedelta

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from worklens.operators import folds, statelog
import __spark_entry__  # noqa: F401  (loads the queries)
from worklens.plans import registry, stream_queries
from worklens.streaming import jobs, stateful
from worklens.sources import tables as src

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def times(rnd, n, hours=200):
    seen = sorted(rnd.sample(range(hours * 3600), n))
    return [T0 + timedelta(seconds=s) for s in seen]


def hysteresis(rows, hold):
    state = since = pending = pending_since = None
    out = []
    for ts, c in rows:
        if state is None:
            state, since = c, ts
            out.append((ts, None, c, ts, 0))
        elif c == state:
            pending = None
        elif c != pending:
            pending, pending_since = c, ts
        elif (ts - pending_since).total_seconds() >= hold[c]:
            out.append((ts, state, c, pending_since, int((ts - since).total_seconds())))
            state, since, pending = c, pending_since, None
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_committed_states_windows_equal_the_fold(spark, seed):
    rnd = random.Random(seed)
    hold = {"IDLE": 4000, "ACTIVE_UNALIGNED": 1500, "ACTIVE_ALIGNED": 0}
    data, want = [], []
    for user in (1, 2):
        rows = [(t, rnd.choice(list(hold))) for t in times(rnd, 150 if user == 1 else 40)]
        data += [(user, t, i, c) for i, (t, c) in enumerate(rows)]
        want += [(user, *r) for r in hysteresis(rows, hold)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, event_id long, candidate string")
    pick = lambda d: sorted((r.user_id, r.ts, r.from_state, r.to_state, r.since, r.duration_prev) for r in d.collect())
    assert pick(statelog.committed_states(df, ["user_id"], hold)) == sorted(want)
    fold = folds.fold_rows(df, ["user_id"], ["ts", "event_id"], partial(folds.Hysteresis, hold), f"user_id bigint, {folds.Hysteresis.SCHEMA}")
    assert pick(fold) == sorted(want)


def replay(rows):
    """Task commands one by one: at most one active task, terminal tasks take no more commands."""
    state, out = {}, []
    for ts, i, task, cmd in rows:
        now = state.get(task, "CREATED")
        active = next((t for t, s in state.items() if s == "ACTIVE"), None)
        if cmd == "ACTIVE" and now in ("CREATED", "PAUSED"):
            if active:
                state[active] = "PAUSED"
                out.append((ts, i, active, "PAUSED"))
            state[task] = "ACTIVE"
            out.append((ts, i, task, "ACTIVE"))
        elif cmd == "PAUSED" and now == "ACTIVE":
            state[task] = "PAUSED"
            out.append((ts, i, task, "PAUSED"))
        elif cmd == "COMPLETED" and now not in ("CREATED", "COMPLETED"):
            state[task] = "COMPLETED"
            out.append((ts, i, task, "COMPLETED"))
        elif cmd == "ABANDONED" and now not in ("COMPLETED", "ABANDONED"):
            state[task] = "ABANDONED"
            out.append((ts, i, task, "ABANDONED"))
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_replayed_tasks_equal_the_fold(spark, seed):
    rnd = random.Random(seed)
    cmds = ["ACTIVE"] * 6 + ["PAUSED"] * 4 + ["COMPLETED", "ABANDONED"]
    data, want = [], []
    for user in (1, 2, 3):
        rows = [(t, i, rnd.choice("ABCDEFGH"), rnd.choice(cmds)) for i, t in enumerate(times(rnd, 80))]
        data += [(user, t, i, task, c) for t, i, task, c in rows]
        want += [(user, *r) for r in replay(rows)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, event_id long, task_id string, state string")
    got = [(r.user_id, r.ts, r.event_id, r.task_id, r.state) for r in statelog.replay_tasks(df).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("files, newest_first", [(1, False), (2, False), (5, False), (5, True)])
def test_stream_hysteresis_does_not_depend_on_the_files(spark, tmp_path, files, newest_first):
    rows = src.candidates(spark, SF)
    hold = {"IDLE": 36000, "ACTIVE_UNALIGNED": 18000, "ACTIVE_ALIGNED": 0}
    for i in sorted(range(files), reverse=newest_first):
        lo, hi = T0 + timedelta(days=30 / files * i), T0 + timedelta(days=30 / files * (i + 1))
        rows.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # files out of order need a watermark that waits for them
    fold = lambda df: stateful.fold_stream(df, ["user_id"], ["ts", "event_id"], partial(folds.Hysteresis, hold), f"user_id bigint, {folds.Hysteresis.SCHEMA}", "40 days" if newest_first else "10 minutes")
    got = stateful.run_fold(spark, stream, fold, "ts").filter("user_id is not null")
    pick = lambda d: sorted((r.user_id, r.ts, r.to_state, r.since, r.duration_prev) for r in d.collect())
    assert pick(got) == pick(statelog.committed_states(rows, ["user_id"], hold))


def test_latent_tasks_first_session_opens_a_task_and_equal_ones_join(spark):
    same, far = [0.2] * 8, [0.9] * 8
    rows = [(1, "a", T0, same), (1, "b", T0 + timedelta(1), same), (1, "c", T0 + timedelta(2), far), (2, "d", T0, far)]
    df = spark.createDataFrame(rows, "user_id long, session_id string, start_time timestamp, vector array<double>")
    got = {r.session_id: (r.task_id, r.confidence, r.members) for r in folds.fold_rows(df, ["user_id"], ["start_time"], folds.LatentTasks, f"user_id bigint, {folds.LatentTasks.SCHEMA}").collect()}
    assert got["a"] == ("latent-1-1", 1.0, 1) and got["b"] == ("latent-1-1", 1.0, 2)
    assert got["c"] == ("latent-1-2", 0.5, 1) and got["d"] == ("latent-2-1", 1.0, 1)


def test_latent_tasks_add_gaps_as_the_studied_code_does(spark):
    """The third session lies half way between the two tasks, and its gaps differ in their last bit only when squares are added one by one."""
    day = lambda minutes, focus, steady: [0.0, focus, 1.0, 1.0, steady, 0.05, minutes / 480, 1.0]
    low, high, mid = day(196, 0.7432819599068261, 0.7311320754716981), day(424, 0.7432819599068261, 0.7311320754716981), day(310, 1.0, 1.0)

    def gap(a, b):  # agent/task/inference.py:72-91
        squares = 0.0
        for x, y in zip(a, b):
            squares += (x - y) * (x - y)
        return min((squares / len(a)) ** 0.5, 1.0)

    assert gap(mid, high) < gap(mid, low) < gap(mid, high) + 1e-15
    rows = [(1, s, T0 + timedelta(i), v) for i, (s, v) in enumerate([("a", low), ("b", high), ("c", mid)])]
    df = spark.createDataFrame(rows, "user_id long, session_id string, start_time timestamp, vector array<double>")
    got = {r.session_id: (r.task_id, r.members) for r in folds.fold_rows(df, ["user_id"], ["start_time"], folds.LatentTasks, f"user_id bigint, {folds.LatentTasks.SCHEMA}").collect()}
    assert got == {"a": ("latent-1-1", 1), "b": ("latent-1-2", 1), "c": ("latent-1-2", 2)}


def test_a_step_survives_being_stored():
    step = folds.LatentTasks()
    step.feed({"session_id": "a", "user_id": 1, "vector": [0.1] * 8})
    again = folds.LatentTasks().load(step.dump())
    row = {"session_id": "b", "user_id": 1, "vector": [0.15] * 8}
    assert again.feed(row) == step.feed(row)


def test_online_segments_cover_the_session_without_overlap(spark):
    rows = registry.QUERIES["online_segments"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.session_id, []).append(r)
    assert by
    for segs in by.values():
        segs.sort(key=lambda r: r.start_time)
        assert all(a.end_time <= b.start_time for a, b in zip(segs, segs[1:]))
        assert segs[0].reason.startswith("initial_")


def test_streaming_assignments_keep_their_distance(spark):
    rows = registry.QUERIES["streaming_assignments"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.user_id, []).append(r.ts)
    for ts in by.values():
        ts.sort()
        assert all((b - a).total_seconds() >= 2 * 86400 for a, b in zip(ts, ts[1:]))


def test_steps_travel_without_the_package(tmp_path):
    """What runs in a task must not import this package: executors have no copy of it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    makers = [partial(folds.Hysteresis, {"A": 1}), folds.LatentTasks, folds.OnlineSegments, partial(folds.StreamingAssignment, 60)]
    (tmp_path / "steps").write_bytes(cloudpickle.dumps(makers))
    code = "import pickle, sys; made = [m() for m in pickle.load(open('steps', 'rb'))]; assert 'worklens' not in sys.modules; print(len(made))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == "4", done.stderr


def test_replayed_rows_are_never_late(spark):
    rows = src.candidates(spark, SF).repartition(6, F.hash("event_id"))
    hold = {"IDLE": 36000, "ACTIVE_UNALIGNED": 18000, "ACTIVE_ALIGNED": 0}
    fold = lambda df: stateful.fold_stream(df, ["user_id"], ["ts", "event_id"], partial(folds.Hysteresis, hold), f"user_id bigint, {folds.Hysteresis.SCHEMA}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = stream_queries.replayed(spark, rows, "shuffled", "ts", files_per_trigger=1)
        got = stateful.run_fold(spark, stream, fold, "ts").filter("user_id is not null")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pick = lambda d: sorted((r.user_id, r.ts, r.to_state, r.since, r.duration_prev) for r in d.collect())
    assert pick(got) == pick(statelog.committed_states(rows, ["user_id"], hold))


def test_event_files_in_any_order_lose_no_rows(spark, tmp_path):
    table = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "descending")])
    step = -(-len(table) // 70)  # more files than a limited micro-batch takes, the newest first
    for i in range(70):
        pq.write_table(table.slice(i * step, step), tmp_path / f"events{i:02}.parquet")
        os.utime(tmp_path / f"events{i:02}.parquet", (1_700_000_000 + i,) * 2)
    count = lambda sf: jobs.run_available(jobs.tumbling_inputs(jobs.event_stream(spark, sf), 3600)).count()
    assert count(str(tmp_path)) == count(SF)


class RowsOfKey(folds.Step):
    SCHEMA = "n bigint"

    def __init__(self):
        self.n = 0

    def feed(self, row):
        self.n += 1
        return []

    def finish(self):
        return [(self.n,)]


def test_fold_after_a_join_that_turns_into_a_broadcast(spark):
    """All rows of a user meet in one task, although the join before is by the user and its small side is broadcast at run time."""
    rows = spark.range(40000, numPartitions=8).select((F.col("id") % 50).alias("user_id"), "id")
    few = spark.range(0, 100000, numPartitions=4).groupBy((F.col("id") % 50).alias("user_id")).agg(F.count(F.lit(1)).alias("m"))
    # the sum is small enough only once its size is known; the rows stay in more tasks than one
    changed = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        done = folds.fold_rows(rows.join(few, "user_id"), ["user_id"], ["id"], RowsOfKey, f"user_id bigint, {RowsOfKey.SCHEMA}").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((r.user_id, r.n) for r in done) == [(u, 800) for u in range(50)]


@pytest.mark.parametrize("files", [1, 3])
def test_keys_that_share_their_state_stay_apart(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(stateful, "SHARES", 1)
    rows = src.candidates(spark, SF)
    hold = {"IDLE": 36000, "ACTIVE_UNALIGNED": 18000, "ACTIVE_ALIGNED": 0}
    rows.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    make, schema = partial(folds.Hysteresis, hold), f"user_id bigint, {folds.Hysteresis.SCHEMA}"
    done = stateful.run_fold(spark, stream, lambda df: stateful.fold_stream(df, ["user_id"], ["ts", "event_id"], make, schema), "ts").filter("user_id is not null")
    pick = lambda d: sorted((r.user_id, r.ts, r.from_state or "", r.to_state, r.since, r.duration_prev) for r in d.collect())
    assert pick(done) == pick(folds.fold_rows(rows, ["user_id"], ["ts", "event_id"], make, schema))


def test_waiting_rows_of_a_batch_are_one_entry():
    kept, timers = [], []

    class Handle:
        getValueState = staticmethod(lambda *a: None)
        getListState = staticmethod(lambda *a: type("Kept", (), {"appendList": staticmethod(kept.append)}))
        registerTimer = staticmethod(timers.append)

    processor = stateful.FoldProcessor(RowsOfKey, ["user_id"], ["ts"], ["user_id", "n"])
    processor.init(Handle)
    batch = pd.DataFrame({"user_id": [1] * 500, "ts": pd.date_range("2024-01-01", periods=500, freq="s")[::-1]})
    list(processor.handleInputRows((0,), iter([batch, batch.iloc[:0], batch]), None))
    first = 1_704_067_200_000
    assert timers == [first] and [[at for at, _ in entry] for entry in kept] == [[first], [first]]
    columns, rows = json.loads(kept[0][0][1])
    assert columns == ["user_id", "ts"] and len(rows) == 500 and rows[0] == [first + 499_000, 1, "2024-01-01 00:08:19"]
