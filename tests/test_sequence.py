"""Chunked sequence operators against one plain fold, with a hot key and empty chunks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklens.functions.ranges import asof_join, merge_intervals, overlap_join
from worklens.functions.sequence import day_chunk, islands, scan_rows, span_islands
from worklens.functions.stats import index_percentiles, percent_rank_at
from worklens.operators import features

T0 = datetime(2024, 1, 1)


def log(seed, n=300):
    """A third of the rows and more belong to user 1; some values are NULL."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.5 else rnd.randint(2, 5)
        ts = T0 + timedelta(minutes=rnd.randint(0, 20 * 24 * 60))
        rows.append((user, ts, i, rnd.choice(["a", "b", "c", None]), rnd.randint(0, 9)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user long, ts timestamp, id long, app string, n long")


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_rows_equals_a_plain_fold(spark, seed):
    rows = log(seed)
    got = scan_rows(
        frame(spark, rows), ["user"], ["ts", "id"], day_chunk("ts"), lag={"before": F.col("app")}, lead={"after": F.col("app")},
        known={"seen": F.col("app")}, known_before={"seen_before": F.col("app")}, max_before={"high": F.col("n")}, run_sum={"total": F.col("n")},
    ).collect()
    want = {}
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2]))
        known = high = None
        total = 0
        for i, r in enumerate(mine):
            earlier = known
            known = r[3] if r[3] is not None else known
            total += r[4]
            want[r[2]] = (mine[i - 1][3] if i else None, mine[i + 1][3] if i + 1 < len(mine) else None, known, earlier, high, total)
            high = r[4] if high is None else max(high, r[4])
    assert len(got) == len(rows)
    for g in got:
        assert (g.before, g.after, g.seen, g.seen_before, g.high, g.total) == want[g.id]


@pytest.mark.parametrize("seed", [3, 4])
def test_islands_number_runs_and_look_inside_them(spark, seed):
    rows = log(seed)
    got = islands(
        frame(spark, rows), ["user"], ["ts", "id"], day_chunk("ts"), lambda: F.col("n") - F.col("__n") > 2, out="run",
        lag={"__n": F.col("n")}, uses=["n"], within={"app_before": F.col("app")},
    ).collect()
    want = {}
    for user in {r[0] for r in rows}:
        run, last, app = 0, None, None
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if last is None or r[4] - last > 2:
                run, app = run + 1, None
            want[r[2]] = (run, app)
            last, app = r[4], r[3] if r[3] is not None else app
    assert {g.id: (g.run, g.app_before) for g in got} == want


def spans(seed, n=200):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        start = T0 + timedelta(minutes=rnd.randint(0, 15 * 24 * 60))
        out.append((1 if rnd.random() < 0.4 else rnd.randint(2, 4), start, start + timedelta(minutes=rnd.choice([0, 5, 300, 4000])), i))
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_merge_intervals_never_overlap_and_keep_every_row(spark, seed):
    rows = spans(seed)
    got = merge_intervals(spark.createDataFrame(rows, "user long, s timestamp, e timestamp, id long"), ["user"], "s", "e").collect()
    want = []
    for user in {r[0] for r in rows}:
        cur = None
        for _, s, e, _ in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[2])):
            if cur and s <= cur[1]:
                cur = (cur[0], max(cur[1], e), cur[2] + 1)
            else:
                if cur:
                    want.append((user, *cur))
                cur = (s, e, 1)
        want.append((user, *cur))
    assert sorted((g.user, g.s, g.e, g.n_merged) for g in got) == sorted(want)


def test_span_islands_use_the_latest_end_not_the_last_one(spark):
    d = lambda h: T0 + timedelta(hours=h)
    rows = [(1, d(0), d(60), 0), (1, d(1), d(2), 1), (1, d(50), d(51), 2), (1, d(61), d(62), 3)]
    df = spark.createDataFrame(rows, "user long, s timestamp, e timestamp, id long")
    got = span_islands(df, ["user"], "s", "e", ["id"], day_chunk("s"), lambda s, seen: s > seen).collect()
    assert {g.id: g.island_start for g in got} == {0: d(0), 1: d(0), 2: d(0), 3: d(61)}


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_join_equals_brute_force(spark, closed):
    a, b = spans(8, 80), spans(9, 80)
    left = spark.createDataFrame(a, "user long, s timestamp, e timestamp, id long")
    right = spark.createDataFrame(b, "user long, s2 timestamp, e2 timestamp, id2 long")
    got = overlap_join(left, right, ["user"], ("s", "e"), ("s2", "e2"), bucket_seconds=7200, closed=closed).collect()
    meets = (lambda x, y: x[1] <= y[2] and y[1] <= x[2]) if closed else (lambda x, y: x[1] < y[2] and y[1] < x[2])
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and meets(x, y))
    assert sorted((g.id, g.id2) for g in got) == want


def test_asof_join_takes_the_latest_row_at_or_before(spark):
    rows = log(10, 150)
    probes = [(u, t, i) for u, t, i, _, _ in log(11, 100)] + [(rows[0][0], rows[0][1], 999)]
    got = asof_join(
        spark.createDataFrame(probes, "user long, at timestamp, probe long"), frame(spark, rows).withColumn("mark", F.col("id").cast("string")),
        ["user"], "at", "ts", "mark", "found", "id").collect()
    for g in got:
        past = [r for r in rows if r[0] == g.user and r[1] <= g.at]
        assert g.found == (str(max(past, key=lambda r: (r[1], r[2]))[2]) if past else None)


def test_index_percentile_is_a_position_not_an_interpolation(spark):
    rnd = random.Random(12)
    values = {"hot": [rnd.choice([1.5, 2.0, 7.25, 100.0]) for _ in range(101)], "one": [3.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = index_percentiles(df, ["k"], "v", {f"p{p}": percent_rank_at(p) for p in (25, 50, 90, 100)}).collect()
    for g in got:
        s = sorted(values[g.k])
        for p in (25, 50, 90, 100):
            assert g[f"p{p}"] == s[min(int(len(s) * p / 100), len(s) - 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sequence_context_is_one_scan_and_equals_a_fold(spark, tmp_path, seed):
    """Days of one row make the task of two segments ago lie one or two days back; nothing is checkpointed between the two look-backs."""
    rnd = random.Random(seed)
    data = [(rnd.choice("ppqr"), T0 + timedelta(hours=rnd.choice([3, 12, 40]) * rnd.randint(0, 60)), i, rnd.choice(["x", "y", None])) for i in range(120)]
    spark.createDataFrame(data, "session_id string, start_time timestamp, segment_id long, generic_task string").write.parquet(str(tmp_path / "in"))
    got = features.sequence_context(spark.read.parquet(str(tmp_path / "in")))
    want = []
    for session in "pqr":
        tasks = []
        for _, _, i, task in sorted((r for r in data if r[0] == session), key=lambda r: r[1:3]):
            want.append((i, tasks[-1] if tasks else None, len(tasks), len(tasks) > 1 and task is not None and tasks[-2] == task))
            tasks.append(task)
    assert sorted((r.segment_id, r.previous_task, r.position, r.is_task_return) for r in got.collect()) == sorted(want)
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
