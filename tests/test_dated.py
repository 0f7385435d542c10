"""Tables by date: changes write the touched dates only."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

from worklens.sources import dated

T0 = datetime(2024, 3, 1)
SCHEMA = "id long, owner long, ts timestamp, v string, rev long"


def rows(n=400, days=12):
    rng = random.Random(1)
    return [(i, i % 7, T0 + timedelta(days=rng.randrange(days), seconds=rng.randrange(86400)), f"v{i}", 0) for i in range(n)] + [(n, 3, None, "no time", 0)]


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*")}


def held(spark, path):
    return sorted((tuple(r)[:5] for r in dated.read(spark, path).select("id", "owner", "ts", "v", "rev").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    dated.create(spark.createDataFrame(rows(), SCHEMA), str(tmp_path / "t"), "ts")
    return str(tmp_path / "t")


def untouched(before, after, dates):
    names = {f"date={d}" if d else "date=__HIVE_DEFAULT_PARTITION__" for d in dates}
    kept = {f: t for f, t in before.items() if f.split("/")[0] not in names}
    assert kept and kept.items() <= after.items()
    assert {f for f in after if f.split("/")[0] not in names} == set(kept)


def test_upsert_writes_the_touched_dates(spark, table):
    before = files(table)
    moved = (5, 9, T0 + timedelta(days=40), "moved", 2)
    older = (6, 9, T0, "too old", -1)
    changes = [moved, older, (9000, 1, T0 + timedelta(days=2, hours=1), "new", 1)]
    dates = dated.upsert(spark, table, spark.createDataFrame(changes, SCHEMA), ["id"], ["rev"], "ts")
    want = {r[0]: r for r in rows()} | {5: moved, 9000: changes[2]}
    assert held(spark, table) == sorted(want.values(), key=repr)
    where = {rows()[k][2].date() for k in (5, 6)} | {date(2024, 4, 10), date(2024, 3, 1), date(2024, 3, 3)}
    assert set(dates) == where
    untouched(before, files(table), dates)
    again = dated.upsert(spark, table, spark.createDataFrame(changes, SCHEMA), ["id"], ["rev"], "ts")
    assert held(spark, table) == sorted(want.values(), key=repr) and set(again) <= where | {date(2024, 4, 10)}


def test_replace_and_delete_by_key(spark, table):
    before = files(table)
    one = [r for r in rows() if r[0] in (10, 11)]
    fresh = [(10, 5, one[0][2], "fresh", 1), (11, 5, one[1][2], None, 1)]
    dates = dated.replace(spark, table, spark.createDataFrame(fresh, SCHEMA), ["id"], ["v"], "ts")
    want = {r[0]: r for r in rows() if r[0] != 11} | {10: fresh[0]}
    assert held(spark, table) == sorted(want.values(), key=repr)
    untouched(before, files(table), dates)
    before = files(table)
    dates = dated.delete(spark, table, spark.createDataFrame([(20,), (400,), (99999,)], "id long"), ["id"])
    assert held(spark, table) == sorted((r for k, r in want.items() if k not in (20, 400)), key=repr)
    assert None in dates and None not in dated.dates_of(spark, table)  # a date without rows is dropped
    untouched(before, files(table), dates)
    assert dated.delete(spark, table, spark.createDataFrame([(99999,)], "id long"), ["id"]) == []


def test_expire_drops_whole_dates(spark, table):
    before = files(table)
    now = T0 + timedelta(days=20, hours=5)
    dropped, written = dated.expire(spark, table, "ts", now, 15)
    cut = T0 + timedelta(days=5, hours=5)
    assert held(spark, table) == sorted((r for r in rows() if r[2] is None or r[2] >= cut), key=repr)
    assert (dropped, written) == (5, [cut.date()])
    untouched({f: t for f, t in before.items() if "date=2024" not in f or f.split("=")[1][:10] >= str(cut.date())}, files(table), written)
    assert dated.expire(spark, table, "ts", now, 15) == (0, [])
