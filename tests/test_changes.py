"""Stored tables follow their source, and streams do not depend on the cut into micro-batches."""

import __spark_entry__ as entry
import pytest
from worklens import session
from worklens.session import shared_folder
from worklens.streaming import jobs

SF = "/root/testdata/sf0.001"


def split_events(spark, folder, files):
    """The events dealt over ``files`` files, the newest first."""
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    events.sort(key=lambda r: r.ts, reverse=True)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    step = -(-len(events) // files)
    for k in range(files):
        spark.createDataFrame(events[k * step : (k + 1) * step], schema).coalesce(1).write.parquet(f"{folder}/part{k}")
    parts = sorted(p for k in range(files) for p in (folder / f"part{k}").glob("*.parquet"))
    (folder / "in").mkdir()
    for k, p in enumerate(parts):
        (folder / "in" / f"events{k}.parquet").write_bytes(p.read_bytes())
    return str(folder / "in")


@pytest.mark.parametrize("name", ["session_classes", "daily_summary", "recognized_tasks"])
def test_stored_tables_follow_their_source(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    query = entry.queries()[name]
    before = query(spark, str(tmp_path)).collect()
    assert sorted(map(str, before)) == sorted(map(str, query(spark, str(tmp_path)).collect()))
    events.filter("event_id % 2 = 0").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    after = query(spark, str(tmp_path)).collect()
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/other/events.parquet")
    assert sorted(map(str, after)) == sorted(map(str, query(spark, f"{tmp_path}/other").collect()))
    assert sorted(map(str, after)) != sorted(map(str, before))


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_periodic_report_does_not_depend_on_the_batches(spark, tmp_path):
    want = sorted(map(tuple, jobs.periodic_report(spark, SF, 7200).collect()))
    assert len(want) == 24
    for files in (2, 5):
        folder = tmp_path / str(files)
        folder.mkdir()
        cut = split_events(spark, folder, files)
        got = sorted(map(tuple, jobs.periodic_report(spark, cut, 7200, files_per_trigger=1).collect()))
        assert [[round(float(x), 9) for x in r] for r in got] == [[round(float(x), 9) for x in r] for r in want]


def test_task_moments_and_live_scores_do_not_depend_on_the_batches(spark, tmp_path):
    cut = split_events(spark, tmp_path, 3)
    rows = lambda df: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()])
    assert rows(jobs.run_complete(jobs.task_moments(jobs.event_stream(spark, cut, 1)))) == rows(jobs.run_complete(jobs.task_moments(jobs.event_stream(spark, SF))))
    predict = lambda batch: batch.select("event_id", "k")
    assert rows(jobs.live_scores(spark, cut, predict, 1)) == rows(jobs.live_scores(spark, SF, predict))


def test_stored_tables_are_built_with_shuffles_in_proportion_to_their_source(spark, tmp_path, monkeypatch):
    """So that one task does not hold more of a larger input."""
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen = [spark.conf.get(n) for n in names], []

    def build():
        seen.extend(int(spark.conf.get(n)) for n in names)
        return spark.range(1)

    monkeypatch.setattr(session, "SHARE", 1000)
    session.stored(spark, str(tmp_path), "sized", build)
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").iterdir() if f.name.startswith(("part-", "_SUCCESS")))
    assert seen == [-(-size // 1000), session.TASK_BYTES] and seen[0] > int(before[0])
    assert [spark.conf.get(n) for n in names] == before
