"""Writers of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, ts: str | None = None) -> None:
    """Append rows; with ``ts`` the table is partitioned by date,
    and the rows of a date are first brought together so that a date gets few files."""
    if ts is None:
        df.write.mode("append").parquet(path)
        return
    dated = df.withColumn("date", F.to_date(ts))
    dated.repartition("date", F.pmod(F.xxhash64(ts), F.lit(32))).write.mode("append").partitionBy("date").parquet(path)


def log_state_changes(changes: DataFrame, path: str) -> None:
    """session_id, ts and state of every change, by date."""
    append(changes.select("session_id", "ts", "state"), path, "ts")


def save_snapshots(reports: DataFrame, path: str, start: Column, end: Column) -> None:
    """One row per report with its time, the covered period and the whole report as JSON."""
    rest = [c for c in reports.columns if c != "ts"]
    append(reports.select("ts", start.alias("start_time"), end.alias("end_time"), F.to_json(F.struct(*rest)).alias("payload")), path, "ts")


def log_live_predictions(predictions: DataFrame, path: str) -> None:
    """One row per prediction; the feature vector and the alternatives as JSON."""
    text = {"feature_vector": F.to_json("feature_vector"), "alternative_tasks": F.to_json("alternative_tasks")}
    names = ["ts", "session_id", "task_id", "confidence", "distance_to_centroid", "reason", "feature_window_seconds", *text]
    append(predictions.withColumns(text).select(*names), path, "ts")


def with_raw_json(df: DataFrame) -> DataFrame:
    """The whole row as JSON beside its columns."""
    return df.withColumn("raw_json", F.to_json(F.struct("*")))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Full-row replace: the newest row of each key over stored and changed rows."""
    both = stored.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def replace_by_key(stored: DataFrame, fresh: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """All rows of the keys in ``fresh`` are replaced; fresh rows without a required column are
    dropped, but their keys are cleared all the same."""
    cleared = stored.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return cleared.unionByName(fresh.na.drop(subset=required))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not deleted; apply to the session table and to its child tables."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    """A25 / A26."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A26."""
    df.write.mode("overwrite").option("header", True).csv(path)
