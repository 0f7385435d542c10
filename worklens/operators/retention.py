"""Retention, validation, repair and migration of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import scoring

# fixed values: days kept per table
KEEP_DAYS = {"intervals": 90, "enriched_tasks": 90, "events": 90, "snapshots": 30, "live_predictions": 7}


def split_by_age(df: DataFrame, ts: Column, now: Column, days: int) -> DataFrame:
    """Marks rows older than the cut-off (strictly) as not kept."""
    return df.withColumn("kept", ~F.coalesce(ts < now - F.make_dt_interval(F.lit(days)), F.lit(False)))


def retention_counts(df: DataFrame, ts: Column, now: Column, days: int, name: str) -> DataFrame:
    marked = split_by_age(df, ts, now, days)
    return marked.agg(F.lit(name).alias("table"), F.count_if(~F.col("kept")).alias("deleted"), F.count_if("kept").alias("kept"))


def stale_sessions(sessions: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Action per session. Sessions without an end and sessions in progress are kept, ended
    ones older than the cut-off go to the archive."""
    old = F.col("end_time") < now - F.make_dt_interval(F.lit(days))
    action = F.when(F.col("end_time").isNotNull() & old & (F.col("in_progress") == F.lit(False)), "archive").otherwise("keep")
    return sessions.withColumn("action", action)


def stale_session_stats(marked: DataFrame) -> DataFrame:
    kept = F.col("action") == "keep"
    return marked.agg(
        F.count_if(~kept).alias("deleted_count"), F.count_if(~kept).alias("archived_count"), F.count_if(kept).alias("kept_count"),
        F.min(F.when(kept, F.col("end_time"))).alias("oldest_kept"), F.max(F.when(~kept, F.col("end_time"))).alias("newest_deleted"))


def validate_sessions(raw: DataFrame) -> DataFrame:
    """Verdict per session out of text columns id, start, end, device_id. The first broken rule
    is reported; a session longer than a day is valid with a warning."""
    start, end = F.try_to_timestamp("start"), F.try_to_timestamp("end")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) == "") for c in ("id", "start", "end", "device_id")])
    error = (
        F.when(missing, "missing fields").when(start.isNull() | end.isNull(), "invalid datetime").when(start > end, "start > end")
    )
    rows = raw.withColumns({"error": error, "hours": scoring.seconds_between(start, end) / 3600.0})
    return rows.withColumns({"valid": F.col("error").isNull(), "warning": F.when(F.col("error").isNull() & (F.col("hours") > 24), "unusually long")}).drop("hours")


def repair_sessions(raw: DataFrame) -> DataFrame:
    """Device defaults to 'unknown', reversed times are swapped, rows without readable times are
    marked as removed; ``repairs`` counts what was done to a row."""
    start, end = F.try_to_timestamp("start"), F.try_to_timestamp("end")
    no_device = F.col("device_id").isNull() | (F.col("device_id") == "")
    removed = start.isNull() | end.isNull()
    return raw.select(
        "id", F.when(no_device, "unknown").otherwise(F.col("device_id")).alias("device_id"), F.least(start, end).alias("start_time"), F.greatest(start, end).alias("end_time"),
        removed.alias("removed"), (no_device.cast("int") + F.when(~removed & (start > end), 1).otherwise(0)).alias("repairs"))


# fixed values: columns of the first schema that the second one drops
DROPPED_COLUMNS = ["apps", "event_count", "input_events", "timeline", "intent_breakdown"]


def migrate_sessions(v1: DataFrame, version: str = "2.0") -> DataFrame:
    """First schema to second: drop five columns, stamp the version."""
    return v1.drop(*DROPPED_COLUMNS).withColumn("schema_version", F.lit(version))


def read_compatible(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Rows of both schemas in the second one; columns missing on a side are NULL."""
    return migrate_sessions(v1).unionByName(v2, allowMissingColumns=True)


def maintain(raw: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Migrate, validate, repair, then retention: the rows that stay, with their verdicts."""
    checked = validate_sessions(migrate_sessions(raw)).select("id", "valid")
    fixed = repair_sessions(raw).filter(~F.col("removed")).join(checked, "id", "left").withColumn("in_progress", F.lit(False))
    return stale_sessions(fixed, now, days)
