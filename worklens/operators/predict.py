"""Completion estimates, risks and bottlenecks from baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring

MIN_TASK_SESSIONS = 3
MIN_HOUR_SESSIONS = 2
WORKDAY_MINUTES = 384.0


def _task_side(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Baselines with enough history."""
    return tasks.filter(F.col("session_count") >= MIN_TASK_SESSIONS).select(
        *keys, F.col("session_count").alias("n"), "duration_mean_minutes", "duration_std_minutes", "continuity_mean")


def _hour_side(hours: DataFrame) -> DataFrame:
    """At most 24 rows: broadcast."""
    rows = hours.filter(F.col("session_count") >= MIN_HOUR_SESSIONS).select(
        "hour", F.col("avg_focus_continuity").alias("hour_continuity"), F.col("session_count").alias("hour_sessions"))
    return F.broadcast(rows)


def completion_estimates(current: DataFrame, tasks: DataFrame, hours: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes left for running tasks. ``current`` has the task keys, elapsed_minutes, hour
    and now; elapsed 0 gives the estimate at assignment."""
    rows = current.join(_task_side(tasks, keys), keys).join(_hour_side(hours), "hour", "left")
    adjust = F.col("hour_continuity").isNotNull() & (F.col("continuity_mean") > 0)
    factor = F.when(adjust, F.col("continuity_mean") / F.greatest(F.col("hour_continuity"), F.lit(0.1))).otherwise(1.0)
    mean, std = F.col("duration_mean_minutes"), F.col("duration_std_minutes")
    confidence = F.least(F.col("n") / 10.0, F.lit(1.0)) / (1.0 + std / F.greatest(mean, F.lit(1.0)))
    left = F.greatest(F.lit(0.0), mean * F.col("time_factor") - F.col("elapsed_minutes"))
    reason = F.concat(
        F.lit("Based on "), F.col("n").cast("string"), F.lit(" historical sessions"),
        F.when(F.col("time_factor") != 1.0, ", adjusted for time-of-day productivity").otherwise(""))
    return (
        rows.withColumn("time_factor", factor)
        .withColumns({"minutes_remaining": left, "confidence": confidence, "reason": reason})
        .withColumn("completion_time", F.when(F.col("minutes_remaining") > 0,
                    F.timestamp_micros(F.unix_micros("now") + (F.col("minutes_remaining") * 60).cast("long") * 1_000_000)))
        .select(*current.columns, "time_factor", "minutes_remaining", "confidence", "reason", "completion_time")
    )


def daily_workload(planned: DataFrame, tasks: DataFrame, keys: list[str], plan: list[str]) -> DataFrame:
    """Minutes needed per plan; tasks without enough history are counted apart."""
    rows = planned.join(_task_side(tasks, keys), keys, "left")
    known = F.col("n").isNotNull()
    total = F.coalesce(F.sum("duration_mean_minutes"), F.lit(0.0))
    return rows.groupBy(*plan).agg(
        total.alias("total_minutes"), F.sum(F.when(known, 1).otherwise(0)).alias("estimated_tasks"),
        F.sum(F.when(known, 0).otherwise(1)).alias("insufficient_tasks"),
        (total <= WORKDAY_MINUTES).alias("feasible"), (total / WORKDAY_MINUTES).alias("utilization"),
    )


def task_risks(current: DataFrame, tasks: DataFrame, typical: DataFrame, keys: list[str]) -> DataFrame:
    """One row per risk. ``current`` has session_id, minutes, focus_continuity, apps;
    ``typical`` has the task keys and the array typical_apps (at most three)."""
    rows = current.join(_task_side(tasks, keys), keys).join(typical, keys, "left")
    std, mean, now = F.col("duration_std_minutes"), F.col("duration_mean_minutes"), F.col("minutes")
    z = F.when((std > 0) & (now > 0), F.abs(now - mean) / std)
    overlap = F.size(F.array_intersect("apps", "typical_apps")) / F.greatest(F.size("apps"), F.lit(1))
    rows = rows.withColumns({"z": z, "overlap": F.when((F.size("apps") > 0) & (F.size("typical_apps") > 0), overlap)})

    def risk(cond: Column, level, category: str, message, score: Column) -> Column:
        wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(cond, F.struct(wrap(level).alias("risk_level"), F.lit(category).alias("category"), wrap(message).alias("message"), score.cast("double").alias("evidence")))

    found = F.array_compact(F.array(
        risk(F.col("z") > 2.0, F.when(F.col("z") < 3.0, "medium").otherwise("high"), "anomaly",
             F.concat(F.lit("Task duration "), F.when(now > mean, "longer").otherwise("shorter"), F.lit(" than usual")), F.col("z")),
        risk((F.col("continuity_mean") > 0) & (F.col("focus_continuity") < F.col("continuity_mean") * 0.7), "medium", "degradation",
             "Focus continuity degraded", (1.0 - F.col("focus_continuity") / F.col("continuity_mean")) * 100.0),
        risk(F.col("overlap") < 0.3, "low", "anomaly", "Using unusual apps for this task", F.col("overlap")),
    ))
    return rows.select(*keys, "session_id", F.explode(found).alias("r")).select(*keys, "session_id", "r.*")


def schedule_risks(current: DataFrame, hours: DataFrame, low_focus: float = 0.5) -> DataFrame:
    """Sessions running in an hour whose mean continuity is below ``low_focus``."""
    rows = current.join(_hour_side(hours), "hour").filter(F.col("hour_continuity") < low_focus)
    return rows.select(
        "session_id", "hour", F.lit("low").alias("risk_level"), F.lit("schedule").alias("category"),
        F.concat(F.lit("Hour "), F.col("hour").cast("string"), F.lit(" historically has low focus")).alias("message"),
        F.col("hour_continuity").alias("evidence"))


def stuck_tasks(task_log: DataFrame, keys: list[str], now: Column, stall_hours: float = 24.0) -> DataFrame:
    """Tasks last seen ACTIVE whose latest activity is more than ``stall_hours`` ago."""
    last = task_log.groupBy(*keys).agg(
        F.max("ts").alias("last_activity"), F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    hours = scoring.seconds_between("last_activity", now) / 3600.0
    return (
        last.filter("state in ('ACTIVE', 'IN_PROGRESS')").withColumn("hours_since", hours).filter(F.col("hours_since") > stall_hours)
        .withColumn("severity", F.when(F.col("hours_since") < 48, "medium").otherwise("high"))
        .withColumn("type", F.lit("stuck_task"))
    )


def systemic_bottlenecks(recent: DataFrame, hours: DataFrame) -> DataFrame:
    """Hours with three or more recent sessions whose mean continuity is 30 % below the baseline."""
    by_hour = recent.groupBy("hour").agg(F.count(F.lit(1)).alias("recent_sessions"), F.avg("focus_continuity").alias("recent_continuity"))
    rows = by_hour.filter("recent_sessions >= 3").join(_hour_side(hours), "hour")
    return rows.filter(F.col("recent_continuity") < F.col("hour_continuity") * 0.7).select(
        F.concat(F.lit("systemic-hour-"), F.col("hour").cast("string")).alias("bottleneck_id"), F.lit("systemic_time").alias("type"),
        F.lit("medium").alias("severity"), "hour", "recent_sessions", "recent_continuity", F.col("hour_continuity").alias("baseline_continuity"))


def alerts(task_risk: DataFrame, schedule: DataFrame, stuck: DataFrame) -> DataFrame:
    """High or critical task risks, every schedule risk, every bottleneck."""
    a = task_risk.filter("risk_level in ('high', 'critical')").select(F.lit("risk").alias("type"), F.col("risk_level").alias("level"), F.col("session_id").alias("subject"), "message")
    b = schedule.select(F.lit("schedule").alias("type"), F.col("risk_level").alias("level"), F.col("session_id").alias("subject"), "message")
    c = stuck.select(F.lit("bottleneck").alias("type"), F.col("severity").alias("level"),
                     F.concat_ws("-", F.lit("stuck"), F.col("user_id").cast("string"), "task_id").alias("subject"), F.lit("No recent activity").alias("message"))
    return a.unionByName(b).unionByName(c)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key (30 predictions, 50 risks)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") <= n)
