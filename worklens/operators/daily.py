"""Daily summaries per user out of sessions.

Rows per user and day are few and bounded by the calendar, so plain windows over a user's days are
used; the work before that is partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring
from worklens.functions.sequence import day_chunk, scan_rows

DAY = ["user_id", "day"]


def with_class(sessions: DataFrame) -> DataFrame:
    """H22 class and H23 features of every session."""
    total = F.col("keys") + F.col("clicks")
    d = F.col("duration_seconds")
    minutes = d / 60.0
    return sessions.withColumns({
        "day": F.to_date("start_time"),
        "class": scoring.session_class(d, total, F.col("n_apps")),
        "minutes": minutes,
        "input_per_minute": F.when(d > 0, total / minutes).otherwise(0.0),
        "app_diversity": F.least(F.col("n_apps") / 10.0, F.lit(1.0)),
    }).withColumn("intensity", F.least(F.col("input_per_minute") / 60.0, F.lit(1.0)))


def app_days(sessions: DataFrame) -> DataFrame:
    """Seconds per app and day: a session's time is split equally over its apps."""
    return (
        sessions.select("user_id", F.to_date("start_time").alias("day"), F.explode("apps").alias("app"),
                        (F.col("duration_seconds") / F.col("n_apps")).alias("s"))
        .groupBy(*DAY, "app").agg(F.sum("s").alias("app_seconds"))
    )


def session_apps(intervals: DataFrame) -> DataFrame:
    """One row per session and app with its first use."""
    return intervals.filter("session_id is not null and app is not null").groupBy("user_id", "session_id", "app").agg(
        F.min(F.struct("timestamp_start", "event_id")).alias("first_use")
    )


def switch_entropy(visits: DataFrame) -> DataFrame:
    """Normalised Shannon entropy of the app changes of a day. ``visits`` is one row per session
    and app; apps follow one another by first use, sessions by start."""
    day = F.to_date(F.min("first_use").over(Window.partitionBy("user_id", "session_id"))["timestamp_start"])
    w = Window.partitionBy(*DAY).orderBy("first_use")
    moves = (
        visits.withColumn("day", day).withColumn("next_app", F.lead("app").over(w))
        .filter(F.col("next_app") != F.col("app")).groupBy(*DAY, "app", "next_app").agg(F.count(F.lit(1)).alias("n"))
    )
    return entropy_of(moves, DAY, "n").withColumnRenamed("entropy", "context_switch_entropy")


def entropy_of(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Shannon entropy of counts, divided by log2 of the number of kinds (1 when there is one kind).
    Uses sum(n log2 n), so one aggregation is enough."""
    total, kinds = F.sum(n), F.count(F.lit(1))
    raw = F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total
    scaled = raw / F.when(kinds > 1, F.log2(kinds)).otherwise(1.0)
    return counts.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)).alias("entropy"))


def sustained(sessions: DataFrame) -> DataFrame:
    """D25 continuity, D26 / C18 focus windows and gaps of a day."""
    focused = with_class(sessions).filter(F.col("class") == "focused")
    w = Window.partitionBy(*DAY).orderBy("start_time")
    gaps = focused.withColumn("gap", scoring.minutes_between("end_time", F.lead("start_time").over(w)))
    d, m = F.col("duration_seconds"), F.col("minutes")
    spread = F.stddev_pop(m) / F.avg(m)
    return gaps.groupBy(*DAY).agg(
        F.when(F.sum(d) > 0, F.least(F.lit(1.0), F.sum(F.pow(d, F.lit(1.5))) / F.pow(F.sum(d), F.lit(1.5)))).otherwise(0.0).alias("focus_continuity_score"),
        F.max(m).alias("max_sustained_minutes"), F.avg(m).alias("avg_focus_window_minutes"),
        F.count(F.lit(1)).alias("focus_window_count"),
        F.coalesce(F.max(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("longest_gap_minutes"),
        F.when(F.count(F.lit(1)) < 2, 1.0).when(F.avg(m) > 0, F.least(F.lit(1.0), 1.0 / (1.0 + spread))).otherwise(0.0).alias("focus_consistency"),
    )


def daily_summary(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per user and day."""
    rows = with_class(sessions)
    w = Window.partitionBy(*DAY).orderBy("start_time")
    before = F.lag("apps").over(w)
    rows = rows.withColumn("switched", F.when((F.size(before) > 0) & (before != F.col("apps")), 1).otherwise(0))
    d = F.col("duration_seconds")
    kinds = {f"{c.replace('-', '_')}_sessions": F.sum(F.when(F.col("class") == c, 1).otherwise(0)) for c in ("focused", "passive", "mixed", "idle-heavy")}
    total = F.sum(d)
    hours = F.when(total > 0, total / 3600.0).otherwise(1.0)
    minutes = F.when(total > 0, total / 60.0).otherwise(1.0)
    base = rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("session_count"), total.alias("total_active_seconds"), F.avg(d).alias("avg_session_seconds"),
        F.max(d).alias("longest_session_seconds"), F.sum("keys").alias("total_keys"), F.sum("clicks").alias("total_clicks"),
        F.sum("mouse_distance").alias("total_mouse_distance"), F.sum("switched").alias("app_switch_count"),
        *[e.alias(n) for n, e in kinds.items()],
        F.when(total > 0, F.sum(F.when(F.col("class") == "focused", d).otherwise(0.0)) / total).otherwise(0.0).alias("focus_ratio"),
        (F.count(F.lit(1)) / hours).alias("fragmentation_index"),
        ((F.sum("keys") + F.sum("clicks")) / minutes).alias("input_density"),
        (F.sum("switched") / F.count(F.lit(1))).alias("avg_app_switches_per_session"),
    )
    apps = app_days(sessions).groupBy(*DAY).agg(
        F.min_by("app", F.struct(-F.round("app_seconds", 6), F.col("app"))).alias("most_used_app"),
        F.max("app_seconds").alias("most_used_app_seconds"),
    )
    zero = ["context_switch_entropy", "focus_continuity_score", "max_sustained_minutes", "avg_focus_window_minutes",
            "focus_window_count", "longest_gap_minutes", "focus_consistency"]
    return (
        base.join(apps, DAY, "left").join(switch_entropy(visits), DAY, "left").join(sustained(sessions), DAY, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c == "focus_window_count" else F.coalesce(F.col(c), F.lit(0.0)) for c in zero})
    )


def task_days(intent_segments: DataFrame) -> DataFrame:
    """Seconds and switches per user, day and task. A switch is a segment whose task differs
    from the task of the segment before it in the same session."""
    seen = scan_rows(
        intent_segments, ["user_id", "session_id"], ["start_time", "event_id"], day_chunk("start_time"),
        lag={"__task": F.col("task_id")},
    )
    return seen.groupBy("user_id", F.to_date("start_time").alias("day"), "task_id").agg(
        F.sum(scoring.seconds_between("start_time", "end_time")).alias("seconds"),
        F.sum(F.when(F.col("__task") != F.col("task_id"), 1).otherwise(0)).alias("switches_into"),
    )
