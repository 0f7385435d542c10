"""Behavioural baselines per task, per hour of day and over all sessions.

``sessions`` needs task_id, start_time, minutes, input_per_minute, entropy, focus_continuity, class
and apps (see ``daily.with_class``). The studied system keeps random reservoirs of 50 and 1000 values
for its percentiles; here the percentiles are exact over all rows, which is the same below the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions.stats import index_percentiles, mode_of, percent_rank_at


def sample_std(c: str) -> Column:
    """0.0 below two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def task_baselines(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded as the reports show them."""
    base = sessions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.bround(F.avg("minutes"), 2).alias("duration_mean_minutes"), F.bround(sample_std("minutes"), 2).alias("duration_std_minutes"),
        F.bround(F.avg("input_per_minute"), 2).alias("input_intensity_mean"), F.bround(F.avg("entropy"), 3).alias("entropy_mean"),
        F.bround(F.avg("focus_continuity"), 3).alias("continuity_mean"),
        F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_updated"),
    )
    ranks = index_percentiles(sessions, keys, "input_per_minute", {"p50": percent_rank_at(50), "p90": percent_rank_at(90)})
    return base.join(ranks.select(*keys, F.bround("p50", 2).alias("intensity_p50"), F.bround("p90", 2).alias("intensity_p90")), keys)


def typical_apps(sessions: DataFrame, keys: list[str], top_n: int = 3) -> DataFrame:
    """Apps of a task by the number of sessions that use them."""
    counts = sessions.select(*keys, F.explode("apps").alias("app")).groupBy(*keys, "app").agg(F.count(F.lit(1)).alias("sessions"))
    w = Window.partitionBy(*keys).orderBy(F.desc("sessions"), "app")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def hour_baselines(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per start hour."""
    keys = keys or []
    rows = sessions.withColumn("hour", F.hour("start_time"))
    base = rows.groupBy(*keys, "hour").agg(
        F.count(F.lit(1)).alias("session_count"), F.bround(F.avg("minutes"), 2).alias("avg_duration_minutes"),
        F.bround(sample_std("minutes"), 2).alias("duration_std_minutes"), F.bround(F.avg("input_per_minute"), 2).alias("avg_input_intensity"),
        F.bround(F.avg("focus_continuity"), 3).alias("avg_focus_continuity"),
    )
    top = mode_of(rows, [*keys, "hour"], "class", F.struct("start_time", "session_id"), "dominant_classification")
    return base.join(top, [*keys, "hour"])


def quality_distribution(sessions: DataFrame) -> DataFrame:
    """Duration moments and percentiles, mean scores and class counts over all sessions."""
    counts = [F.sum(F.when(F.col("class") == c, 1).otherwise(0)).alias(c.replace("-", "_") + "_sessions") for c in ("focused", "passive", "mixed", "idle-heavy")]
    one = sessions.withColumn("__all", F.lit(0))
    base = one.groupBy("__all").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.bround(F.avg("minutes"), 2).alias("duration_mean_minutes"),
        F.bround(sample_std("minutes"), 2).alias("duration_std_minutes"), F.bround(F.avg("input_per_minute"), 2).alias("avg_input_intensity"),
        F.bround(F.avg("entropy"), 3).alias("avg_entropy"), F.bround(F.avg("focus_continuity"), 3).alias("avg_continuity"), *counts,
    )
    ranks = index_percentiles(one, ["__all"], "minutes", {f"p{p}": percent_rank_at(p) for p in (25, 50, 75, 95)})
    return base.join(ranks.select("__all", *[F.bround(f"p{p}", 2).alias(f"p{p}") for p in (25, 50, 75, 95)]), "__all").drop("__all")


def best_hours(hours: DataFrame, top_n: int = 3) -> DataFrame:
    """Hours with the highest mean continuity."""
    return hours.orderBy(F.desc("avg_focus_continuity"), "hour").limit(top_n)


def productivity_level(continuity: Column) -> Column:
    """H34."""
    return F.when(continuity > 0.7, "high").when(continuity > 0.5, "medium").otherwise("low")


def session_breakdown(sessions: DataFrame) -> DataFrame:
    """Sessions and mean minutes in total, per start hour, per device and per date, in one pass
    with grouping sets."""
    rows = sessions.select(
        F.hour("start_time").cast("string").alias("hour"), "device_id", F.to_date("start_time").cast("string").alias("date"), "minutes")
    sets = rows.groupingSets([["hour"], ["device_id"], ["date"], []], "hour", "device_id", "date").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("sessions"), F.avg("minutes").alias("avg_minutes"))
    kind = F.when(F.col("g") == 3, "hour").when(F.col("g") == 5, "device").when(F.col("g") == 6, "date").otherwise("all")
    return sets.select(kind.alias("kind"), F.coalesce("hour", "device_id", "date", F.lit("all")).alias("value"), "sessions", "avg_minutes")
