"""Day-to-day trends and weekly baselines over daily summaries.

One row per user and calendar day: windows over a user's days are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def _days() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("daynum")


def numbered(daily: DataFrame) -> DataFrame:
    return daily.withColumn("daynum", F.datediff("day", F.lit("1970-01-01").cast("date")))


def day_deltas(daily: DataFrame) -> DataFrame:
    """Change against the calendar day before; null when that day has no row."""
    d = numbered(daily)
    names = ["focus_ratio", "total_active_seconds", "fragmentation_index", "input_density"]
    is_next = F.lag("daynum").over(_days()) == F.col("daynum") - 1
    prev = {n: F.when(is_next, F.lag(n).over(_days())) for n in names}
    diff = lambda n: F.col(n) - prev[n]
    return d.withColumns({
        "focus_ratio_delta": diff("focus_ratio"),
        "active_time_delta": diff("total_active_seconds"),
        "fragmentation_delta": F.when(prev["fragmentation_index"] > 0, diff("fragmentation_index")),
        "input_density_delta": F.when(prev["input_density"] > 0, diff("input_density")),
    }).drop("daynum")


def against_week(daily: DataFrame) -> DataFrame:
    """Percent difference to the mean of the six calendar days before."""
    w = _days().rangeBetween(-6, -1)

    def pct(name: str) -> Column:
        base = F.avg(name).over(w)
        return F.when(base > 0, (F.col(name) - base) / base * 100.0)

    return numbered(daily).withColumns({
        "focus_ratio_vs_7day_pct": pct("focus_ratio"), "active_time_vs_7day_pct": pct("total_active_seconds"),
        "fragmentation_vs_7day_pct": pct("fragmentation_index"), "input_density_vs_7day_pct": pct("input_density"),
    }).drop("daynum")


def volatility_label(value: Column, rows: int = 7) -> Column:
    """Coefficient of variation (sample deviation) of the last rows as low / moderate / high."""
    w = _days().rowsBetween(-(rows - 1), 0)
    mean = F.avg(value).over(w)
    cv = F.when(mean > 0, F.stddev_samp(value).over(w) / mean * 100.0).otherwise(0.0)
    return F.when(F.count(value).over(w) <= 1, "unknown").when(cv < 15, "low").when(cv < 35, "moderate").otherwise("high")


def volatility(daily: DataFrame) -> DataFrame:
    return numbered(daily).withColumns({
        "session_duration_volatility": volatility_label(F.when(F.col("avg_session_seconds") > 0, F.col("avg_session_seconds"))),
        "focus_volatility": volatility_label(F.col("focus_ratio")),
        "active_time_volatility": volatility_label(F.col("total_active_seconds")),
    }).drop("daynum")


def pattern_flags(daily: DataFrame) -> DataFrame:
    """Text flags over the last rows of a user, today included, joined with '; '."""

    def three(name: str) -> tuple[Column, Column]:
        a, b, c = F.lag(name, 2).over(_days()), F.lag(name, 1).over(_days()), F.col(name)
        return (a < b) & (b < c), (a > b) & (b > c)

    def last_three(cond: Column) -> Column:
        w = _days().rowsBetween(-2, 0)
        return (F.count(F.lit(1)).over(w) == 3) & (F.sum(F.when(cond, 1).otherwise(0)).over(w) == 3)

    week = _days().rowsBetween(-6, 0)
    many = lambda cond: (F.count(F.lit(1)).over(week) >= 5) & (F.sum(F.when(cond, 1).otherwise(0)).over(week) >= 2)
    frag, focus, density = three("fragmentation_index"), three("focus_ratio"), three("input_density")
    notes = [
        (frag[0], "Fragmentation increasing for 3+ consecutive days"),
        (frag[1], "Fragmentation decreasing for 3+ consecutive days"),
        (focus[0], "Focus ratio improving for 3+ consecutive days"),
        (focus[1], "Focus ratio declining for 3+ consecutive days"),
        (last_three(F.col("session_count") < 4), "Consistently few sessions (low fragmentation)"),
        (last_three(F.col("session_count") > 8), "Consistently many sessions (high fragmentation)"),
        (density[0], "Input density increasing for 3+ days"),
        (density[1], "Input density decreasing for 3+ days"),
        (many(F.col("total_active_seconds") < 3600), "Multiple very low-activity days"),
        (many(F.col("total_active_seconds") > 28800), "Multiple high-activity days"),
    ]
    text = F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in notes])
    return numbered(daily).withColumn("patterns", text).drop("daynum")


def trend_metrics(daily: DataFrame) -> DataFrame:
    """All trend columns; the windows share one sort of a user's days."""
    return pattern_flags(volatility(against_week(day_deltas(daily))))


WEEK_METRICS = {
    "active_time": "total_active_seconds", "avg_session": "avg_session_seconds", "focus_ratio": "focus_ratio",
    "fragmentation": "fragmentation_index", "input_density": "input_density",
}


def weekly_baseline(daily: DataFrame) -> DataFrame:
    """Mean and sample deviation of the seven calendar days before (0.0 for a single day)."""
    w = _days().rangeBetween(-7, -1)
    n = F.count(F.lit(1)).over(w)
    cols = {"baseline_days": n}
    for name, col in WEEK_METRICS.items():
        cols[f"{name}_mean"] = F.avg(col).over(w)
        cols[f"{name}_std"] = F.when(n == 1, 0.0).otherwise(F.stddev_samp(col).over(w))
    return numbered(daily).withColumns(cols).drop("daynum")


def deviations(daily: DataFrame, threshold: float = 1.8) -> DataFrame:
    """Z scores against the weekly baseline and the notes they give."""
    base = weekly_baseline(daily)
    z = {}
    for name in ("active_time", "focus_ratio", "fragmentation", "input_density"):
        std = F.col(f"{name}_std")
        z[name] = F.when(std > 0, (F.col(WEEK_METRICS[name]) - F.col(f"{name}_mean")) / std)
    base = base.withColumns({f"{n}_z": e for n, e in z.items()})
    notes = [
        F.when(F.abs(f"{n}_z") >= threshold, F.concat(F.lit(n), F.when(F.col(f"{n}_z") > 0, " above").otherwise(" below")))
        for n in z
    ]
    spike = F.when((F.col("input_density_z") > 1.8) & (F.col("active_time_z") < 1.0), F.lit("input spike without active time"))
    return base.withColumn("notes", F.concat_ws("; ", *notes, spike))


def stable_patterns(daily: DataFrame, app_days: DataFrame) -> DataFrame:
    """Per user and day, patterns that hold over the last seven days, today included.

    Every day row is handed to the (at most seven) days whose week contains it, so the week is an
    equi-join on (user, day) and not a join of a user's days with each other.
    """
    base = weekly_baseline(daily).select(
        "user_id", "day", "avg_session_mean", "avg_session_std", "focus_ratio_mean", "focus_ratio_std")
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(F.col("day"), i)))
    spread = daily.select("user_id", ahead.alias("target"), "avg_session_seconds", "focus_ratio")
    joined = spread.join(base.withColumnRenamed("day", "target"), ["user_id", "target"])
    s, f = F.col("avg_session_seconds"), F.col("focus_ratio")
    low = lambda v, n: F.sum(F.when(v < F.col(f"{n}_mean") - F.col(f"{n}_std"), 1).otherwise(0))
    high = lambda v, n: F.sum(F.when(v > F.col(f"{n}_mean") + F.col(f"{n}_std"), 1).otherwise(0))
    week = joined.groupBy("user_id", "target").agg(
        F.count(F.lit(1)).alias("recent_days"), low(s, "avg_session").alias("shorter_days"), high(s, "avg_session").alias("longer_days"),
        high(f, "focus_ratio").alias("high_focus_days"), low(f, "focus_ratio").alias("low_focus_days"),
    )
    app_week = (
        app_days.select("user_id", ahead.alias("target"), "app", "app_seconds")
        .join(daily.select("user_id", F.col("day").alias("target")), ["user_id", "target"])
        .groupBy("user_id", "target", "app").agg(F.sum("app_seconds").alias("secs"))
    )
    share = F.col("secs") / F.sum("secs").over(Window.partitionBy("user_id", "target")) * 100.0
    top = (
        # a share of one half is one half in whatever order the parts were added
        app_week.withColumn("pct", share).filter("pct >= 50.0 - 1e-9").groupBy("user_id", "target")
        .agg(F.min_by("app", F.struct(-F.round("pct", 6), "app")).alias("dominant_app"), F.max("pct").alias("dominant_pct"))
    )
    f0, f1, f2, f3 = F.col("fragmentation_index"), *[F.lag("fragmentation_index", i).over(_days()) for i in (1, 2, 3)]
    run_start = F.when((f3 < f2) & (f2 < f1) & (f1 < f0), F.lag("daynum", 3).over(_days()))
    rising = numbered(daily).withColumn("__run", run_start).select(
        "user_id", F.col("day").alias("target"),
        F.coalesce(F.max("__run").over(_days().rangeBetween(-6, 0)) >= F.col("daynum") - 6, F.lit(False)).alias("fragmentation_rising"),
    )
    return (
        week.join(top, ["user_id", "target"], "left").join(rising, ["user_id", "target"])
        .withColumn("patterns", F.concat_ws("; ",
            F.when(F.col("dominant_app").isNotNull(), F.concat("dominant_app", F.lit(" dominates"))),
            F.when(F.col("shorter_days") >= 4, "shorter sessions"), F.when(F.col("longer_days") >= 4, "longer sessions"),
            F.when(F.col("high_focus_days") >= 4, "higher focus"), F.when(F.col("low_focus_days") >= 4, "lower focus"),
            F.when(F.col("fragmentation_rising"), "rising fragmentation")))
        .withColumnRenamed("target", "day")
    )
