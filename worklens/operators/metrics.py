"""Metric graphs: window comparisons, daily series, moving averages, and input intensity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Metric:
    """What a graph shows: a column of a table and how it is aggregated (mean, sum or count)."""

    name: str
    column: str
    aggregation: str = "mean"

    def expr(self, value: Column | None = None) -> Column:
        return {"mean": F.avg, "sum": F.sum, "count": F.count}[self.aggregation](value if value is not None else F.col(self.column))


def daily_series(df: DataFrame, metric: Metric, ts: str, start: Column, end: Column, keys: list[str] | None = None) -> DataFrame:
    """One value per day that has rows, over a half-open period."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end)).groupBy(*(keys or []), F.to_date(ts).alias("day")).agg(metric.expr().alias("value"))


def window_value(df: DataFrame, metric: Metric, ts: str, start: Column, end: Column, keys: list[str] | None = None) -> DataFrame:
    """One value over a half-open period."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end)).groupBy(*(keys or [])).agg(metric.expr().alias("value"))


def moving_average(points: DataFrame, keys: list[str], order: str, window: int) -> DataFrame:
    """Trailing mean over the points that exist, NULL counted as 0, shorter at the start. Points
    are one row per day."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return points.withColumn("value", F.avg(F.coalesce("value", F.lit(0.0))).over(w))


def centred_average(points: DataFrame, keys: list[str], order: str, width: int, value: str, out: str) -> DataFrame:
    """Centred mean with a fixed divisor; missing neighbours at the edges count as 0."""
    left = width // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-left, width - 1 - left)
    return points.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w) / float(width))


def against_previous(df: DataFrame, metric: Metric, ts: str, now: Column, days: int, keys: list[str]) -> DataFrame:
    """This window against the one before, in one scan."""
    span = F.make_dt_interval(F.lit(days))
    this, before = now - span, now - span - span
    rows = df.filter((F.col(ts) >= before) & (F.col(ts) < now))
    value = F.col(metric.column)
    both = rows.groupBy(*keys).agg(
        metric.expr(F.when(F.col(ts) >= this, value)).alias("current"), metric.expr(F.when(F.col(ts) < this, value)).alias("baseline"))
    delta = F.when(F.col("baseline") != 0, F.bround((F.col("current") - F.col("baseline")) / F.abs("baseline") * 100.0, 2))
    raw = F.when(F.col("baseline") != 0, F.col("current") - F.col("baseline"))
    return both.withColumns({
        "delta_percent": delta, "significance": F.when(raw > 0, "increase").when(raw < 0, "decrease").otherwise("no_change")})


def against_long_term(df: DataFrame, metric: Metric, ts: str, now: Column, days: int, keys: list[str], long_days: int = 90) -> DataFrame:
    """This window against the mean and population deviation of the daily values before it."""
    this = now - F.make_dt_interval(F.lit(days))
    first = this - F.make_dt_interval(F.lit(long_days))
    past = daily_series(df, metric, ts, first, this, keys).groupBy(*keys).agg(F.avg("value").alias("long_mean"), F.stddev_pop("value").alias("long_std"))
    current = window_value(df, metric, ts, this, now, keys).withColumnRenamed("value", "current")
    z = F.when(F.col("long_std") != 0, F.bround((F.col("current") - F.col("long_mean")) / F.col("long_std"), 3))
    return current.join(past, keys, "full").withColumn("z_score", z)


# fixed values: five-minute baselines and weights per preset (keys, clicks, mouse, app changes)
PRESETS = {
    "DEFAULT": ([35.0, 6.0, 300.0, 1.5], [0.45, 0.20, 0.25, 0.10]),
    "ACTIVE": ([55.0, 10.0, 500.0, 2.0], [0.50, 0.20, 0.20, 0.10]),
    "HYBRID": ([30.0, 6.0, 350.0, 1.5], [0.40, 0.20, 0.30, 0.10]),
    "PASSIVE": ([12.0, 3.0, 120.0, 0.8], [0.25, 0.20, 0.35, 0.20]),
}


def intensity_share(keys: Column, clicks: Column, mouse: Column, app_changes: Column, seconds: float, preset: str = "DEFAULT") -> Column:
    """Weighted share of the preset's baselines, each capped at 1, for a window of ``seconds``."""
    base, weight = PRESETS.get(preset.upper(), PRESETS["DEFAULT"])
    scale = max(1.0, seconds / 60.0) / 5.0
    parts = [F.least(F.lit(1.0), v / F.lit(b * scale)) * F.lit(w) for v, b, w in zip((keys, clicks, mouse, app_changes), base, weight)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def intensity(keys: Column, clicks: Column, mouse: Column, app_changes: Column, seconds: float, preset: str = "DEFAULT") -> Column:
    # first to nine places, so that halves fall alike in whatever order the distances were added
    return F.bround(F.round(intensity_share(keys, clicks, mouse, app_changes, seconds, preset) * 100.0, 9), 1)
