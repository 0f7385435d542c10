"""Scalar scores, durations and calendar columns (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / 60.0


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def interval_minutes() -> Column:
    """Length of the interval in minutes, at least 0.001."""
    return F.greatest(F.lit(0.001), minutes_between("timestamp_start", "timestamp_end"))


def clicks_per_minute() -> Column:
    return F.col("mouse_clicks") / interval_minutes()


def input_score() -> Column:
    keys = F.least(F.col("keyboard_intensity"), F.lit(60.0)) / 60.0
    mouse = F.least(clicks_per_minute(), F.lit(10.0)) / 10.0
    return clamp((keys + mouse) / 2.0)


def system_score() -> Column:
    """Mean of cpu, ram and, when it was measured, gpu."""
    cpu, ram = F.coalesce("cpu_usage", F.lit(0.0)), F.coalesce("ram_usage", F.lit(0.0))
    both = (cpu + ram) / 2.0
    return clamp(F.when(F.col("gpu_usage").isNull(), both).otherwise((cpu + ram + F.col("gpu_usage")) / 3.0))


def audio_context_score() -> Column:
    on = lambda name: F.when(F.col(name), 1.0).otherwise(0.0)
    volume = F.least(F.coalesce("audio_volume", F.lit(0.0)), F.lit(1.0))
    return clamp(1.0 - clamp(0.4 * on("mic_active") + 0.4 * on("camera_active") + 0.2 * volume))


def focus_score() -> Column:
    """.5 input + .3 system + .2 audio context."""
    return clamp(0.5 * input_score() + 0.3 * system_score() + 0.2 * audio_context_score())


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 5) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 17), "afternoon")
        .when((hour >= 17) & (hour < 21), "evening")
        .otherwise("night")
    )


def time_context(ts: Column) -> list[Column]:
    """Part of day, weekday (Monday 0), weekend and work-hour flags."""
    h, d = F.hour(ts), F.weekday(ts)
    return [
        time_of_day(h).alias("time_of_day"),
        d.alias("day_of_week"),
        (d >= 5).alias("is_weekend"),
        ((h >= 9) & (h < 17)).alias("is_work_hours"),
    ]


def session_class(duration_seconds: Column, total_input: Column, n_apps: Column) -> Column:
    """Idle-heavy / focused / passive / mixed; the first rule that holds wins."""
    per_minute = F.when(duration_seconds > 0, total_input / (duration_seconds / 60.0)).otherwise(0.0)
    return (
        F.when((total_input < 5) & (duration_seconds > 300), "idle-heavy")
        .when((n_apps == 1) & (per_minute >= 4), "focused")
        .when(n_apps == 1, "passive")
        .when(n_apps > 1, "mixed")
        .otherwise("passive")
    )


def at_least(mean: Column, bound: float) -> Column:
    """``mean >= bound`` in whatever order the parts of the mean were added."""
    return mean >= bound - 1e-9


def above(mean: Column, bound: float) -> Column:
    """``mean > bound`` in whatever order the parts of the mean were added."""
    return mean > bound + 1e-9
