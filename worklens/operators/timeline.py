"""Day timelines: sessions cut into stretches of one state and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring
from worklens.functions.ranges import asof_join
from worklens.functions.sequence import islands, span_islands
from worklens.session import cut_lineage

KEY = ["user_id", "session_id", "day"]


def session_days(sessions: DataFrame) -> DataFrame:
    """Sessions clipped to each calendar day they touch."""
    days = F.sequence(F.to_date("start_time"), F.to_date("end_time"))
    clipped = sessions.select("user_id", "session_id", "start_time", "end_time", F.explode(days).alias("day")).withColumns({
        "day_start": F.greatest("start_time", F.col("day").cast("timestamp")),
        "day_end": F.least("end_time", F.date_add("day", 1).cast("timestamp"))})
    return clipped.filter("day_start < day_end").drop("start_time", "end_time")


def minute_states(sessions: DataFrame, minutes: DataFrame, state_changes: DataFrame) -> DataFrame:
    """One row per minute bucket of a session day with the state that held there. A session day
    without a bucket gets one at its start. ``state_changes`` has state, active_task, reason and
    confidence inside the struct ``payload``."""
    days = session_days(sessions)
    buckets = minutes.withColumn("day", F.to_date("minute"))
    rows = (
        days.join(buckets, KEY, "left")
        .withColumn("inside", (F.col("minute") >= F.col("day_start")) & (F.col("minute") < F.col("day_end")))
        .groupBy(*KEY, "day_start", F.when(F.col("inside"), F.col("minute")).alias("minute"))
        .agg(F.sum(F.when(F.col("inside"), F.col("keys"))).alias("keys"), F.sum(F.when(F.col("inside"), F.col("clicks"))).alias("clicks"))
    )
    real = F.count("minute").over(Window.partitionBy(*KEY))
    rows = rows.withColumn("real", real).filter("minute is not null or real = 0").select(
        *KEY, F.coalesce("minute", "day_start").alias("minute"), F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("clicks", F.lit(0)).alias("clicks"))
    rows = cut_lineage(rows)  # the as-of scan reads it several times
    return asof_join(rows, state_changes, ["user_id"], "minute", "ts", "payload", "payload", "event_id")


def timeline(states: DataFrame) -> DataFrame:
    """Contiguous buckets of one state and task, with inputs, mean confidence and reasons
    in order of appearance. A stretch ends one minute after its last bucket."""
    rows = states.select(*KEY, "minute", "keys", "clicks", F.coalesce("payload.state", F.lit("unknown")).alias("state"),
                         F.col("payload.active_task").alias("task"), F.col("payload.reason").alias("reason"), F.col("payload.confidence").alias("confidence"))
    runs = islands(
        rows, KEY, ["minute"], F.date_trunc("hour", "minute"),
        lambda: (F.col("__s") != F.col("state")) | ~F.col("__t").eqNullSafe(F.col("task")), out="stretch",
        lag={"__s": F.col("state"), "__t": F.col("task")}, uses=["state", "task"])
    runs = cut_lineage(runs)  # feeds two aggregates
    group = [*KEY, "stretch", "state", "task"]
    minutes = F.count(F.lit(1))
    base = runs.groupBy(*group).agg(
        F.min("minute").alias("start_time"), (F.max("minute") + F.expr("interval 1 minute")).alias("end_time"), minutes.alias("buckets"),
        ((F.sum("keys") + F.sum("clicks")) / F.greatest(F.lit(1), minutes)).cast("long").alias("inputs_per_minute"),
        F.avg("confidence").alias("confidence"))
    first_reason = runs.filter("reason is not null").groupBy(*KEY, "stretch", "reason").agg(F.min("minute").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("m", "reason")))  # distinct reasons only
    reasons = first_reason.groupBy(*KEY, "stretch").agg(F.array_join(F.transform(ordered, lambda r: r["reason"]), ",").alias("reasons"))
    return base.join(reasons, [*KEY, "stretch"], "left")


def state_ratios(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of aligned, drifting and idle time, two decimals."""
    s = scoring.seconds_between("start_time", "end_time").cast("long")
    whole = F.greatest(F.sum(s), F.lit(1))
    share = lambda state: F.bround(F.sum(F.when(F.col("state") == state, s).otherwise(0)) / whole, 2)
    return stretches.groupBy(*keys).agg(
        share("ACTIVE_ALIGNED").alias("aligned_ratio"), share("ACTIVE_UNALIGNED").alias("drift_ratio"), share("IDLE").alias("idle_ratio"))


def consistency(stretches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per user and day, timeline seconds against session seconds (60 s allowed) and whether
    stretches overlap."""
    s = scoring.seconds_between("start_time", "end_time").cast("long")
    w = Window.partitionBy("user_id", "day").orderBy("start_time", "session_id")
    seen = stretches.withColumn("overlap", F.lag("end_time").over(w) > F.col("start_time"))
    line = seen.groupBy("user_id", "day").agg(F.sum(s).alias("timeline_seconds"), F.max(F.coalesce("overlap", F.lit(False))).alias("has_overlap"))
    d = scoring.seconds_between("day_start", "day_end").cast("long")
    real = session_days(sessions).groupBy("user_id", "day").agg(F.sum(d).alias("session_seconds"))
    return real.join(line, ["user_id", "day"], "left").na.fill(0, ["timeline_seconds"]).na.fill(False, ["has_overlap"]).withColumn(
        "ok", ~F.col("has_overlap") & (F.abs(F.col("session_seconds") - F.col("timeline_seconds")) <= 60))


def mark_merged(sessions: DataFrame, keys: list[str], start: str, end: str, tie: list[str], chunk) -> DataFrame:
    """Every session with ``merged_start``, the start of the merged session that it belongs to."""
    return span_islands(sessions, keys, start, end, tie, chunk, lambda s, seen: s > seen, out="merged_start")


def merge_sessions(sessions: DataFrame, keys: list[str], start: str, end: str, tie: list[str], chunk, counters: tuple[str, ...] = ("keys", "clicks", "mouse_distance")) -> DataFrame:
    """Sessions of a key that overlap or touch become one: latest end, summed counters,
    distinct apps counted from their own small table."""
    marked = mark_merged(sessions, keys, start, end, tie, chunk)
    base = marked.groupBy(*keys, "merged_start").agg(F.max(end).alias("merged_end"), *[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("sessions"))
    apps = marked.select(*keys, "merged_start", "app").distinct().groupBy(*keys, "merged_start").agg(F.array_join(F.array_sort(F.collect_list("app")), ",").alias("apps"))
    return base.join(apps, [*keys, "merged_start"])


def merged_totals(marked: DataFrame, keys: list[str], part: str | Column, values: list[str]) -> DataFrame:
    """Counters of the sessions (``mark_merged``, or their child rows joined to it) by merged session
    and ``part``: the time bucket of a timeline, or the intent."""
    return marked.groupBy(*keys, "merged_start", part).agg(*[F.sum(v).alias(v) for v in values])
