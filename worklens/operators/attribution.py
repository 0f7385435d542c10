"""Task time: active intervals out of a state log, and their overlap with sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring
from worklens.functions.ranges import merge_intervals, overlap_join
from worklens.functions.sequence import day_chunk, scan_rows
from worklens.session import cut_lineage

TASK = ["user_id", "task_id"]
CLOSING = ["PAUSED", "COMPLETED", "ABANDONED"]


def active_intervals(log: DataFrame, keys: list[str] = TASK, opening: tuple[str, ...] = ("ACTIVE",), closing: list[str] = CLOSING, state: str = "state") -> DataFrame:
    """An opening row that is directly followed by a closing row is an interval; followed by
    another opening row it is reset; followed by nothing it is open (end NULL). Other states are
    ignored."""
    rows = log.filter(F.col(state).isin(*opening, *closing))
    seen = scan_rows(rows, keys, ["ts", "event_id"], day_chunk("ts"), lead={"__next": F.struct(F.col("ts").alias("ts"), F.col(state).alias("s"))})
    return seen.filter(F.col(state).isin(*opening) & (F.col("__next").isNull() | F.col("__next.s").isin(closing))).select(
        *keys, F.col("ts").alias("a_start"), F.col("__next.ts").alias("a_end"))


def total_active_seconds(intervals: DataFrame, now: Column, keys: list[str] = TASK) -> DataFrame:
    """Whole seconds of all positive active intervals; open ones end now."""
    seconds = scoring.seconds_between("a_start", F.coalesce("a_end", now))
    return intervals.groupBy(*keys).agg(F.sum(F.when(seconds > 0, seconds).otherwise(0.0)).cast("long").alias("active_seconds"))


def session_overlaps(sessions: DataFrame, intervals: DataFrame, now: Column) -> DataFrame:
    """One row per overlapping session and active interval, with the seconds in common."""
    closed = intervals.withColumn("a_end", F.coalesce("a_end", now)).filter(F.col("a_end") > F.col("a_start"))
    spans = sessions.select("user_id", "session_id", "start_time", "end_time")
    pairs = overlap_join(spans, closed, ["user_id"], ("start_time", "end_time"), ("a_start", "a_end"), bucket_seconds=21600)
    both = scoring.seconds_between(F.greatest("start_time", "a_start"), F.least("end_time", "a_end"))
    return pairs.withColumn("seconds", both).filter("seconds > 0")


def attribute_sessions(sessions: DataFrame, intervals: DataFrame, now: Column, merge: bool = True) -> DataFrame:
    """Whole seconds per session and task; what no task covers goes to task NULL. With ``merge``
    overlapping intervals of one task are merged first."""
    closed = intervals.withColumn("a_end", F.coalesce("a_end", now))
    if merge:
        closed = merge_intervals(closed.filter(F.col("a_end") > F.col("a_start")), TASK, "a_start", "a_end").drop("n_merged")
    per_task = session_overlaps(sessions, closed, now).groupBy("user_id", "session_id", "task_id").agg(F.sum("seconds").alias("s"))
    per_task = cut_lineage(per_task)  # read for the tasks and for the remainder
    covered = per_task.groupBy("user_id", "session_id").agg(F.sum("s").alias("covered"))
    rest = (
        sessions.select("user_id", "session_id", scoring.seconds_between("start_time", "end_time").alias("d"))
        .join(covered, ["user_id", "session_id"], "left")
        .select("user_id", "session_id", F.lit(None).cast("string").alias("task_id"), (F.col("d") - F.coalesce("covered", F.lit(0.0))).alias("s"))
        .filter(F.round("s", 6) > 0)
    )
    return per_task.unionByName(rest).withColumn("seconds", (F.col("s") + 1e-7).cast("long")).drop("s")


def task_session_overlap(sessions: DataFrame, attributed: DataFrame) -> DataFrame:
    """Per task and session seconds, share of the session, and the task's total."""
    spans = sessions.select("user_id", "session_id", "start_time", scoring.seconds_between("start_time", "end_time").cast("long").alias("session_seconds"))
    w = Window.partitionBy(*TASK)
    return (
        attributed.filter("task_id is not null and seconds > 0").join(spans, ["user_id", "session_id"])
        .withColumn("percent", F.when(F.col("session_seconds") > 0, F.col("seconds") / F.col("session_seconds") * 100.0).otherwise(0.0))
        .withColumn("total_seconds", F.sum("seconds").over(w))
    )


def task_stats(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whole seconds, segments, and the share of the session's keys and clicks that falls
    to the task by time."""
    d = scoring.seconds_between("start_time", "end_time").cast("long")
    totals = sessions.select("user_id", "session_id", "keys", "clicks", F.greatest(F.lit(1.0), F.col("duration_seconds")).alias("whole"))
    rows = segments.withColumn("d", d).join(totals, ["user_id", "session_id"])
    part = lambda c: F.sum((F.col(c) * (F.col("d") / F.col("whole")) + 1e-9).cast("long"))
    return rows.groupBy("task_id").agg(
        F.sum("d").alias("seconds"), F.count(F.lit(1)).alias("segments"), part("keys").alias("keys"), part("clicks").alias("clicks"),
    ).orderBy(F.desc("seconds"))


def coverage_gaps(spans: DataFrame, keys: list[str], start: str, end: str, minutes: float = 30.0) -> DataFrame:
    """Gaps of at least ``minutes`` between merged spans."""
    merged = cut_lineage(merge_intervals(spans, keys, start, end))
    seen = scan_rows(merged, keys, [start], day_chunk(start), lead={"gap_end": F.col(start)})
    return seen.withColumn("gap_seconds", scoring.seconds_between(end, "gap_end").cast("long")).filter(
        F.col("gap_seconds") >= minutes * 60).select(*keys, F.col(end).alias("gap_start"), "gap_end", "gap_seconds")


def background_to_sessions(events: DataFrame, sessions: DataFrame, max_gap_seconds: int = 300) -> DataFrame:
    """The session a background event falls into (both ends count), else the session whose
    nearer edge is closest, if that is within ``max_gap_seconds``."""
    point = events.select("event_id", "user_id", F.col("ts").alias("p0"), F.col("ts").alias("p1"))
    reach = F.expr(f"interval {max_gap_seconds} seconds")
    wide = sessions.select("user_id", "session_id", "start_time", "end_time", (F.col("start_time") - reach).alias("w0"), (F.col("end_time") + reach).alias("w1"))
    pairs = overlap_join(point, wide, ["user_id"], ("p0", "p1"), ("w0", "w1"), bucket_seconds=21600, closed=True)
    inside = F.col("p0").between(F.col("start_time"), F.col("end_time"))
    gap = F.least(F.abs(scoring.seconds_between("start_time", "p0")), F.abs(scoring.seconds_between("end_time", "p0")))
    rows = pairs.withColumns({"inside": inside, "gap": F.when(inside, 0.0).otherwise(gap)})
    best = F.struct(~F.col("inside"), F.col("gap"), F.col("start_time"))
    return rows.groupBy("event_id").agg(
        F.min_by("session_id", best).alias("session_id"), F.min_by("inside", best).alias("contained"), F.min_by("gap", best).alias("gap_seconds"))


def bucket_totals_in_intervals(minutes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Inputs of the minute buckets that lie in an active interval of a task, per task. Merged
    intervals do not overlap, so a bucket meets each task once."""
    merged = merge_intervals(intervals, TASK, "a_start", "a_end").drop("n_merged")
    point = minutes.select("user_id", "minute", (F.col("minute") + F.expr("interval 1 microsecond")).alias("m1"), "keys", "clicks", "mouse_distance")
    pairs = overlap_join(point, merged, ["user_id"], ("minute", "m1"), ("a_start", "a_end"), bucket_seconds=21600).filter(F.col("a_start") <= F.col("minute"))
    return pairs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum(F.col("keys") + F.col("clicks") + F.col("mouse_distance")).alias("total"))


def task_day_report(segments: DataFrame, minutes: DataFrame) -> DataFrame:
    """Per user, day and task: seconds clipped to the day, segments, keys and clicks of the
    minute buckets of the same session inside the clipped segment."""
    days = F.sequence(F.to_date("start_time"), F.to_date("end_time"))
    clipped = segments.withColumn("day", F.explode(days)).withColumns({
        "c0": F.greatest("start_time", F.col("day").cast("timestamp")), "c1": F.least("end_time", F.date_add("day", 1).cast("timestamp"))})
    clipped = clipped.withColumn("seconds", scoring.seconds_between("c0", "c1").cast("long")).filter("seconds > 0")
    time = clipped.groupBy("user_id", "day", "task_id").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("segments"))
    point = minutes.select("user_id", "session_id", "minute", (F.col("minute") + F.expr("interval 1 microsecond")).alias("m1"), "keys", "clicks")
    hits = overlap_join(point, clipped.select("user_id", "session_id", "day", "task_id", "c0", "c1"), ["user_id", "session_id"],
                        ("minute", "m1"), ("c0", "c1"), bucket_seconds=21600).filter(F.col("c0") <= F.col("minute"))
    inputs = hits.groupBy("user_id", "day", "task_id").agg(F.sum("keys").alias("keys"), F.sum("clicks").alias("clicks"))
    return time.join(inputs, ["user_id", "day", "task_id"], "left").na.fill(0, ["keys", "clicks"])


def new_sessions(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates without a stored session of the user whose start and end are both less than a
    second away. Starts are bucketed by second, each candidate looks at three buckets."""
    second = F.floor(F.unix_micros("start_time") / 1_000_000)
    known = stored.select("user_id", F.unix_micros("start_time").alias("k0"), F.unix_micros("end_time").alias("k1"), second.alias("sec"))
    tried = candidates.withColumn("sec", F.explode(F.array(second - 1, second, second + 1)))
    close = (F.abs(F.unix_micros("start_time") - F.col("k0")) < 1_000_000) & (F.abs(F.unix_micros("end_time") - F.col("k1")) < 1_000_000)
    seen = tried.join(known, ["user_id", "sec"]).filter(close).select("session_id").distinct()
    return candidates.join(seen, "session_id", "left_anti")


def best_task(sessions: DataFrame, live: DataFrame, activity: DataFrame, intent: DataFrame) -> DataFrame:
    """C17: the session's live task, else the user's activity task, else the user's intent task."""
    rows = sessions.join(live, "session_id", "left").join(activity, "user_id", "left").join(intent, "user_id", "left")
    source = F.when(F.col("live_task").isNotNull(), "session").when(F.col("activity_task").isNotNull(), "activity").when(F.col("intent_task").isNotNull(), "intent").otherwise("none")
    return rows.select("session_id", F.coalesce("live_task", "activity_task", "intent_task").alias("task"), source.alias("source"))
