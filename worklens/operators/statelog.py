"""State logs: durations, hysteresis, replay of task and session commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import scoring
from worklens.functions.sequence import day_chunk, islands, scan_rows
from worklens.operators.attribution import active_intervals
from worklens.session import cut_lineage

ORDER = ["ts", "event_id"]
# fixed values: seconds a new state has to last before it is committed
HOLD_SECONDS = {"IDLE": 10, "ACTIVE_UNALIGNED": 5, "CONTRADICTORY": 5, "ACTIVE_ALIGNED": 0, "PAUSED": 0, "UNKNOWN": 0}


def state_durations(log: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Every state lasts until the next one, the last one until now."""
    seen = scan_rows(log, keys, ORDER, day_chunk("ts"), lead={"next_ts": F.col("ts")})
    end = F.coalesce("next_ts", now)
    return seen.withColumn("until", end).withColumn("seconds", scoring.seconds_between("ts", "until").cast("long")).drop("next_ts")


def window_durations(windows: DataFrame, keys: list[str]) -> DataFrame:
    """An app window lasts until the next one opens; the last one has no duration yet."""
    seen = scan_rows(windows, keys, ORDER, day_chunk("ts"), lead={"next_ts": F.col("ts")})
    return seen.withColumn("seconds", scoring.seconds_between("ts", "next_ts")).drop("next_ts")


def committed_states(candidates: DataFrame, keys: list[str], hold_seconds: dict[str, float] | None = None) -> DataFrame:
    """Candidate states with hysteresis.

    A run of equal candidates commits at its first row after the opening one that is at least the
    state's hold time later; the very first run commits at once. Committed runs equal to the one
    committed before are dropped. The state counts from the start of its run.
    """
    hold_seconds = hold_seconds or HOLD_SECONDS
    runs = islands(
        candidates, keys, ORDER, day_chunk("ts"), lambda: F.col("__c") != F.col("candidate"), out="run",
        lag={"__c": F.col("candidate")}, uses=["candidate"],
    )
    hold = F.lit(0.0)
    for state, seconds in hold_seconds.items():
        hold = F.when(F.col("candidate") == state, float(seconds)).otherwise(hold)
    starts = runs.groupBy(*keys, "run").agg(F.min(F.struct("ts", "event_id")).alias("s"))
    later = runs.join(starts, [*keys, "run"]).withColumn("elapsed", scoring.seconds_between(F.col("s.ts"), "ts"))
    ok = (F.col("run") == 1) | ((F.col("event_id") != F.col("s.event_id")) & (F.col("elapsed") >= hold))
    done = later.filter(ok).groupBy(*keys, "run").agg(
        F.min("ts").alias("ts"), F.min("event_id").alias("event_id"), F.first("candidate").alias("to_state"), F.first("s.ts").alias("since"))
    done = cut_lineage(done)  # one row per run; the scans below read it several times
    seen = scan_rows(done, keys, ["ts", "run"], day_chunk("ts"), lag={"__to": F.col("to_state")})
    kept = seen.filter(F.col("__to").isNull() | (F.col("__to") != F.col("to_state")))
    out = scan_rows(kept, keys, ["ts", "run"], day_chunk("ts"), lag={"from_state": F.col("to_state"), "__since": F.col("since")})
    return out.select(
        *keys, "ts", "from_state", "to_state", "since",
        F.coalesce(scoring.seconds_between("__since", "ts"), F.lit(0.0)).cast("long").alias("duration_prev"))


def change_only(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that differ from the row before in any of ``values``."""
    same = F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values])
    seen = scan_rows(rows, keys, ORDER, day_chunk("ts"), lag={"__v": same})
    return seen.filter(F.col("__v").isNull() | (F.col("__v") != same)).drop("__v")


def idle_edges(rows: DataFrame, keys: list[str], is_idle: Column) -> DataFrame:
    """IDLE_ENTER and IDLE_EXIT where the idle flag changes; a log starts as not idle."""
    seen = scan_rows(rows.withColumn("__idle", is_idle), keys, ORDER, day_chunk("ts"), lag={"__was": F.col("__idle")})
    edge = F.coalesce("__was", F.lit(False)) != F.col("__idle")
    return seen.filter(edge).withColumn("edge", F.when(F.col("__idle"), "IDLE_ENTER").otherwise("IDLE_EXIT")).drop("__idle", "__was")


def replay_tasks(commands: DataFrame) -> DataFrame:
    """The valid state rows that a log of task commands produces.

    At most one task of a user is ACTIVE: starting another pauses it. COMPLETED needs an earlier
    start; ABANDONED does not. After either, a task takes no more commands, except that an abandoned
    task can still be completed. Pausing a task that is not active does nothing.
    """
    task = ["user_id", "task_id"]
    at = lambda state: F.min(F.when(F.col("state") == state, F.struct(*ORDER)))
    first = commands.groupBy(*task).agg(at("ACTIVE").alias("f_active"), at("ABANDONED").alias("f_abandoned"))
    rows = commands.withColumn("o", F.struct(*ORDER)).join(first, task)
    late = F.when((F.col("state") == "COMPLETED") & (F.col("o") > F.col("f_active")) & F.coalesce(F.col("f_active") < F.col("f_abandoned"), F.lit(True)), F.col("o"))
    after = F.when((F.col("state") == "COMPLETED") & (F.col("o") > F.col("f_abandoned")), F.col("o"))
    ends = rows.groupBy(*task).agg(F.min(late).alias("f_completed"), F.min(after).alias("f_after"), F.first("f_abandoned").alias("fa"))
    ends = ends.withColumn("f_end", F.when(F.col("f_completed").isNull(), F.col("fa")).when(F.col("fa").isNull(), F.col("f_completed")).otherwise(F.least("f_completed", "fa")))
    ends = ends.select(*task, "f_end", F.when(F.col("f_end") == F.col("fa"), F.col("f_after")).alias("f_again"))
    rows = rows.drop("f_active", "f_abandoned").join(ends, task)
    alive = F.col("f_end").isNull() | (F.col("o") < F.col("f_end"))
    kind = (
        F.when((F.col("state") == "ACTIVE") & alive, "start").when((F.col("state") == "PAUSED") & alive, "pause")
        .when(F.col("o") == F.col("f_end"), "end").when(F.col("o") == F.col("f_again"), "again")
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null").drop("f_end", "f_again", "o")
    rows = cut_lineage(rows)  # read several times by the two scans
    started = scan_rows(rows, ["user_id"], ORDER, day_chunk("ts"), known_before={"cur": F.when(F.col("kind") == "start", F.col("task_id"))})
    marker = F.when(F.col("kind") == "start", F.col("task_id")).when(F.col("kind").isin("pause", "end") & (F.col("task_id") == F.col("cur")), "")
    seen = scan_rows(started.withColumn("m", marker), ["user_id"], ORDER, day_chunk("ts"), known_before={"was": F.col("m")})
    was = F.when(F.col("was") != "", F.col("was"))
    change = lambda t, s: F.struct(t.alias("task_id"), s.alias("state"))
    own = change(F.col("task_id"), F.when(F.col("kind") == "start", "ACTIVE").otherwise(F.col("state")))
    other = change(was, F.lit("PAUSED"))
    out = (
        F.when((F.col("kind") == "start") & was.isNull(), F.array(own))
        .when((F.col("kind") == "start") & (was != F.col("task_id")), F.array(other, own))
        .when((F.col("kind") == "pause") & (was == F.col("task_id")), F.array(own))
        .when(F.col("kind").isin("end", "again"), F.array(own))
    )
    return seen.select("user_id", "ts", "event_id", F.explode(out).alias("c")).select("user_id", "ts", "event_id", "c.task_id", "c.state")


def reconcile(snapshot: DataFrame) -> DataFrame:
    """Of several ACTIVE tasks of a user only the one started last stays active; an ACTIVE task
    without a start is paused."""
    active = F.col("state") == "ACTIVE"
    latest = F.max_by("task_id", F.when(active & F.col("started_at").isNotNull(), F.struct("started_at", "task_id")))
    winner = snapshot.groupBy("user_id").agg(latest.alias("winner"))
    joined = snapshot.join(winner, "user_id")
    keep = F.coalesce(F.col("task_id") == F.col("winner"), F.lit(False))
    return joined.withColumn("state", F.when(active & ~keep, "PAUSED").otherwise(F.col("state"))).drop("winner")


# fixed values: session states and what may follow each
ALLOWED = [
    ("INACTIVE", "ACTIVE"), ("ACTIVE", "FINALIZING"), ("ACTIVE", "INACTIVE"), ("FINALIZING", "FINALIZED"),
    ("FINALIZING", "INACTIVE"), ("FINALIZED", "INACTIVE"),
]


def invalid_transitions(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose state may not follow the state before; staying is fine, a log starts INACTIVE."""
    seen = scan_rows(log, keys, ORDER, day_chunk("ts"), lag={"from_state": F.col("state")})
    seen = seen.withColumn("from_state", F.coalesce("from_state", F.lit("INACTIVE")))
    fine = F.col("from_state") == F.col("state")
    for a, b in ALLOWED:
        fine = fine | ((F.col("from_state") == a) & (F.col("state") == b))
    return seen.filter(~fine)


def ghost_sessions(sessions: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """Sessions that are started, not ended and not the user's active one are paused: their
    running time is added and the start is cleared. ``active`` has user_id, active_session."""
    rows = sessions.join(active, "user_id", "left")
    ghost = F.col("ended_at").isNull() & F.col("started_at").isNotNull() & ~F.coalesce(F.col("active_session") == F.col("session_id"), F.lit(False))
    more = F.when(ghost, scoring.seconds_between("started_at", now)).otherwise(0.0)
    return rows.select(
        "user_id", "session_id", (F.col("accumulated_seconds") + more).alias("accumulated_seconds"),
        F.when(~ghost, F.col("started_at")).alias("started_at"), "ended_at", ghost.alias("was_ghost"))


def session_lifecycles(log: DataFrame, now: Column) -> DataFrame:
    """One row per session out of its accepted commands: accumulated seconds over start / resume
    to pause / end, whether it runs, and its last state."""
    key = ["user_id", "session_id"]
    spans = active_intervals(log, key, ("START", "RESUME"), ["PAUSE", "END", "REOPEN"], "command")
    done = F.sum(F.when(F.col("a_end").isNotNull(), scoring.seconds_between("a_start", "a_end")).otherwise(0.0))
    run = spans.groupBy(*key).agg(
        done.alias("accumulated_seconds"), F.max(F.when(F.col("a_end").isNull(), F.col("a_start"))).alias("running_since"))
    last = log.groupBy(*key).agg(
        F.max_by("command", F.struct(*ORDER)).alias("last"), F.max("ts").alias("updated_at"),
        F.min(F.when(F.col("command").isin("START", "RESUME"), F.col("ts"))).alias("first_started"))
    state = F.when(F.col("last").isin("START", "RESUME"), "ACTIVE").when(F.col("last") == "END", "ENDED").otherwise("PAUSED")
    live = F.when(F.col("running_since").isNotNull(), scoring.seconds_between("running_since", now)).otherwise(0.0)
    return last.join(run, key, "left").select(
        *key, state.alias("state"), F.coalesce("accumulated_seconds", F.lit(0.0)).alias("accumulated_seconds"),
        (F.coalesce("accumulated_seconds", F.lit(0.0)) + live).alias("duration_seconds"), "first_started", "updated_at")


def collection_spans(events: DataFrame, markers: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Each START marker opens a span up to the next marker (or now); events in it are counted,
    background ones apart. Events find their span through one ordered scan of both streams."""
    marks = markers.select(*keys, "ts", F.col("event_id"), F.col("marker"), F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("background"))
    items = events.select(*keys, "ts", "event_id", F.lit(None).cast("string").alias("marker"), F.lit(1).alias("side"), "background")
    seen = scan_rows(
        marks.unionByName(items), keys, ["ts", "side", "event_id"], day_chunk("ts"),
        known={"span": F.when(F.col("marker").isNotNull(), F.struct(F.col("ts").alias("s"), F.col("marker").alias("m")))})
    counts = seen.filter("side = 1 and span.m = 'START'").groupBy(*keys, F.col("span.s").alias("ts")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("background").cast("int")).alias("background_events"))
    spans = scan_rows(markers, keys, ORDER, day_chunk("ts"), lead={"stopped": F.col("ts")}).filter("marker = 'START'")
    return spans.join(counts, [*keys, "ts"], "left").select(
        *keys, F.col("ts").alias("started"), F.coalesce("stopped", now).alias("stopped"),
        scoring.seconds_between("ts", F.coalesce("stopped", now)).alias("seconds"),
        F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("background_events", F.lit(0)).alias("background_events"))
