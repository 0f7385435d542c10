"""Windows over raw inputs and interval signals: the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scoring
from worklens.functions.ranges import asof_join
from worklens.functions.sequence import day_chunk, islands, scan_rows
from worklens.operators.metrics import intensity, intensity_share
from worklens.session import cut_lineage

ORDER = ["ts", "event_id"]
# fixed values: processes that never count as engagement
SYSTEM_PROCESSES = [
    "explorer.exe", "dwm.exe", "taskmgr.exe", "systemsettings.exe", "searchhost.exe", "startmenuexperiencehost.exe", "shellexperiencehost.exe",
]


def _kind(kind: str, value: Column | None = None) -> Column:
    return F.sum(F.when(F.col("kind") == kind, value if value is not None else F.lit(1)).otherwise(0))


def tumbling_inputs(inputs: DataFrame, seconds: int) -> DataFrame:
    """I01 core of G01, the same plan in batch and on a stream: counts per user and window and the
    app and title seen last in it."""
    last = F.struct("ts", "event_id")
    return inputs.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        (_kind("key") / (seconds / 60.0)).alias("keyboard_intensity"), _kind("click").alias("mouse_clicks"),
        _kind("move", F.col("amount")).cast("double").alias("mouse_distance"),
        F.max_by("app", last).alias("app"), F.max_by("window_title", last).alias("window_title"),
    ).select("user_id", F.col("w.start").alias("timestamp_start"), F.col("w.end").alias("timestamp_end"),
             "keyboard_intensity", "mouse_clicks", "mouse_distance", "app", "window_title")


def dense_intervals(inputs: DataFrame, seconds: int) -> DataFrame:
    """A row for every window between a user's first and last input; empty ones carry the app and
    title on and count zero."""
    made = tumbling_inputs(inputs, seconds)
    reach = made.groupBy("user_id").agg(F.min("timestamp_start").alias("a"), F.max("timestamp_start").alias("b"))
    frame = reach.select("user_id", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("timestamp_start"))
    full = frame.join(made.drop("timestamp_end"), ["user_id", "timestamp_start"], "left").na.fill(0, ["keyboard_intensity", "mouse_clicks", "mouse_distance"])
    carried = scan_rows(full, ["user_id"], ["timestamp_start"], day_chunk("timestamp_start"),
                        known={"app_now": F.col("app"), "title_now": F.col("window_title")})
    return carried.select(
        "user_id", "timestamp_start", (F.col("timestamp_start") + F.expr(f"interval {seconds} seconds")).alias("timestamp_end"),
        "keyboard_intensity", "mouse_clicks", "mouse_distance", F.col("app_now").alias("app"), F.col("title_now").alias("window_title"))


def with_app_changes(inputs: DataFrame) -> DataFrame:
    """Marks the rows that open another app window."""
    seen = scan_rows(inputs, ["user_id"], ORDER, day_chunk("ts"), lag={"__app": F.col("app")})
    return seen.withColumn("app_change", F.when(F.col("__app").isNull() | (F.col("__app") != F.col("app")), 1).otherwise(0)).drop("__app")


def sliding_metrics(inputs: DataFrame, seconds: int = 300, slide: int = 10, preset: str = "DEFAULT") -> DataFrame:
    """Inputs of the last ``seconds``, refreshed every ``slide`` seconds, with intensity.
    ``inputs`` has app_change (0 or 1) per row."""
    last = F.struct("ts", "event_id")
    sums = inputs.groupBy("user_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(
        _kind("key").alias("keys"), _kind("click").alias("clicks"), _kind("move", F.col("amount")).cast("double").alias("mouse_distance"),
        F.sum("app_change").alias("app_changes"), F.max_by("app", last).alias("active_app"))
    args = [F.col(c) for c in ("keys", "clicks", "mouse_distance", "app_changes")]
    raw = F.col("keys") + F.col("clicks") + F.col("mouse_distance") / 100.0 + F.col("app_changes") * 2
    return sums.select(
        "user_id", F.col("w.end").alias("window_end"), "keys", "clicks", "mouse_distance", "app_changes", "active_app", raw.alias("input_activity_score"),
        intensity(*args, seconds, preset).alias("intensity"), F.least(F.lit(1.0), intensity_share(*args, seconds, preset)).alias("confidence"))


def window_states(windows: DataFrame, tasks: DataFrame, idle_below: float = 0.1) -> DataFrame:
    """The state of every window (user_id, window_end, intensity) by its intensity and the task that is active at its end. ``tasks`` has
    user_id, ts, event_id and task: the active one from then on, or null."""
    log = tasks.select("user_id", "ts", "event_id", F.coalesce("task", F.lit("")).alias("task"))
    rows = asof_join(windows, log, ["user_id"], "window_end", "ts", "task", "active_task", "event_id").withColumn("active_task", F.nullif("active_task", F.lit("")))
    state = F.when(F.col("intensity") / 100.0 < idle_below, "IDLE").when(F.col("active_task").isNull(), "ACTIVE_UNALIGNED").otherwise("ACTIVE_ALIGNED")
    return rows.withColumn("state", state)


def minute_timeline(inputs: DataFrame) -> DataFrame:
    """Keys, clicks and mouse distance per user and minute."""
    return inputs.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(
        _kind("key").alias("keys"), _kind("click").alias("clicks"), _kind("move", F.col("amount")).cast("double").alias("mouse_distance"))


def input_summaries(inputs: DataFrame, seconds: int = 5, at_least: int = 2) -> DataFrame:
    """One INPUT_ACTIVITY row per fixed window with enough raw inputs. The studied collector
    clears its buffer whenever it emits; here the windows are fixed so that replay gives the same."""
    sums = inputs.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("input_count"), _kind("key").alias("keyboard_events"), (F.count(F.lit(1)) - _kind("key")).alias("mouse_events"))
    return sums.filter(F.col("input_count") >= at_least).select("user_id", F.col("w.start").alias("window_start"), "input_count", "keyboard_events", "mouse_events")


def trailing_count(rows: DataFrame, keys: list[str], seconds: float, out: str) -> DataFrame:
    """Rows of the key in the last ``seconds`` (open at the far end), the row itself included. Every row
    enters the count at its time and leaves it ``seconds`` later; the count is a running sum."""
    leave = F.timestamp_micros(F.unix_micros("ts") + int(seconds * 1_000_000))
    enter = rows.withColumns({"__at": F.col("ts"), "__side": F.lit(1), "__d": F.lit(1)})
    gone = rows.withColumns({"__at": leave, "__side": F.lit(0), "__d": F.lit(-1)})
    both = scan_rows(enter.unionByName(gone), keys, ["__at", "__side", "event_id"], day_chunk("__at"), run_sum={out: F.col("__d")})
    return both.filter("__side = 1").drop("__at", "__side", "__d")


def engagement(inputs: DataFrame, keys: list[str], warmup: float = 30, at_least: int = 5, within: float = 30, stable: float = 10) -> DataFrame:
    """The first moment of each key at which, after the warm-up, enough inputs came in the last
    ``within`` seconds and a window that is no system process has not changed for ``stable`` seconds."""
    counted = cut_lineage(trailing_count(inputs, keys, within, "recent"))
    window = F.concat_ws("\0", "app", "window_title")
    seen = scan_rows(counted.withColumn("__w", window), keys, ORDER, day_chunk("ts"), lag={"__before": F.col("__w")})
    opened = F.when(F.col("__before").isNull() | (F.col("__before") != F.col("__w")), F.col("ts"))
    seen = scan_rows(seen.withColumn("__open", opened), keys, ORDER, day_chunk("ts"), known={"since": F.col("__open")})
    first = inputs.groupBy(*keys).agg(F.min("ts").alias("started"))
    rows = seen.join(first, keys)
    ok = (
        (scoring.seconds_between("started", "ts") >= warmup) & (F.col("recent") >= at_least)
        & ~F.lower("app").isin(SYSTEM_PROCESSES) & (scoring.seconds_between("since", "ts") >= stable)
    )
    return rows.groupBy(*keys).agg(F.first("started").alias("started"), F.min(F.when(ok, F.col("ts"))).alias("engaged_at"))


def rolling_session_features(sessions: DataFrame, minutes: DataFrame, now: str, within_minutes: float = 10) -> DataFrame:
    """Features of the minute buckets of the last ``within_minutes`` before the session's ``now``;
    when there is none, of its last ten buckets."""
    rows = minutes.join(sessions.select("session_id", F.col(now).alias("now"), "start_time", "n_apps"), "session_id")
    recent = scoring.minutes_between("minute", "now") <= within_minutes
    ten = Window.partitionBy("session_id").orderBy(F.desc("minute"))
    inputs = F.col("keys") + F.col("clicks")

    def features(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy("session_id", "now", "start_time", "n_apps").agg(
            n.alias("num_windows"), F.sum(inputs).alias("total_input"),
            F.least(F.sum(inputs) / (n * 60.0), F.lit(1.0)).alias("intensity"), (1.0 / (1.0 + F.var_pop(inputs) / 1000.0)).alias("continuity"))

    near = features(rows.filter(recent))
    far = rows.join(near.select("session_id"), "session_id", "left_anti").withColumn("r", F.row_number().over(ten)).filter("r <= 10").drop("r")
    both = near.unionByName(features(far))
    return both.select(
        "session_id", "num_windows", "total_input", "intensity", "continuity", F.least(F.col("n_apps") / 5.0, F.lit(1.0)).alias("app_diversity"),
        F.least(scoring.minutes_between("start_time", "now") / 60.0, F.lit(1.0)).alias("duration"))


VECTOR = [
    "context_switch_entropy", "focus_continuity_score", "max_sustained_minutes", "avg_focus_window_minutes", "focus_consistency",
    "app_diversity", "session_duration_minutes", "input_intensity",
]


def _stretch_sums(intervals: DataFrame, keys: list[str], chunk: Column | None) -> DataFrame:
    """One row per key out of its runs of one app: lengths of the runs, sums over the intervals, and the
    spread of time over apps. Everything comes from the same per-run rows, so the intervals are
    aggregated once."""
    chunk = chunk if chunk is not None else F.date_trunc("hour", "timestamp_start")
    rows = intervals.withColumn("app", F.coalesce("app", F.lit("unknown")))
    runs = islands(rows, keys, ["timestamp_start", "event_id"], chunk, lambda: F.col("__a") != F.col("app"), out="run", lag={"__a": F.col("app")}, uses=["app"])
    m = scoring.minutes_between("timestamp_start", "timestamp_end")
    m, kb = F.when(m > 0, m).otherwise(1.0 / 60.0), F.coalesce("keyboard_intensity", F.lit(0.0))
    clicks = F.coalesce("mouse_clicks", F.lit(0))
    each = runs.groupBy(*keys, "run", "app").agg(
        F.min("timestamp_start").alias("s"), F.max(F.struct("timestamp_start", "event_id", F.coalesce("timestamp_end", "timestamp_start").alias("end"))).alias("e"),
        F.count(F.lit(1)).alias("c"), F.sum(m).alias("m"), F.sum(kb * m).alias("typed"), F.sum(clicks).alias("clicks"),
        F.sum(kb).alias("k1"), F.sum(kb * kb).alias("k2"), F.count(F.when(kb != 0, 1)).alias("kn"))
    by_app = Window.partitionBy(*keys, "app")
    each = each.repartition(*keys).withColumns({
        "d": scoring.minutes_between("s", "e.end"), "app_c": F.sum("c").over(by_app), "new": F.when(F.row_number().over(by_app.orderBy("run")) == 1, 1).otherwise(0)})
    variance = lambda n: F.greatest(F.lit(0.0), F.sum("k2") / n - F.pow(F.sum("k1") / n, F.lit(2.0)))
    n, kn = F.sum("c"), F.sum("kn")
    return each.groupBy(*keys).agg(
        n.alias("n"), F.sum("m").alias("minutes"), (F.sum("typed") + F.sum("clicks")).alias("inputs"), F.sum("clicks").alias("clicks"),
        variance(n).alias("spread"), F.when(kn > 0, variance(kn)).alias("typed_spread"), F.sum("new").alias("apps"),
        F.sum(F.when((F.col("new") == 1) & (F.col("app") != "unknown"), 1).otherwise(0)).alias("known_apps"),
        (F.log2(n) - F.sum(F.when(F.col("new") == 1, F.col("app_c") * F.log2("app_c"))) / n).alias("mix"),
        F.greatest(F.lit(0.0), F.max("d")).alias("streak_max"), F.avg("d").alias("streak_avg"), (F.count(F.lit(1)) - 1).alias("switches"),
        F.min("s").alias("s"), F.max("e")["end"].alias("e"))


def live_vectors(intervals: DataFrame, keys: list[str], chunk: Column | None = None) -> DataFrame:
    """Feature vector of the intervals of each key (a user or session and a window of time)."""
    out = _stretch_sums(intervals, keys, chunk)
    cap = lambda c: F.least(c, F.lit(1.0))
    mix = F.when(F.col("apps") > 1, cap(F.greatest(F.lit(0.0), F.col("mix") / F.log2("apps")))).otherwise(0.0)
    return out.select(
        *keys, mix.alias("context_switch_entropy"),
        (1.0 - cap(F.col("switches") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("focus_continuity_score"),
        cap(F.col("streak_max") / 300.0).alias("max_sustained_minutes"), cap(F.col("streak_avg") / 120.0).alias("avg_focus_window_minutes"),
        (1.0 / (1.0 + F.col("spread") / 1000.0)).alias("focus_consistency"), cap(F.col("apps") / 20.0).alias("app_diversity"),
        cap(F.col("minutes") / 480.0).alias("session_duration_minutes"), cap(F.col("inputs") / F.col("minutes") / 8.0).alias("input_intensity"))


def activity_vectors(intervals: DataFrame, keys: list[str], chunk: Column | None = None) -> DataFrame:
    """The session-free variant: other normalisers, continuity equals consistency, and the span
    of the window as its length. Interval rows store no key counts, so clicks are the only inputs."""
    out = _stretch_sums(intervals, keys, chunk)
    cap = lambda c: F.least(c, F.lit(1.0))
    m = scoring.minutes_between("s", "e")
    minutes = F.when(m == 0, 1.0).otherwise(m)
    steady = F.coalesce(1.0 / (1.0 + F.col("typed_spread") / 1000.0), F.lit(0.5))
    return out.select(
        *keys, cap(F.greatest(F.col("known_apps") - 1, F.lit(0)) / 5.0).alias("context_switch_entropy"), steady.alias("focus_continuity_score"),
        cap(F.col("streak_max") / 300.0).alias("max_sustained_minutes"), cap(F.col("streak_avg") / 120.0).alias("avg_focus_window_minutes"),
        steady.alias("focus_consistency"), cap(F.col("known_apps") / 10.0).alias("app_diversity"), cap(minutes / 480.0).alias("session_duration_minutes"),
        F.when(minutes > 0, cap(F.col("clicks") / minutes / 8.0)).otherwise(0.0).alias("input_intensity"))


def signal_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per stretch of a session on one task, with its inputs; a stretch ends when the next
    one starts. ``rows`` has ts, event_id, task_id, keys, clicks, distance, app."""
    runs = islands(rows, keys, ORDER, day_chunk("ts"), lambda: ~F.col("__t").eqNullSafe(F.col("task_id")) | F.col("__o").isNull(), out="window_no",
                   lag={"__t": F.col("task_id"), "__o": F.col("ts")}, uses=["task_id"])
    sums = runs.groupBy(*keys, "window_no", "task_id").agg(
        F.min("ts").alias("start_time"), F.sum("keys").alias("keys"), F.sum("clicks").alias("clicks"), F.sum("distance").alias("mouse_distance"),
        F.max_by("app", F.struct("ts", "event_id")).alias("active_app"))
    return scan_rows(sums, keys, ["window_no"], F.floor(F.col("window_no") / 1000), lead={"end_time": F.col("start_time")})


def split_decisions(segments: DataFrame, keys: list[str], min_seconds: float = 60, min_confidence: float = 0.6) -> DataFrame:
    """Whether a context change may open a new segment: the one before must have lasted and the
    new confidence must suffice; then another app, else another cleaned title, splits."""
    seen = scan_rows(segments, keys, ["start_time", "segment_id"], day_chunk("start_time"),
                     lag={"p": F.struct("app", "normalized_title", "start_time")})
    held = scoring.seconds_between(F.col("p.start_time"), "start_time")
    reason = (
        F.when(F.col("p").isNull(), "first").when(held < min_seconds, "duration_too_short").when(F.col("confidence") < min_confidence, "confidence_too_low")
        .when(F.col("p.app") != F.col("app"), F.concat(F.lit("app_change_"), F.col("p.app"), F.lit("_to_"), F.col("app")))
        .when(F.col("p.normalized_title") != F.col("normalized_title"), "window_change").otherwise("no_context_change"))
    return seen.withColumn("reason", reason).withColumn("split", F.col("reason").startswith("app_change") | (F.col("reason") == "window_change")).drop("p")


def trailing_totals(minutes: DataFrame, windows: list[float]) -> DataFrame:
    """Inputs of a session in the trailing windows (in minutes, back from its latest bucket) and in
    the whole session."""
    last = minutes.groupBy("session_id").agg(F.max("minute").alias("now"))
    rows = minutes.join(last, "session_id").withColumn("age", scoring.minutes_between("minute", "now"))
    inside = lambda w, c: F.sum(F.when(F.col("age") < w, F.col(c)).otherwise(0))
    cols = [inside(w, c).alias(f"{c}_{int(w)}") for w in windows for c in ("keys", "clicks", "mouse_distance")]
    return rows.groupBy("session_id").agg(*cols, *[F.sum(c).alias(f"{c}_all") for c in ("keys", "clicks", "mouse_distance")])


def recent_activity_vectors(intervals: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """The feature vector of every window of ``seconds`` without a session: what was done in it, by key.

    Runs of one app are numbered inside the window; everything else is one aggregate over the runs, so a key's
    rows meet only with those of the same window."""
    at = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp_start") / seconds) * seconds)
    rows = intervals.withColumns({
        "window_start": at, "app": F.coalesce("app", F.lit("unknown")), "named": F.col("app").isNotNull().cast("int"),
        "inputs": F.col("keyboard_intensity") * scoring.interval_minutes() + F.col("mouse_clicks")})
    part, order = [*keys, "window_start"], ["timestamp_start", "event_id"]
    runs = islands(rows, part, order, F.col("window_start"), lambda: F.col("__app") != F.col("app"), out="run", lag={"__app": F.col("app")}, uses=["app"])
    kb = F.when(F.col("keyboard_intensity") != 0, F.col("keyboard_intensity"))
    per_run = runs.groupBy(*part, "run", "app", "named").agg(
        F.min("timestamp_start").alias("start"), F.max(F.struct(*order, "timestamp_end", "window_title")).alias("last"), F.sum("inputs").alias("inputs"),
        F.count(kb).alias("n"), F.sum(kb).alias("s"), F.sum(kb * kb).alias("q"))
    per_run = per_run.withColumn("minutes", scoring.minutes_between("start", "last.timestamp_end"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    whole = per_run.groupBy(*part).agg(
        F.countDistinct(F.when(F.col("named") == 1, F.col("app"))).alias("apps"), F.max("minutes").alias("longest"), F.avg("minutes").alias("streak"), F.sum("inputs").alias("inputs"),
        F.min("start").alias("first_start"), F.max_by(F.struct("last.timestamp_end", "app", "last.window_title"), "last").alias("end"),
        F.when(n > 0, 1.0 / (1.0 + (F.sum("q") / n - mean * mean) / 1000.0)).otherwise(0.5).alias("focus_consistency"))
    minutes = scoring.minutes_between("first_start", "end.timestamp_end")
    cap = lambda c: F.least(c, F.lit(1.0))
    whole = whole.withColumn("minutes", F.when(minutes == 0, 1.0).otherwise(minutes))
    return whole.select(
        *part, F.col("end.app").alias("active_app"), F.col("end.window_title").alias("active_window_title"),
        cap(F.greatest(F.col("apps") - 1, F.lit(0)) / 5.0).alias("context_switch_entropy"), "focus_consistency", cap(F.col("longest") / 300.0).alias("max_sustained"),
        cap(F.col("streak") / 120.0).alias("avg_focus_window"), cap(F.col("apps") / 10.0).alias("app_diversity"), cap(F.col("minutes") / 480.0).alias("duration"),
        cap(F.col("inputs") / F.col("minutes") / 8.0).alias("input_intensity"), F.hour("first_start").alias("time_of_day_hour"))
