"""Daily summaries, trends and weekly patterns."""

from pyspark.sql import functions as F

from worklens.operators import daily, trends
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.sources import tables as src
from worklens.session import stored

view("sess_class", ["sess"], """
SELECT *, CASE WHEN total_input < 5 AND duration_seconds > 300 THEN 'idle-heavy' WHEN n_apps = 1 AND input_per_minute >= 4 THEN 'focused'
  WHEN n_apps = 1 THEN 'passive' WHEN n_apps > 1 THEN 'mixed' ELSE 'passive' END AS class, least(input_per_minute / 60.0, 1.0) AS intensity,
  least(n_apps / 10.0, 1.0) AS app_diversity
FROM (SELECT *, keys + clicks AS total_input, duration_seconds / 60.0 AS s_minutes, CAST(start_time AS DATE) AS day,
  CASE WHEN duration_seconds > 0 THEN (keys + clicks) / (duration_seconds / 60.0) ELSE 0.0 END AS input_per_minute FROM sess) t
""")
view("app_days", ["sess_class"], """
SELECT user_id, day, app, sum(duration_seconds / n_apps) AS app_seconds FROM (SELECT user_id, day, duration_seconds, n_apps, unnest(apps) AS app FROM sess_class) t GROUP BY 1, 2, 3
""")
view("visits", ["front"], """
SELECT user_id, session_id, app, min(timestamp_start) AS first_use FROM front GROUP BY 1, 2, 3
""")
view("moves", ["visits"], """
SELECT user_id, day, app, next_app, count(*) AS n FROM (
  SELECT *, lead(app) OVER (PARTITION BY user_id, day ORDER BY first_use) AS next_app FROM (
    SELECT *, CAST(min(first_use) OVER (PARTITION BY user_id, session_id) AS DATE) AS day FROM visits) a) b
WHERE next_app <> app GROUP BY 1, 2, 3, 4
""")
view("day_entropy", ["moves"], """
SELECT user_id, day, greatest(0.0, least(1.0, -sum(n / t * log2(n / t)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1.0 END)) AS context_switch_entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, day) AS t FROM moves) x GROUP BY 1, 2
""")
view("day_focus", ["sess_class"], """
SELECT user_id, day, least(1.0, sum(pow(duration_seconds, 1.5)) / pow(sum(duration_seconds), 1.5)) AS focus_continuity_score, max(s_minutes) AS max_sustained_minutes,
  avg(s_minutes) AS avg_focus_window_minutes, count(*) AS focus_window_count, coalesce(max(CASE WHEN gap > 0 THEN gap END), 0.0) AS longest_gap_minutes,
  CASE WHEN count(*) < 2 THEN 1.0 ELSE least(1.0, 1.0 / (1.0 + stddev_pop(s_minutes) / avg(s_minutes))) END AS focus_consistency
FROM (SELECT *, (epoch_us(lead(start_time) OVER (PARTITION BY user_id, day ORDER BY start_time)) - epoch_us(end_time)) / 6e7 AS gap FROM sess_class WHERE class = 'focused') t
GROUP BY 1, 2
""")
view("daily", ["sess_class", "app_days", "day_entropy", "day_focus"], """
SELECT b.*, most_used_app, most_used_app_seconds, coalesce(context_switch_entropy, 0.0) AS context_switch_entropy,
  coalesce(focus_continuity_score, 0.0) AS focus_continuity_score, coalesce(max_sustained_minutes, 0.0) AS max_sustained_minutes,
  coalesce(avg_focus_window_minutes, 0.0) AS avg_focus_window_minutes, coalesce(focus_window_count, 0) AS focus_window_count,
  coalesce(longest_gap_minutes, 0.0) AS longest_gap_minutes, coalesce(focus_consistency, 0.0) AS focus_consistency
FROM (SELECT user_id, day, count(*) AS session_count, sum(duration_seconds) AS total_active_seconds, avg(duration_seconds) AS avg_session_seconds,
    max(duration_seconds) AS longest_session_seconds, sum(keys)::BIGINT AS total_keys, sum(clicks)::BIGINT AS total_clicks, sum(mouse_distance)::BIGINT AS total_mouse_distance,
    sum(switched)::BIGINT AS app_switch_count, count(CASE WHEN class = 'focused' THEN 1 END) AS focused_sessions, count(CASE WHEN class = 'passive' THEN 1 END) AS passive_sessions,
    count(CASE WHEN class = 'mixed' THEN 1 END) AS mixed_sessions, count(CASE WHEN class = 'idle-heavy' THEN 1 END) AS idle_heavy_sessions,
    sum(CASE WHEN class = 'focused' THEN duration_seconds ELSE 0.0 END) / sum(duration_seconds) AS focus_ratio,
    count(*) / (sum(duration_seconds) / 3600.0) AS fragmentation_index, (sum(keys) + sum(clicks)) / (sum(duration_seconds) / 60.0) AS input_density,
    sum(switched) / count(*) AS avg_app_switches_per_session
  FROM (SELECT *, CASE WHEN lag(apps) OVER (PARTITION BY user_id, day ORDER BY start_time) <> apps THEN 1 ELSE 0 END AS switched FROM sess_class) s GROUP BY 1, 2) b
JOIN (SELECT user_id, day, app AS most_used_app, max(app_seconds) OVER (PARTITION BY user_id, day) AS most_used_app_seconds,
    row_number() OVER (PARTITION BY user_id, day ORDER BY round(app_seconds, 6) DESC, app) AS r FROM app_days) a ON a.user_id = b.user_id AND a.day = b.day AND r = 1
LEFT JOIN day_entropy e ON e.user_id = b.user_id AND e.day = b.day LEFT JOIN day_focus f ON f.user_id = b.user_id AND f.day = b.day
""")

DAILY_INT = ["session_count", "total_keys", "total_clicks", "total_mouse_distance", "app_switch_count", "focused_sessions", "passive_sessions",
             "mixed_sessions", "idle_heavy_sessions", "focus_window_count"]
DAILY_NUM = ["total_active_seconds", "avg_session_seconds", "longest_session_seconds", "focus_ratio", "fragmentation_index", "input_density",
             "avg_app_switches_per_session", "most_used_app_seconds", "context_switch_entropy", "focus_continuity_score", "max_sustained_minutes",
             "avg_focus_window_minutes", "longest_gap_minutes", "focus_consistency"]


def rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def daily_table(spark, sf):
    return stored(spark, sf, "daily", lambda: daily.daily_summary(
        src.sessions(spark, sf), daily.session_apps(src.interval_signals(spark, sf))))


@query("session_classes", "H22 H23", with_views("sess_class") + """
SELECT session_id, class, round(input_per_minute, 6) AS input_per_minute, round(intensity, 6) AS intensity, round(app_diversity, 6) AS app_diversity,
  round(s_minutes, 6) AS minutes FROM sess_class""")
def session_classes(spark, sf):
    return daily.with_class(src.sessions(spark, sf)).select("session_id", "class", "input_per_minute", "intensity", "app_diversity", "minutes")


@query("daily_summary", "D23 D24 D25 D26 C18", with_views("daily") + f"SELECT user_id, day::VARCHAR AS day, most_used_app, {', '.join(DAILY_INT)}, {rounded(DAILY_NUM)} FROM daily")
def daily_summary(spark, sf):
    return daily_table(spark, sf).select("user_id", "day", "most_used_app", *DAILY_INT, *DAILY_NUM)


@query("daily_app_time", "D23", with_views("daily", "app_days") + """
SELECT user_id, day::VARCHAR AS day, app, round(app_seconds, 6) AS app_seconds,
  round(app_seconds / total_active_seconds * 100, 6) AS app_percent FROM app_days JOIN daily USING (user_id, day)""")
def daily_app_time(spark, sf):
    apps = daily.app_days(src.sessions(spark, sf))
    totals = daily_table(spark, sf).select("user_id", "day", "total_active_seconds")
    return apps.join(totals, ["user_id", "day"]).select(
        "user_id", "day", "app", "app_seconds", (F.col("app_seconds") / F.col("total_active_seconds") * 100).alias("app_percent"))


@query("switch_entropy", "D24", with_views("day_entropy") + "SELECT user_id, day::VARCHAR AS day, round(context_switch_entropy, 6) AS context_switch_entropy FROM day_entropy")
def switch_entropy(spark, sf):
    return daily.switch_entropy(daily.session_apps(src.interval_signals(spark, sf)))


@query("focus_continuity", "D25 D26 C18", with_views("day_focus") + f"SELECT user_id, day::VARCHAR AS day, focus_window_count, {rounded(DAILY_NUM[9:])} FROM day_focus")
def focus_continuity(spark, sf):
    return daily.sustained(src.sessions(spark, sf))


@query("daily_task_time", "D27", with_views("front") + """
SELECT user_id, CAST(timestamp_start AS DATE)::VARCHAR AS day, task_id, round(sum(minutes) * 60, 6) AS seconds,
  count(CASE WHEN prev <> task_id THEN 1 END) AS switches_into FROM (
  SELECT *, lag(task_id) OVER (PARTITION BY user_id, session_id ORDER BY timestamp_start, event_id) AS prev FROM front) t GROUP BY 1, 2, 3""")
def daily_task_time(spark, sf):
    iv = src.interval_signals(spark, sf).filter("session_id is not null")
    return daily.task_days(iv.select("user_id", "session_id", "event_id", "task_id", F.col("timestamp_start").alias("start_time"), F.col("timestamp_end").alias("end_time")))


W = "(PARTITION BY user_id ORDER BY day)"
view("numday", ["daily"], "SELECT *, datediff('day', DATE '1970-01-01', day) AS dn FROM daily")


def delta(n: str, out: str, positive: bool = False) -> str:
    prev = f"lag({n}) OVER w"
    cond = f"lag(dn) OVER w = dn - 1" + (f" AND {prev} > 0" if positive else "")
    return f"round(CASE WHEN {cond} THEN {n} - {prev} END, 6) AS {out}"


DELTAS = ", ".join([delta("focus_ratio", "focus_ratio_delta"), delta("total_active_seconds", "active_time_delta"),
                    delta("fragmentation_index", "fragmentation_delta", True), delta("input_density", "input_density_delta", True)])


def versus(n: str, out: str) -> str:
    return f"round(CASE WHEN avg({n}) OVER p6 > 0 THEN ({n} - avg({n}) OVER p6) / avg({n}) OVER p6 * 100 END, 6) AS {out}"


VERSUS = ", ".join([versus("focus_ratio", "focus_ratio_vs_7day_pct"), versus("total_active_seconds", "active_time_vs_7day_pct"),
                    versus("fragmentation_index", "fragmentation_vs_7day_pct"), versus("input_density", "input_density_vs_7day_pct")])


def label(n: str, out: str) -> str:
    cv = f"CASE WHEN avg({n}) OVER r7 > 0 THEN stddev_samp({n}) OVER r7 / avg({n}) OVER r7 * 100 ELSE 0 END"
    return f"CASE WHEN count({n}) OVER r7 <= 1 THEN 'unknown' WHEN {cv} < 15 THEN 'low' WHEN {cv} < 35 THEN 'moderate' ELSE 'high' END AS {out}"


LABELS = ", ".join([label("avg_session_seconds", "session_duration_volatility"), label("focus_ratio", "focus_volatility"), label("total_active_seconds", "active_time_volatility")])


def mono(n: str, up: str, down: str) -> str:
    a, b = f"lag({n}, 2) OVER w", f"lag({n}) OVER w"
    return f"CASE WHEN {a} < {b} AND {b} < {n} THEN '{up}' WHEN {a} > {b} AND {b} > {n} THEN '{down}' END"


PATTERNS = f"""concat_ws('; ', {mono('fragmentation_index', 'Fragmentation increasing for 3+ consecutive days', 'Fragmentation decreasing for 3+ consecutive days')},
  {mono('focus_ratio', 'Focus ratio improving for 3+ consecutive days', 'Focus ratio declining for 3+ consecutive days')},
  CASE WHEN count(*) OVER r3 = 3 AND max(session_count) OVER r3 < 4 THEN 'Consistently few sessions (low fragmentation)'
       WHEN count(*) OVER r3 = 3 AND min(session_count) OVER r3 > 8 THEN 'Consistently many sessions (high fragmentation)' END,
  {mono('input_density', 'Input density increasing for 3+ days', 'Input density decreasing for 3+ days')},
  CASE WHEN count(*) OVER r7 >= 5 AND count(CASE WHEN total_active_seconds < 3600 THEN 1 END) OVER r7 >= 2 THEN 'Multiple very low-activity days' END,
  CASE WHEN count(*) OVER r7 >= 5 AND count(CASE WHEN total_active_seconds > 28800 THEN 1 END) OVER r7 >= 2 THEN 'Multiple high-activity days' END) AS patterns"""
WINDOWS = """WINDOW w AS (PARTITION BY user_id ORDER BY dn), p6 AS (PARTITION BY user_id ORDER BY dn RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING),
  r7 AS (PARTITION BY user_id ORDER BY dn ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), r3 AS (PARTITION BY user_id ORDER BY dn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  p7 AS (PARTITION BY user_id ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
DELTA_NAMES = ["focus_ratio_delta", "active_time_delta", "fragmentation_delta", "input_density_delta"]
VERSUS_NAMES = ["focus_ratio_vs_7day_pct", "active_time_vs_7day_pct", "fragmentation_vs_7day_pct", "input_density_vs_7day_pct"]
LABEL_NAMES = ["session_duration_volatility", "focus_volatility", "active_time_volatility"]
N = with_views("numday")


@query("day_over_day", "G18 C15", N + f"SELECT user_id, day::VARCHAR AS day, {DELTAS} FROM numday {WINDOWS}")
def day_over_day(spark, sf):
    return trends.day_deltas(daily_table(spark, sf)).select("user_id", "day", *DELTA_NAMES)


@query("rolling_week_comparison", "G19", N + f"SELECT user_id, day::VARCHAR AS day, {VERSUS} FROM numday {WINDOWS}")
def rolling_week_comparison(spark, sf):
    return trends.against_week(daily_table(spark, sf)).select("user_id", "day", *VERSUS_NAMES)


@query("volatility", "G20", N + f"SELECT user_id, day::VARCHAR AS day, {LABELS} FROM numday {WINDOWS}")
def volatility(spark, sf):
    return trends.volatility(daily_table(spark, sf)).select("user_id", "day", *LABEL_NAMES)


@query("pattern_flags", "G21", N + f"SELECT user_id, day::VARCHAR AS day, {PATTERNS} FROM numday {WINDOWS}")
def pattern_flags(spark, sf):
    return trends.pattern_flags(daily_table(spark, sf)).select("user_id", "day", "patterns")


@query("trend_metrics", "G22", N + f"""SELECT user_id, day::VARCHAR AS day, round(focus_ratio, 6) AS focus_ratio, session_count, {DELTAS}, {VERSUS}, {LABELS}, {PATTERNS} FROM numday {WINDOWS}""")
def trend_metrics(spark, sf):
    return trends.trend_metrics(daily_table(spark, sf)).select("user_id", "day", "focus_ratio", "session_count", *DELTA_NAMES, *VERSUS_NAMES, *LABEL_NAMES, "patterns")


WEEK = {"active_time": "total_active_seconds", "avg_session": "avg_session_seconds", "focus_ratio": "focus_ratio", "fragmentation": "fragmentation_index", "input_density": "input_density"}
view("weekly", ["numday"], "SELECT *, count(*) OVER p7 AS baseline_days, " + ", ".join(
    f"avg({c}) OVER p7 AS {n}_mean, CASE WHEN count(*) OVER p7 = 1 THEN 0.0 ELSE stddev_samp({c}) OVER p7 END AS {n}_std" for n, c in WEEK.items()) + f" FROM numday {WINDOWS}")
WEEK_NAMES = [f"{n}_{s}" for n in WEEK for s in ("mean", "std")]


@query("weekly_baseline", "G23", with_views("weekly") + f"SELECT user_id, day::VARCHAR AS day, baseline_days, {rounded(WEEK_NAMES)} FROM weekly")
def weekly_baseline(spark, sf):
    return trends.weekly_baseline(daily_table(spark, sf)).select("user_id", "day", "baseline_days", *WEEK_NAMES)


ZS = ["active_time", "focus_ratio", "fragmentation", "input_density"]
view("zscores", ["weekly"], "SELECT *, " + ", ".join(f"CASE WHEN {n}_std > 0 THEN ({WEEK[n]} - {n}_mean) / {n}_std END AS {n}_z" for n in ZS) + " FROM weekly")


@query("weekly_deviations", "G24", with_views("zscores") + f"""SELECT user_id, day::VARCHAR AS day, {rounded([n + '_z' for n in ZS])}, concat_ws('; ', {', '.join(
    f"CASE WHEN abs({n}_z) >= 1.8 THEN '{n}' || CASE WHEN {n}_z > 0 THEN ' above' ELSE ' below' END END" for n in ZS)},
  CASE WHEN input_density_z > 1.8 AND active_time_z < 1.0 THEN 'input spike without active time' END) AS notes FROM zscores""")
def weekly_deviations(spark, sf):
    return trends.deviations(daily_table(spark, sf)).select("user_id", "day", *[f"{n}_z" for n in ZS], "notes")


@query("stable_patterns", "G25", with_views("weekly", "app_days") + """,
week AS (SELECT t.user_id, t.day, count(*) AS recent_days, count(CASE WHEN r.avg_session_seconds < t.avg_session_mean - t.avg_session_std THEN 1 END) AS shorter_days,
    count(CASE WHEN r.avg_session_seconds > t.avg_session_mean + t.avg_session_std THEN 1 END) AS longer_days,
    count(CASE WHEN r.focus_ratio > t.focus_ratio_mean + t.focus_ratio_std THEN 1 END) AS high_focus_days,
    count(CASE WHEN r.focus_ratio < t.focus_ratio_mean - t.focus_ratio_std THEN 1 END) AS low_focus_days
  FROM weekly t JOIN weekly r ON r.user_id = t.user_id AND r.dn BETWEEN t.dn - 6 AND t.dn GROUP BY 1, 2),
aw AS (SELECT t.user_id, t.day, a.app, sum(a.app_seconds) AS secs FROM weekly t JOIN app_days a ON a.user_id = t.user_id
    AND a.day BETWEEN t.day - 6 AND t.day GROUP BY 1, 2, 3),
top AS (SELECT user_id, day, app AS dominant_app, max(pct) OVER (PARTITION BY user_id, day) AS dominant_pct,
    row_number() OVER (PARTITION BY user_id, day ORDER BY round(pct, 6) DESC, app) AS rk
  FROM (SELECT *, secs / sum(secs) OVER (PARTITION BY user_id, day) * 100 AS pct FROM aw) x WHERE pct >= 50),
runs AS (SELECT user_id, dn, lag(dn, 3) OVER w AS s, lag(fragmentation_index, 3) OVER w < lag(fragmentation_index, 2) OVER w
    AND lag(fragmentation_index, 2) OVER w < lag(fragmentation_index) OVER w AND lag(fragmentation_index) OVER w < fragmentation_index AS up
  FROM weekly WINDOW w AS (PARTITION BY user_id ORDER BY dn)),
rise AS (SELECT t.user_id, t.day, count(r.dn) > 0 AS fragmentation_rising FROM weekly t LEFT JOIN runs r ON r.user_id = t.user_id AND r.up AND r.dn <= t.dn AND r.s >= t.dn - 6 GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, recent_days, shorter_days, longer_days, high_focus_days, low_focus_days, dominant_app, round(dominant_pct, 6) AS dominant_pct, fragmentation_rising,
  concat_ws('; ', dominant_app || ' dominates', CASE WHEN shorter_days >= 4 THEN 'shorter sessions' END, CASE WHEN longer_days >= 4 THEN 'longer sessions' END,
    CASE WHEN high_focus_days >= 4 THEN 'higher focus' END, CASE WHEN low_focus_days >= 4 THEN 'lower focus' END, CASE WHEN fragmentation_rising THEN 'rising fragmentation' END) AS patterns
FROM week LEFT JOIN (SELECT * FROM top WHERE rk = 1) top USING (user_id, day) JOIN rise USING (user_id, day)""")
def stable_patterns(spark, sf):
    return trends.stable_patterns(daily_table(spark, sf), daily.app_days(src.sessions(spark, sf))).select(
        "user_id", "day", "recent_days", "shorter_days", "longer_days", "high_focus_days", "low_focus_days", "dominant_app", "dominant_pct",
        "fragmentation_rising", "patterns")
