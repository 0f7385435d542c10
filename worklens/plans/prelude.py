"""The views of sources.tables as SQL, for the comparison engine."""

from __future__ import annotations

CTE: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], body: str) -> None:
    CTE[name] = (needs, body.strip())


def with_views(*names: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done)


view("ev", [], """
SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
""")

view("flat", ["ev"], """
SELECT event_id, user_id, ts AS timestamp_start, ts + to_minutes(10 + 6 * k) AS timestamp_end,
  CASE event_type WHEN 'click' THEN 'chrome.exe' WHEN 'view' THEN 'firefox.exe' WHEN 'purchase' THEN 'excel.exe'
    WHEN 'signup' THEN 'slack.exe' WHEN 'error' THEN 'code.exe' END AS app,
  list_extract(['main.py - Visual Studio Code', 'GitHub - Pull Request #123 – Mozilla Firefox', 'YouTube - How to Python',
    'Stack Overflow - Python question', 'Inbox - Microsoft Outlook', 'Chat - John Doe', 'Call - Team Meeting',
    'Documents - File Explorer', 'Windows PowerShell', 'Some random window'], (k % 10) + 1) AS window_title,
  value AS keyboard_intensity, (k % 25) * 60 AS mouse_clicks, value * 10 AS mouse_distance,
  k % 4 AS copy_count, k % 3 AS paste_count, k % 2 AS cut_count, k % 5 = 0 AS mic_active, k % 7 = 0 AS camera_active,
  (k % 10) / 10.0::DOUBLE AS audio_volume, k / 100.0::DOUBLE AS cpu_usage, ((k * 7) % 100) / 100.0::DOUBLE AS ram_usage,
  CASE WHEN k % 3 <> 0 THEN ((k * 13) % 100) / 100.0::DOUBLE END AS gpu_usage,
  CASE WHEN hour(ts) >= 5 AND hour(ts) < 12 THEN 'morning' WHEN hour(ts) >= 12 AND hour(ts) < 17 THEN 'afternoon'
    WHEN hour(ts) >= 17 AND hour(ts) < 21 THEN 'evening' ELSE 'night' END AS time_of_day,
  isodow(ts) - 1 AS day_of_week, isodow(ts) - 1 >= 5 AS is_weekend, hour(ts) >= 9 AND hour(ts) < 17 AS is_work_hours,
  event_type = 'view' AS is_background, 'T' || (k % 5)::VARCHAR AS task_id, k,
  10.0::DOUBLE + 6 * k AS minutes
FROM ev
""")

view("scored", ["flat"], """
SELECT *, least(1.0, greatest(0.0, 0.5 * input_score + 0.3 * system_score + 0.2 * audio_context_score)) AS focus_score FROM (
  SELECT *,
    (least(keyboard_intensity, 60.0) / 60.0 + least(mouse_clicks / minutes, 10.0) / 10.0) / 2.0 AS input_score,
    CASE WHEN gpu_usage IS NULL THEN (cpu_usage + ram_usage) / 2.0 ELSE (cpu_usage + ram_usage + gpu_usage) / 3.0 END AS system_score,
    1.0 - least(1.0, 0.4 * mic_active::INT + 0.4 * camera_active::INT + 0.2 * audio_volume) AS audio_context_score
  FROM flat) t
""")

view("front", ["scored"], """
SELECT *, user_id::VARCHAR || '-' || (epoch_us(max(CASE WHEN brk = 1 THEN timestamp_start END) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id)) // 1000000)::VARCHAR AS session_id FROM (
  SELECT *, CASE WHEN epoch_us(timestamp_start) - epoch_us(max(timestamp_end) OVER (PARTITION BY user_id ORDER BY timestamp_start, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) < 18000000000 THEN 0 ELSE 1 END AS brk
  FROM scored WHERE NOT is_background) t
""")

view("iv", ["front"], """
SELECT * EXCLUDE (brk) FROM front
UNION ALL BY NAME SELECT *, NULL::VARCHAR AS session_id FROM scored WHERE is_background
""")

view("sess", ["front"], """
SELECT *, (n_apps - 1) / 4.0::DOUBLE AS entropy, 'dev' || (user_id % 3)::VARCHAR AS device_id,
  (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS duration_seconds
FROM (SELECT user_id, session_id, min(timestamp_start) AS start_time, max(timestamp_end) AS end_time,
    sum(trunc(keyboard_intensity * minutes))::BIGINT AS keys, sum(mouse_clicks)::BIGINT AS clicks,
    sum(trunc(mouse_distance))::BIGINT AS mouse_distance, count(*) AS total_events, count(DISTINCT app) AS n_apps,
    list_sort(list(DISTINCT app)) AS apps, min_by(task_id, epoch_us(timestamp_start)) AS task_id, avg(focus_score) AS focus_continuity
  FROM front GROUP BY user_id, session_id) t
""")

view("task_events", ["ev"], """
SELECT user_id, ts, event_id, 'T' || (k % 5)::VARCHAR AS task_id, CASE event_type WHEN 'click' THEN 'ACTIVE' WHEN 'view' THEN 'ACTIVE'
  WHEN 'purchase' THEN 'PAUSED' WHEN 'signup' THEN 'COMPLETED' ELSE 'ABANDONED' END AS state FROM ev
""")

view("state_events", ["ev"], """
SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'IDLE' ELSE 'ACTIVE_ALIGNED' END AS state
FROM ev WHERE event_type IN ('error', 'signup')
""")

view("cand", ["ev"], """
SELECT user_id, ts, event_id, CASE WHEN k < 30 THEN 'IDLE' WHEN k < 60 THEN 'ACTIVE_UNALIGNED' ELSE 'ACTIVE_ALIGNED' END AS candidate FROM ev
""")

view("raw_inputs", ["ev", "flat"], """
SELECT ev.user_id, ts, ev.event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'key' ELSE 'move' END AS kind,
  value AS amount, flat.app, flat.window_title, ev.k FROM ev JOIN flat USING (event_id)
""")

view("task_segments", ["front"], """
SELECT event_id AS segment_id, user_id, session_id, list_extract(['Administrative Work - ChatGPT', 'deep_development', 'Technical Research: docs', 'T3',
    'team_meeting | zoom.exe', 'Strategic Planning'], (k % 6) + 1) AS task_id, timestamp_start AS start_time, CASE WHEN k % 17 <> 0 THEN timestamp_end END AS end_time,
  ((k * 37) % 100) / 100.0::DOUBLE AS confidence, list_extract(['initial_administrative_work', 'continuing_deep_development', 'window_change',
    'behavioral_transition_admin_to_coding', 'app_change_a_to_b', 'transition', 'behavioral_team_meeting'], (k % 7) + 1) AS reason, (k % 50) / 100.0::DOUBLE AS distance,
  k % 29 <> 0 AS is_json, app, window_title, k, minutes FROM front
""")

view("session_minutes", ["front"], """
SELECT user_id, session_id, date_trunc('minute', timestamp_start) AS minute, sum(trunc(keyboard_intensity))::BIGINT AS keys, sum(mouse_clicks)::BIGINT AS clicks,
  sum(trunc(mouse_distance))::BIGINT AS mouse_distance FROM front GROUP BY 1, 2, 3
""")

view("state_changes", ["ev"], """
SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'IDLE' WHEN k < 50 THEN 'ACTIVE_UNALIGNED' ELSE 'ACTIVE_ALIGNED' END AS state,
  'T' || (k % 5)::VARCHAR AS active_task, 'r' || (k % 3)::VARCHAR AS reason, k / 100.0::DOUBLE AS confidence FROM ev WHERE event_type IN ('error', 'signup')
""")

view("wide", [], """
SELECT l_suppkey AS key, l_shipdate AS start_time, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS end_time, l_returnflag AS app, CAST(l_quantity AS BIGINT) AS keys,
  CAST(l_linenumber AS BIGINT) AS clicks, CAST(trunc(l_extendedprice) AS BIGINT) AS mouse_distance, l_linestatus AS intent, l_orderkey, l_linenumber FROM lineitem
""")

view("lifecycle_log", ["ev"], """
SELECT user_id, 'S' || (k % 3)::VARCHAR AS session_id, ts, event_id, CASE event_type WHEN 'click' THEN 'START' WHEN 'view' THEN 'PAUSE' WHEN 'purchase' THEN 'RESUME'
  WHEN 'signup' THEN 'END' ELSE 'REOPEN' END AS command FROM ev
""")
