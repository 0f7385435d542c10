"""Tasks out of segments: chains, names, summaries and neighbour distances."""

from pyspark.sql import functions as F

from worklens.functions import rules
from worklens.operators import cohesion, density, insights, linkage, scans, tasks
from worklens.plans import segment_queries, table_queries  # noqa: F401  (define the segment views)
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.plans.text_queries import any_of, q, title_case_sql, words_sql
from worklens.session import stored
from worklens.sources import sinks
from worklens.sources import tables as src


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(list_transform({words_sql(c, False)}, lambda w: trim(w, '[](){{}}:;,.\"''')), lambda w: length(w) > 2 AND NOT list_contains({q(rules.CLUSTER_STOPWORDS)}, w)))"


FAMILY = "CASE WHEN p_app = app THEN 1.0 " + " ".join(f"WHEN {any_of('lower(p_app)', parts)} AND {any_of('lower(app)', parts)} THEN {score}" for parts, score in rules.SIMILARITY_FAMILIES) + " ELSE 0.0 END"
SIMILAR_SQL = f"""{FAMILY} AS s_app, CASE WHEN len(p_tok) = 0 OR len(tok) = 0 THEN 0.5 ELSE len(list_intersect(p_tok, tok)) / len(list_distinct(p_tok || tok)) END AS s_window,
  CASE WHEN gap <= 0 THEN 1.0 WHEN gap > 30 THEN 0.0 ELSE pow(2.0, -gap / 10) END AS s_temporal,
  (1 - abs(least(p_kb, 100) / 100 - least(keyboard_intensity_avg, 100) / 100) + 1 - abs(least(p_mouse, 20) / 20 - least(mouse_intensity_avg, 20) / 20) + 1 - abs(least(p_cp, 50) / 50.0 - least(total_copy_events + total_paste_events, 50) / 50.0)) / 3 AS s_interaction,
  (1 - abs(p_mic - mic_active_ratio)) * 0.4 + (1 - abs(p_cam - camera_active_ratio)) * 0.4 + (1 - abs(p_vol - max_audio_volume)) * 0.2 AS s_av,
  CASE WHEN p_gpu IS NULL OR mean_gpu_usage IS NULL THEN (2 - abs(p_cpu - mean_cpu_usage) - abs(p_ram - mean_ram_usage)) / 2 ELSE (3 - abs(p_cpu - mean_cpu_usage) - abs(p_ram - mean_ram_usage) - abs(p_gpu - mean_gpu_usage)) / 3 END AS s_system,
  (1 - abs(p_mt - multitasking_score) + 1 - abs(p_act - activity_score) + CASE WHEN (p_act > 0.3) = (activity_score > 0.3) THEN 1.0 ELSE 0.3 END) / 3 AS s_behavior"""
view("pairs", ["seg"], f"""
SELECT *, {SIMILAR_SQL}
FROM (SELECT *, lag(end_time) OVER w AS p_end, (epoch_us(start_time) - epoch_us(lag(end_time) OVER w)) / 6e7 AS gap, lag(app) OVER w AS p_app, lag(tok) OVER w AS p_tok, lag(keyboard_intensity_avg) OVER w AS p_kb, lag(mouse_intensity_avg) OVER w AS p_mouse,
    lag(total_copy_events + total_paste_events) OVER w AS p_cp, lag(mic_active_ratio) OVER w AS p_mic, lag(camera_active_ratio) OVER w AS p_cam, lag(max_audio_volume) OVER w AS p_vol, lag(mean_cpu_usage) OVER w AS p_cpu, lag(mean_ram_usage) OVER w AS p_ram,
    lag(mean_gpu_usage) OVER w AS p_gpu, lag(multitasking_score) OVER w AS p_mt, lag(activity_score) OVER w AS p_act
  FROM (SELECT *, primary_app AS app, {tokens_sql('primary_window_title')} AS tok FROM seg) x WINDOW w AS (PARTITION BY user_id ORDER BY start_time, segment_no)) y
""")
view("sim", ["pairs"], """
SELECT *, s_app * 0.25 + s_window * 0.15 + s_temporal * 0.15 + s_interaction * 0.15 + s_av * 0.10 + s_system * 0.10 + s_behavior * 0.10 AS similarity FROM pairs
""")
view("chained", ["sim"], """
SELECT *, sum(CASE WHEN p_end IS NULL OR gap > 3000 OR similarity < 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_time, segment_no)::BIGINT - 1 AS cluster,
  CASE WHEN NOT (p_end IS NULL OR gap > 3000 OR similarity < 0.6) THEN similarity END AS link FROM sim
""")


def chained(spark, sf):
    return stored(spark, sf, "chained_segments", lambda: tasks.chain_segments(src.segments(spark, sf), ["user_id"], 3000, 0.6))


def task_table(spark, sf):
    return stored(spark, sf, "tasks", lambda: tasks.tasks_of(chained(spark, sf), ["user_id"]))


view("every_pair", ["chained"], f"""
SELECT user_id, cluster, segment_no, s_app * 0.25 + s_window * 0.15 + s_temporal * 0.15 + s_interaction * 0.15 + s_av * 0.10 + s_system * 0.10 + s_behavior * 0.10 AS similarity FROM (SELECT *, {SIMILAR_SQL} FROM (
  SELECT (epoch_us(c.start_time) - epoch_us(p.end_time)) / 6e7 AS gap, p.app AS p_app, p.tok AS p_tok, p.keyboard_intensity_avg AS p_kb, p.mouse_intensity_avg AS p_mouse, p.total_copy_events + p.total_paste_events AS p_cp, p.mic_active_ratio AS p_mic,
    p.camera_active_ratio AS p_cam, p.max_audio_volume AS p_vol, p.mean_cpu_usage AS p_cpu, p.mean_ram_usage AS p_ram, p.mean_gpu_usage AS p_gpu, p.multitasking_score AS p_mt, p.activity_score AS p_act,
    c.* EXCLUDE (gap, p_app, p_tok, p_kb, p_mouse, p_cp, p_mic, p_cam, p_vol, p_cpu, p_ram, p_gpu, p_mt, p_act, s_app, s_window, s_temporal, s_interaction, s_av, s_system, s_behavior, similarity)
  FROM chained c JOIN chained p ON p.user_id = c.user_id AND p.cluster = c.cluster AND (p.start_time, p.segment_no) < (c.start_time, c.segment_no)) x) y
""")


@query("task_cohesion", "D13", with_views("every_pair") + """
SELECT c.user_id, c.cluster, c.segments, round(coalesce(p.similarity, 1.0), 6) AS mean_similarity FROM (SELECT user_id, cluster, count(*) AS segments FROM chained GROUP BY 1, 2) c
LEFT JOIN (SELECT user_id, cluster, avg(similarity) AS similarity FROM every_pair GROUP BY 1, 2) p ON p.user_id = c.user_id AND p.cluster = c.cluster""")
def task_cohesion(spark, sf):
    return cohesion.mean_similarity(chained(spark, sf), ["user_id", "cluster"])


PARTS = {"app": "s_app", "window": "s_window", "temporal": "s_temporal", "interaction": "s_interaction", "audio_video": "s_av", "system": "s_system", "behavioral": "s_behavior"}


@query("segment_similarity", "H30 H09 S01 C10", with_views("sim") + "SELECT user_id, segment_id, " + ", ".join(f"round({c}, 6) AS {n}_similarity" for n, c in PARTS.items())
       + ", round(similarity, 6) AS similarity FROM sim WHERE p_end IS NOT NULL")
def segment_similarity(spark, sf):
    rows = tasks.neighbour_similarity(src.segments(spark, sf), ["user_id"])
    return rows.select("user_id", "segment_id", *[f"{n}_similarity" for n in PARTS], "similarity")


@query("chained_segments", "J06", with_views("chained") + "SELECT user_id, segment_id, cluster, round(link, 6) AS link_similarity FROM chained")
def chained_segments(spark, sf):
    return chained(spark, sf).select("user_id", "segment_id", "cluster", "link_similarity")


view("task_rows", ["chained"], f"""
SELECT b.*, p.app AS primary_app, p.apps_used, w.title_pattern, 'task_' || strftime(start_time, '%Y%m%d_%H%M%S') || '_' || b.cluster::VARCHAR AS task_id,
  {title_case_sql("replace(replace(p.app, '.exe', ''), '_', ' ')")} || CASE WHEN length(title_pattern) > 3 THEN ': ' || {title_case_sql('title_pattern')} ELSE '' END
    || CASE WHEN is_multitasking THEN ' (Multitasking)' WHEN is_active THEN ' (Active)' ELSE ' (Passive)' END AS task_name
FROM (SELECT user_id, cluster, min(start_time) AS start_time, arg_max(end_time, epoch_us(start_time)) AS end_time, count(*) AS segments, sum(duration_minutes) AS duration_minutes, avg(activity_score) AS avg_activity, avg(mean_cpu_usage) AS avg_cpu,
    avg(mean_ram_usage) AS avg_ram, sum(total_keyboard_keys)::BIGINT AS total_keys, sum(total_copy_events + total_paste_events)::BIGINT AS copy_paste, sum((multitasking_score > 0.5)::INT) > count(*) / 2 AS is_multitasking,
    sum((activity_score > 0.3)::INT) > count(*) / 2 AS is_active, coalesce(avg(link), 1.0) AS confidence FROM chained GROUP BY 1, 2) b
JOIN (SELECT user_id, cluster, app, count(*) OVER (PARTITION BY user_id, cluster) AS apps_used, row_number() OVER (PARTITION BY user_id, cluster ORDER BY round(sum(duration_minutes), 6) DESC, min(start_time)) AS r FROM chained GROUP BY 1, 2, 3) p
  ON p.user_id = b.user_id AND p.cluster = b.cluster AND p.r = 1
JOIN (SELECT user_id, cluster, string_agg(word, ' ' ORDER BY r) AS title_pattern FROM (SELECT user_id, cluster, word, row_number() OVER (PARTITION BY user_id, cluster ORDER BY count(*) DESC, min(epoch_us(start_time) * 100 + i)) AS r FROM (
    SELECT user_id, cluster, start_time, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT *, {words_sql('primary_window_title', False)} AS ws FROM chained) a) b2 GROUP BY 1, 2, 3) c2 WHERE r <= 3 GROUP BY 1, 2) w
  ON w.user_id = b.user_id AND w.cluster = b.cluster
""")
TASK_NUM = ["duration_minutes", "avg_activity", "avg_cpu", "avg_ram", "confidence"]
TASK_TEXT = ["user_id", "cluster", "task_id", "task_name", "start_time", "end_time", "segments", "primary_app", "apps_used", "title_pattern", "total_keys", "copy_paste", "is_multitasking", "is_active"]


@query("recognized_tasks", "D11 D12 D13 H39 J07", with_views("task_rows") + f"SELECT {', '.join(TASK_TEXT)}, {', '.join(f'round({c}, 6) AS {c}' for c in TASK_NUM)} FROM task_rows")
def recognized_tasks(spark, sf):
    return task_table(spark, sf).select(*TASK_TEXT, *TASK_NUM)


@query("task_summary", "D14", with_views("task_rows") + """
SELECT count(*) AS task_count, round(sum(duration_minutes) / 60, 6) AS hours, round(avg(duration_minutes), 6) AS avg_minutes, round(avg(confidence), 6) AS avg_confidence, round(avg(is_active::INT), 6) AS active_ratio, round(avg(is_multitasking::INT), 6) AS multitasking_ratio FROM task_rows""")
def task_summary(spark, sf):
    return tasks.task_summary(task_table(spark, sf))


@query("top_task_apps", "D14 F05", with_views("task_rows") + "SELECT primary_app, round(sum(duration_minutes) / 60, 6) AS hours FROM task_rows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_task_apps(spark, sf):
    return tasks.top_task_apps(task_table(spark, sf))


view("enriched", ["task_rows", "chained"], """
SELECT t.*, s.* EXCLUDE (user_id, cluster), m.session_id FROM task_rows t JOIN (
  SELECT user_id, cluster, coalesce(avg(mean_gpu_usage), 0.0) AS avg_gpu, avg(max_audio_volume) AS audio_volume, avg(mic_active_ratio) >= 0.5 AS mic_on, avg(camera_active_ratio) >= 0.5 AS camera_on, sum(total_copy_events)::BIGINT AS copy_count,
    sum(total_paste_events)::BIGINT AS paste_count, avg(keyboard_intensity_avg) AS keyboard_intensity, sum(total_mouse_clicks)::BIGINT AS mouse_activity FROM chained GROUP BY 1, 2) s ON s.user_id = t.user_id AND s.cluster = t.cluster
LEFT JOIN (SELECT user_id, cluster, session_id, row_number() OVER (PARTITION BY user_id, cluster ORDER BY count(*) DESC, min(start_time)) AS r FROM chained WHERE session_id IS NOT NULL GROUP BY 1, 2, 3) m ON m.user_id = t.user_id AND m.cluster = t.cluster AND m.r = 1
""")


@query("enriched_tasks", "D15 A09", with_views("enriched") + """
SELECT user_id, task_id, session_id, round(avg_gpu, 6) AS avg_gpu, round(audio_volume, 6) AS audio_volume, mic_on, camera_on, copy_count, paste_count, round(keyboard_intensity, 6) AS keyboard_intensity, mouse_activity, true AS has_json FROM enriched""")
def enriched_tasks(spark, sf):
    rows = sinks.with_raw_json(tasks.enriched_records(chained(spark, sf), task_table(spark, sf), ["user_id"]))
    return rows.select("user_id", "task_id", "session_id", "avg_gpu", "audio_volume", "mic_on", "camera_on", "copy_count", "paste_count", "keyboard_intensity", "mouse_activity",
                       (F.get_json_object("raw_json", "$.task_id") == F.col("task_id")).alias("has_json"))


@query("task_resource_usage", "D37 B09", with_views("chained") + """
SELECT user_id, cluster, round(avg(mean_cpu_usage), 6) AS cpu_avg, round(avg(mean_ram_usage), 6) AS ram_avg, round(avg(mean_gpu_usage), 6) AS gpu_avg, round(sum(duration_minutes), 6) AS duration_minutes,
  avg(mean_cpu_usage) >= 0.7 OR avg(mean_ram_usage) >= 0.8 AS heavy FROM chained GROUP BY 1, 2""")
def task_resource_usage(spark, sf):
    use = insights.task_resource_usage(chained(spark, sf), ["user_id", "cluster"])
    heavy = insights.heavy_tasks(use).select("user_id", "cluster", F.lit(True).alias("heavy"))
    return use.join(heavy, ["user_id", "cluster"], "left").na.fill(False, ["heavy"])


CAT = lambda c: "CASE " + " ".join(f"WHEN {any_of(f'lower({c})', parts)} THEN '{n}'" for n, parts in rules.APP_CATEGORIES) + " ELSE 'other' END"


def dist_tokens(c: str) -> str:
    return f"list_filter({words_sql(c)}, lambda w: length(w) > 1 AND NOT list_contains({q(rules.DISTANCE_STOPWORDS)}, w))"


PART_SQL = f"""CASE WHEN len(p_tok) = 0 OR len(tok) = 0 THEN 1.0 ELSE 1 - least(1.0, greatest(0.0, list_sum(list_transform(list_distinct(tok), lambda w: len(list_filter(tok, lambda v: v = w)) * len(list_filter(p_tok, lambda v: v = w))))
    / (sqrt(list_sum(list_transform(list_distinct(tok), lambda w: pow(len(list_filter(tok, lambda v: v = w)), 2)))) * sqrt(list_sum(list_transform(list_distinct(p_tok), lambda w: pow(len(list_filter(p_tok, lambda v: v = w)), 2))))))) END AS d_text,
  CASE WHEN lower(p_app) = lower(app) THEN 0.0 WHEN {CAT('p_app')} = {CAT('app')} THEN 0.3 ELSE 1.0 END AS d_app, least(abs(epoch_us(start_time) - epoch_us(p_start)) / 6e7 / 3600, 1.0) AS d_time,
  CASE WHEN p_task = 'unknown' OR generic_task = 'unknown' THEN 0.5 WHEN p_task = generic_task THEN 0.0 WHEN (p_task IN ('deep_development', 'technical_research') AND generic_task IN ('deep_development', 'technical_research'))
    OR (p_task IN ('team_meeting', 'administrative_work') AND generic_task IN ('team_meeting', 'administrative_work')) THEN 0.4 ELSE 1.0 END AS d_task"""
TOK = dist_tokens("CASE WHEN normalized_title <> '' THEN normalized_title ELSE window_title END")
view("nb", ["closed"], f"""
SELECT *, {PART_SQL}
FROM (SELECT *, lag(tok) OVER w AS p_tok, lag(app) OVER w AS p_app, lag(start_time) OVER w AS p_start, lag(generic_task) OVER w AS p_task FROM (
  SELECT *, {TOK} AS tok FROM closed) a WINDOW w AS (PARTITION BY session_id ORDER BY start_time, segment_id)) b
""")
view("nd", ["nb"], "SELECT *, CASE WHEN p_start IS NOT NULL THEN 0.4 * d_text + 0.3 * d_app + 0.2 * d_time + 0.1 * d_task END AS distance FROM nb")


def closed(spark, sf):
    return scans.closed_segments(src.task_segments(spark, sf))


def distances(spark, sf):
    return stored(spark, sf, "neighbour_distances", lambda: tasks.neighbour_distances(closed(spark, sf), max_gap_minutes=3600))


@query("segment_distances", "H31 H10 C11", with_views("nd") + """
SELECT segment_id, round(d_text, 6) AS text_distance, round(d_app, 6) AS app_distance, round(d_time, 6) AS temporal_distance, round(d_task, 6) AS behavioral_distance, round(distance, 6) AS distance FROM nd WHERE p_start IS NOT NULL""")
def segment_distances(spark, sf):
    return distances(spark, sf).select("segment_id", "text_distance", "app_distance", "temporal_distance", "behavioral_distance", "distance")


def at(rank: str) -> str:
    return f"round(list_sort(list(distance))[{rank} + 1], 6)"


@query("distance_distribution", "D17 D44", with_views("nd") + f"""
SELECT user_id, count(*) AS pairs, round(min(distance), 6) AS lowest, round(max(distance), 6) AS highest, round(avg(distance), 6) AS mean, count(CASE WHEN distance < 0.3 THEN 1 END) AS very_similar, count(CASE WHEN distance >= 0.3 AND distance < 0.5 THEN 1 END) AS similar,
  count(CASE WHEN distance >= 0.5 THEN 1 END) AS different, {at('count(*) // 4')} AS q1, {at('count(*) // 2')} AS q2, {at('count(*) * 3 // 4')} AS q3 FROM nd WHERE distance IS NOT NULL GROUP BY 1""")
def distance_distribution(spark, sf):
    return tasks.distance_distribution(distances(spark, sf), ["user_id"])


view("nclust", ["nd"], "SELECT *, sum(CASE WHEN distance <= 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY start_time, segment_id)::BIGINT - 1 AS cluster FROM nd")


@query("merged_neighbours", "D16 J08 J03", with_views("nclust") + f"""
, w AS (SELECT session_id, cluster, string_agg(upper(word[1]) || word[2:], ' ' ORDER BY r) AS words FROM (SELECT session_id, cluster, word, row_number() OVER (PARTITION BY session_id, cluster ORDER BY count(*) DESC, min(epoch_us(start_time) * 100 + i)) AS r FROM (
  SELECT session_id, cluster, start_time, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT *, {words_sql('normalized_title', False)} AS ws FROM nclust WHERE normalized_title <> '') a) b WHERE length(word) > 2 GROUP BY 1, 2, 3) c WHERE r <= 3 GROUP BY 1, 2),
m1 AS (SELECT session_id, cluster, app, row_number() OVER (PARTITION BY session_id, cluster ORDER BY count(*) DESC, min(start_time)) AS r FROM nclust GROUP BY 1, 2, 3),
m2 AS (SELECT session_id, cluster, generic_task, row_number() OVER (PARTITION BY session_id, cluster ORDER BY count(*) DESC, min(start_time)) AS r FROM nclust GROUP BY 1, 2, 3),
b AS (SELECT session_id, cluster, min(start_time) AS start_time, arg_max(end_time, epoch_us(start_time)) AS end_time, sum(duration_seconds) / 60 AS dm, count(*) AS segment_count, avg(confidence) AS cf, count(CASE WHEN normalized_title <> '' THEN 1 END) AS titles,
  arg_min(nullif(normalized_title, ''), CASE WHEN normalized_title <> '' THEN epoch_us(start_time) END) AS first_title FROM nclust GROUP BY 1, 2),
f AS (SELECT b.*, m1.app, m2.generic_task, CASE WHEN titles = 0 THEN 'Unknown' WHEN titles = 1 THEN first_title ELSE coalesce(w.words, first_title) END AS window_context FROM b JOIN m1 ON m1.session_id = b.session_id AND m1.cluster = b.cluster AND m1.r = 1
  JOIN m2 ON m2.session_id = b.session_id AND m2.cluster = b.cluster AND m2.r = 1 LEFT JOIN w ON w.session_id = b.session_id AND w.cluster = b.cluster)
SELECT session_id, cluster, start_time, end_time, round(dm, 6) AS duration_minutes, segment_count, round(cf, 6) AS confidence, app, generic_task, window_context, {title_case_sql("replace(generic_task, '_', ' ')")} || ' - ' || window_context AS task_name FROM f""")
def merged_neighbours(spark, sf):
    return tasks.merged_segments(tasks.merge_neighbours(distances(spark, sf), closed(spark, sf), eps=0.6))


view("swept", ["nd"], """
SELECT session_id, eps, count(*) AS segments, sum(CASE WHEN distance <= eps THEN 0 ELSE 1 END)::BIGINT AS clusters FROM (SELECT session_id, distance, unnest([0.3, 0.4, 0.5, 0.6])::DOUBLE AS eps FROM nd) t GROUP BY 1, 2
""")


@query("threshold_sweep", "J09", with_views("swept") + """
SELECT session_id, eps, segments, clusters, segments - clusters AS merged, round(1.0 - clusters / segments, 6) AS reduction, 10 - abs(clusters - greatest(2, segments // 3)) AS score FROM swept""")
def threshold_sweep(spark, sf):
    return tasks.sweep(distances(spark, sf), closed(spark, sf), [0.3, 0.4, 0.5, 0.6])


@query("best_thresholds", "F06", with_views("swept") + """
SELECT session_id, eps, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY 10 - abs(clusters - greatest(2, segments // 3)) DESC, eps) AS rank FROM swept) t WHERE rank <= 2""")
def best_thresholds(spark, sf):
    tried = tasks.sweep(distances(spark, sf), closed(spark, sf), [0.3, 0.4, 0.5, 0.6])
    return tasks.best_parameters(tried, 2).select("session_id", "eps", "rank")


# ---- all segments of a session: links, clusters, thresholds --------------------------------------------

view("tok", ["closed"], f"SELECT *, {TOK} AS tok FROM closed")
view("sp", ["tok"], f"""
SELECT session_id, segment_id, other, 0.4 * d_text + 0.3 * d_app + 0.2 * d_time + 0.1 * d_task AS distance FROM (SELECT *, {PART_SQL} FROM (
  SELECT a.*, b.segment_id AS other, b.tok AS p_tok, b.app AS p_app, b.start_time AS p_start, b.generic_task AS p_task FROM tok a JOIN tok b ON a.session_id = b.session_id AND a.segment_id <> b.segment_id) x) y
""")
EPS = [0.3, 0.4, 0.5, 0.6]


def all_links(eps: str) -> str:
    """For every segment and threshold its links and the smallest segment that they lead to."""
    return f"""
r(eps, segment_id, reached) AS (SELECT e.eps, segment_id, segment_id FROM closed, (SELECT unnest({eps})::DOUBLE AS eps) e UNION SELECT r.eps, r.segment_id, sp.other FROM r JOIN sp ON sp.segment_id = r.reached AND sp.distance <= r.eps),
ls AS (SELECT c.session_id, c.segment_id, c.start_time, r.eps, min(r.reached) AS component, (SELECT count(*) FROM sp WHERE sp.segment_id = c.segment_id AND sp.distance <= r.eps) AS links FROM closed c JOIN r ON r.segment_id = c.segment_id GROUP BY ALL)"""


def links_sql(eps: str) -> str:
    return with_views("sp").replace("WITH ", "WITH RECURSIVE ", 1) + "," + all_links(eps)


def session_points(spark, sf):
    return linkage.points_of(closed(spark, sf), max_gap_minutes=3600, short=linkage.SHORT)


@query("session_links", "C11 H31", links_sql("[0.4]") + f"""
SELECT session_id, min(segment_id) AS segment_id, count(*) AS members, links, min(component) AS component FROM (
  SELECT ls.*, t.start_time AS started, lower(app) AS app, generic_task, list_sort(tok) AS bag FROM ls JOIN tok t USING (session_id, segment_id)) x GROUP BY session_id, started, app, generic_task, bag, links""")
def session_links(spark, sf):
    return linkage.linked_points(session_points(spark, sf), 0.4).withColumnRenamed("point", "segment_id").select("session_id", "segment_id", "members", "links", "component")


NUMBERED = """, nu AS (SELECT *, CASE WHEN links = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY session_id, links > 0 ORDER BY first, component) - 1 END AS cluster FROM (SELECT *, min(start_time) OVER (PARTITION BY session_id, component) AS first FROM ls) x)"""


def session_labels(spark, sf):
    return stored(spark, sf, "session_clusters", lambda: linkage.cluster_segments(session_points(spark, sf), 0.4))


@query("session_clusters", "J03 J08", links_sql("[0.4]") + NUMBERED + "SELECT session_id, segment_id, links, cluster FROM nu")
def session_clusters(spark, sf):
    return session_labels(spark, sf)


@query("session_merged_tasks", "J08 D16", links_sql("[0.4]") + NUMBERED + """
, m1 AS (SELECT n.session_id, n.cluster, c.app, row_number() OVER (PARTITION BY n.session_id, n.cluster ORDER BY count(*) DESC, min(c.start_time)) AS r FROM nu n JOIN closed c USING (session_id, segment_id) WHERE cluster >= 0 GROUP BY 1, 2, 3),
m2 AS (SELECT n.session_id, n.cluster, c.generic_task, row_number() OVER (PARTITION BY n.session_id, n.cluster ORDER BY count(*) DESC, min(c.start_time)) AS r FROM nu n JOIN closed c USING (session_id, segment_id) WHERE cluster >= 0 GROUP BY 1, 2, 3)
SELECT b.*, m1.app, m2.generic_task FROM (SELECT n.session_id, n.cluster, min(c.start_time) AS start_time, arg_max(c.end_time, epoch_us(c.start_time)) AS end_time, round(sum(c.duration_seconds) / 60, 6) AS duration_minutes, count(*) AS segment_count,
  round(avg(c.confidence), 6) AS confidence FROM nu n JOIN closed c USING (session_id, segment_id) WHERE cluster >= 0 GROUP BY 1, 2) b
JOIN m1 ON m1.session_id = b.session_id AND m1.cluster = b.cluster AND m1.r = 1 JOIN m2 ON m2.session_id = b.session_id AND m2.cluster = b.cluster AND m2.r = 1""")
def session_merged_tasks(spark, sf):
    labels = session_labels(spark, sf).where("cluster >= 0").drop("links")
    merged = tasks.merged_segments(closed(spark, sf).join(labels, ["session_id", "segment_id"]))
    return merged.select("session_id", "cluster", "start_time", "end_time", "duration_minutes", "segment_count", "confidence", "app", "generic_task")


SWEPT = links_sql(str(EPS)) + """
, sw AS (SELECT session_id, eps, count(*) AS segments, count(DISTINCT CASE WHEN links > 0 THEN component END) AS clusters, count(CASE WHEN links = 0 THEN 1 END) AS noise FROM ls GROUP BY 1, 2)
"""


def session_sweeps(spark, sf):
    def build():
        points = session_points(spark, sf)
        return linkage.sweep(points, linkage.session_forest(points, max(EPS), EPS), EPS)

    return stored(spark, sf, "session_sweeps", build)


@query("session_sweep", "J09", SWEPT + "SELECT session_id, eps, segments, clusters, noise, segments - clusters - noise AS merged, round(1.0 - clusters / segments, 6) AS reduction FROM sw")
def session_sweep(spark, sf):
    return session_sweeps(spark, sf)


@query("session_best_thresholds", "F06", SWEPT + """
SELECT session_id, eps, clusters, noise, score, rank FROM (SELECT *, clusters - noise * 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY session_id ORDER BY clusters - noise * 0.5::DOUBLE DESC, eps) AS rank FROM sw WHERE clusters > 0) x WHERE rank <= 5""")
def session_best_thresholds(spark, sf):
    return linkage.best_thresholds(session_sweeps(spark, sf)).select("session_id", "eps", "clusters", "noise", "score", "rank")


def session_distance_counts(spark, sf):
    return stored(spark, sf, "session_distances", lambda: linkage.distance_counts(session_points(spark, sf)))


view("each", ["sp"], "SELECT session_id, distance FROM sp WHERE segment_id < other")
DISTRIBUTED = f"""SELECT session_id, count(*) AS pairs, round(min(distance), 6) AS lowest, round(max(distance), 6) AS highest, round(avg(distance), 6) AS mean, count(CASE WHEN distance < 0.3 THEN 1 END) AS very_similar,
  count(CASE WHEN distance >= 0.3 AND distance < 0.5 THEN 1 END) AS similar, count(CASE WHEN distance >= 0.5 THEN 1 END) AS different, {at('count(*) // 4')} AS q1, {at('count(*) // 2')} AS q2, {at('3 * count(*) // 4')} AS q3 FROM each GROUP BY 1"""


@query("session_distance_distribution", "D17 D44", with_views("each") + DISTRIBUTED)
def session_distance_distribution(spark, sf):
    return linkage.distance_distribution(session_distance_counts(spark, sf))


@query("session_adaptive_clusters", "J03 J09", with_views("sp").replace("WITH ", "WITH RECURSIVE ", 1) + """,
es AS (SELECT c.session_id, c.segment_id, coalesce(m.eps, 0.4) AS eps FROM closed c LEFT JOIN (SELECT session_id, list_sort(list(distance))[count(*) // 2 + 1] AS eps FROM sp WHERE segment_id < other GROUP BY 1) m USING (session_id)),
r(segment_id, eps, reached) AS (SELECT segment_id, eps, segment_id FROM es UNION SELECT r.segment_id, r.eps, sp.other FROM r JOIN sp ON sp.segment_id = r.reached AND sp.distance <= r.eps + 1e-12),
ls AS (SELECT es.session_id, es.segment_id, es.eps, min(r.reached) AS component, count(*) AS size FROM es JOIN r USING (segment_id) GROUP BY ALL)
SELECT session_id, round(eps, 6) AS eps, count(*) AS segments, count(DISTINCT CASE WHEN size > 1 THEN component END) AS clusters, count(CASE WHEN size = 1 THEN 1 END) AS noise,
  count(CASE WHEN size > 1 THEN 1 END) - count(DISTINCT CASE WHEN size > 1 THEN component END) AS merged, round(1.0 - count(DISTINCT CASE WHEN size > 1 THEN component END) / count(*), 6) AS reduction FROM ls GROUP BY session_id, eps""")
def session_adaptive_clusters(spark, sf):
    points = session_points(spark, sf)
    return linkage.adaptive_clusters(points, linkage.distance_distribution(session_distance_counts(spark, sf)))


# ---- all segments of a user: density clusters ----------------------------------------------------------

PAIR_COLUMNS = """(epoch_us(c.start_time) - epoch_us(p.end_time)) / 6e7 AS gap, p.app AS p_app, p.tok AS p_tok, p.keyboard_intensity_avg AS p_kb, p.mouse_intensity_avg AS p_mouse, p.total_copy_events + p.total_paste_events AS p_cp, p.mic_active_ratio AS p_mic,
    p.camera_active_ratio AS p_cam, p.max_audio_volume AS p_vol, p.mean_cpu_usage AS p_cpu, p.mean_ram_usage AS p_ram, p.mean_gpu_usage AS p_gpu, p.multitasking_score AS p_mt, p.activity_score AS p_act"""
view("stok", ["seg"], f"SELECT *, primary_app AS app, {tokens_sql('primary_window_title')} AS tok FROM seg")
view("user_links", ["stok"], f"""
SELECT user_id, segment_no, other FROM (SELECT *, {SIMILAR_SQL} FROM (SELECT c.*, p.segment_no AS other, {PAIR_COLUMNS} FROM stok c JOIN stok p ON p.user_id = c.user_id AND (p.start_time, p.segment_no) < (c.start_time, c.segment_no)) x) y
WHERE 1.0 - (s_app * 0.25 + s_window * 0.15 + s_temporal * 0.15 + s_interaction * 0.15 + s_av * 0.10 + s_system * 0.10 + s_behavior * 0.10) <= 0.3
""")
DENSE = with_views("user_links").replace("WITH ", "WITH RECURSIVE ", 1) + """,
ul AS (SELECT user_id, segment_no, other FROM user_links UNION ALL SELECT user_id, other, segment_no FROM user_links),
r(user_id, segment_no, reached) AS (SELECT user_id, segment_no, segment_no FROM seg UNION SELECT r.user_id, r.segment_no, ul.other FROM r JOIN ul ON ul.user_id = r.user_id AND ul.segment_no = r.reached),
f AS (SELECT r.user_id, r.segment_no, min(s.start_time) AS first FROM r JOIN seg s ON s.user_id = r.user_id AND s.segment_no = r.reached GROUP BY 1, 2),
dc AS (SELECT user_id, segment_no, dense_rank() OVER (PARTITION BY user_id ORDER BY first) - 1 AS cluster FROM f)
"""


def dense(spark, sf):
    return stored(spark, sf, "density_clusters", lambda: density.cluster_all(src.segments(spark, sf), ["user_id"]))


@query("density_clusters", "J02 C10", DENSE + "SELECT user_id, segment_no, cluster FROM dc")
def density_clusters(spark, sf):
    return dense(spark, sf).select("user_id", "segment_no", "cluster")


@query("density_tasks", "J02 J07 D11", DENSE + """
SELECT d.user_id, cluster, min(start_time) AS start_time, arg_max(end_time, epoch_us(start_time)) AS end_time, count(*) AS segments, round(sum(duration_minutes), 6) AS duration_minutes, round(avg(activity_score), 6) AS avg_activity
FROM dc d JOIN seg s ON s.user_id = d.user_id AND s.segment_no = d.segment_no GROUP BY 1, 2 HAVING sum(duration_minutes) >= 10""")
def density_tasks(spark, sf):
    rows = tasks.tasks_of(dense(spark, sf).withColumn("link_similarity", F.lit(None).cast("double")), ["user_id"])
    return rows.select("user_id", "cluster", "start_time", "end_time", "segments", "duration_minutes", "avg_activity")
