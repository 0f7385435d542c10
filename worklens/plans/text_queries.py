"""Title cleaning, tokens, names and rule classification."""

from pyspark.sql import functions as F

from worklens.functions import rules, text
from worklens.operators import classify
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.sources import tables as src

B = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
CLS = r"\t-\r\x1c-\x1f \x{85}\p{Z}"


def q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_of(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def clean_sql(c: str) -> str:
    s = f"regexp_replace(translate({c}, '–—•', '---'), '(?i) - Mozilla Firefox$', '')"
    s = f"replace({s}, ' ', '')"
    s = f"regexp_replace({s}, '{B}*[-–—|]{B}*[-–—|]+{B}*', ' | ', 'g')"
    s = f"regexp_replace({s}, '{B}*[-–—]{B}*', ' | ', 'g')"
    return f"CASE WHEN {c} IS NULL OR contains(lower({c}), 'system tray overflow') THEN '' ELSE trim({s}, ' |-–—') END"


def interval_clean_sql(c: str) -> str:
    s = f"lower({c})"
    for p in ["— mozilla firefox", "- google chrome", "- microsoft edge", "- safari", "["]:
        s = f"replace({s}, '{p}', '')"
    s = f"regexp_replace(regexp_replace({s}, '{B}', ' ', 'g'), '[^a-z0-9 ]', '', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def words_sql(c: str, marks: bool = True) -> str:
    s = f"lower({c})"
    if marks:
        s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_{CLS}-]', ' ', 'g')"
    return f"regexp_split_to_array({s}, '{B}+')"


def feature_tokens_sql(c: str) -> str:
    return f"list_filter({words_sql(c)}, lambda w: length(w) > 1)"


def title_case_sql(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({c}), '(\p{{L}}+|[^\p{{L}}]+)', 1), lambda r: upper(r[1]) || r[2:]), '')"


@query("document_title_cleaning", "H01 H02", f"""
SELECT doc_id, md5({clean_sql('text')}) AS clean, length({clean_sql('text')}) AS clean_chars,
  md5({interval_clean_sql('text')}) AS plain, length({interval_clean_sql('text')}) AS plain_chars FROM documents""")
def document_title_cleaning(spark, sf):
    docs = src.documents(spark, sf).select("doc_id", "text")
    done = docs.select("doc_id", text.clean_title(F.col("text")).alias("c"), text.clean_interval_title(F.col("text")).alias("p"))
    return done.select("doc_id", F.md5("c").alias("clean"), F.length("c").alias("clean_chars"), F.md5("p").alias("plain"), F.length("p").alias("plain_chars"))


@query("document_tokens", "H04", f"""
SELECT doc_id, len(f) AS feature_tokens, md5(array_to_string(f, ' ')) AS feature_md5, len(fk) AS feature_keywords,
  array_to_string(n, ' ') AS naming_keywords, len(c) AS cluster_tokens, md5(array_to_string(c, ' ')) AS cluster_md5,
  len(d) AS distance_tokens, md5(array_to_string(d, ' ')) AS distance_md5
FROM (SELECT doc_id, f, list_filter(f, lambda w: NOT list_contains({q(rules.FEATURE_STOPWORDS)}, w)) AS fk,
  list_filter(regexp_split_to_array(lower({clean_sql('text')}), '[-_|•·:;{CLS}]+'), lambda w: length(w) > 2 AND NOT list_contains({q(rules.NAMING_NOISE)}, w))[1:10] AS n,
  list_filter(list_transform({words_sql('text', False)}, lambda w: trim(w, '[](){{}}:;,."''')), lambda w: length(w) > 2 AND NOT list_contains({q(rules.CLUSTER_STOPWORDS)}, w)) AS c,
  list_filter(f, lambda w: NOT list_contains({q(rules.DISTANCE_STOPWORDS)}, w)) AS d
  FROM (SELECT doc_id, text, {feature_tokens_sql('text')} AS f FROM documents) a) b""")
def document_tokens(spark, sf):
    t = F.col("text")
    lists = src.documents(spark, sf).select(
        "doc_id", text.feature_tokens(t).alias("f"), text.naming_keywords(t).alias("n"), text.cluster_tokens(t).alias("c"),
    ).withColumn("d", text.without_distance_stopwords(F.col("f")))
    joined = lambda c: F.md5(F.array_join(c, " "))
    return lists.select(
        "doc_id", F.size("f").alias("feature_tokens"), joined("f").alias("feature_md5"),
        F.size(text.feature_keywords(F.col("f"))).alias("feature_keywords"), F.array_join("n", " ").alias("naming_keywords"),
        F.size("c").alias("cluster_tokens"), joined("c").alias("cluster_md5"), F.size("d").alias("distance_tokens"), joined("d").alias("distance_md5"),
    )


view("named", ["flat"], """
SELECT event_id, user_id, timestamp_start, minutes, k, list_extract([app, 'unknown.exe', 'teams.exe', 'pycharm64.exe', 'msedge.exe'], (k % 5) + 1) AS app,
  CASE WHEN k % 6 = 0 THEN 'plain page ' || k::VARCHAR ELSE window_title END AS window_title, keyboard_intensity AS intensity,
  (k % 10) / 10.0::DOUBLE AS continuity, k % 23 AS num_windows, (k % 8) / 8.0::DOUBLE AS app_diversity, minutes / 120.0 AS duration_hours,
  mic_active::INT::DOUBLE AS mic_ratio, camera_active::INT::DOUBLE AS camera_ratio FROM flat
""")


def named(spark, sf):
    """Intervals with more varied apps and titles, as input of the classifier."""
    iv = src.intervals_flat(spark, sf)
    k = F.col("k")
    apps = F.array("app", *[F.lit(a) for a in ("unknown.exe", "teams.exe", "pycharm64.exe", "msedge.exe")])
    minutes = (F.unix_micros("timestamp_end") - F.unix_micros("timestamp_start")) / 6e7
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    return iv.select(
        "event_id", "user_id", "timestamp_start", minutes.alias("minutes"), "k", F.element_at(apps, (k % 5) + 1).alias("app"),
        F.when(k % 6 == 0, F.concat(F.lit("plain page "), k.cast("string"))).otherwise(F.col("window_title")).alias("window_title"),
        F.col("keyboard_intensity").alias("intensity"), ((k % 10) / 10.0).alias("continuity"), (k % 23).alias("num_windows"),
        ((k % 8) / 8.0).alias("app_diversity"), (minutes / 120.0).alias("duration_hours"),
        flag("mic_active").alias("mic_ratio"), flag("camera_active").alias("camera_ratio"),
    )


view("app_names", ["named"], f"""
SELECT *, CASE lower(regexp_replace(app, '(?i)\\.exe$', '')) WHEN 'code' THEN 'VSCode' WHEN 'chrome' THEN 'Chrome' WHEN 'firefox' THEN 'Firefox'
  WHEN 'msedge' THEN 'Edge' WHEN 'notepad++' THEN 'Notepad++' WHEN 'sublime_text' THEN 'Sublime' WHEN 'pycharm64' THEN 'PyCharm'
  WHEN 'idea64' THEN 'IntelliJ' WHEN 'slack' THEN 'Slack' WHEN 'discord' THEN 'Discord' WHEN 'teams' THEN 'Teams' WHEN 'zoom' THEN 'Zoom'
  ELSE {title_case_sql("replace(regexp_replace(app, '(?i)\\.exe$', ''), '_', ' ')")} END AS shown, {clean_sql('window_title')} AS clean
FROM named
""")


def entity_sql(c: str) -> str:
    groups = [
        r"\b(react|vue|angular|node|python|javascript|typescript|java|c\+\+|rust|go)\b", r"\b(git|github|gitlab|bitbucket)\b",
        r"\b(vscode|pycharm|intellij|sublime)\b", r"\b(aws|azure|gcp|docker|kubernetes)\b",
    ]
    parts = " || ".join(f"regexp_extract_all(lower({c}), '{g}', 1)" for g in groups)
    return rf"({parts} || regexp_extract_all({c}, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b', 1)[1:3])"


def count_sql(col: str, parts, weight: int) -> str:
    return " + ".join([f"CASE WHEN contains({col}, '{p}') THEN {weight} ELSE 0 END" for p in parts] or ["0"])


DOMAIN_SQL = ", ".join(
    f"{{'score': {count_sql('lower(clean)', w, 2)} + {count_sql('lower(clean)', e, 3)} + {count_sql('lower(clean)', s, 3)} + {count_sql('lower(shown)', a, 4)}, "
    f"'rank': {-i}, 'domain': '{n}', 'category': '{c}'}}" for i, (n, c, w, e, s, a) in enumerate(rules.DOMAINS))

view("naming", ["app_names"], f"""
SELECT *, CASE WHEN dom.score >= 2 THEN dom.domain END AS domain, CASE WHEN dom.score >= 2 THEN dom.category END AS hint,
  {entity_sql('clean')} AS ents,
  list_filter(list_filter(regexp_split_to_array(lower({clean_sql('clean')}), '[-_|•·:;{CLS}]+'),
    lambda w: length(w) > 2 AND NOT list_contains({q(rules.NAMING_NOISE)}, w))[1:10], lambda w: length(w) > 3) AS words
FROM (SELECT *, list_max([{DOMAIN_SQL}]) AS dom FROM app_names) t
""")


@query("title_entities_and_domain", "H03 H05 H06 B05", with_views("naming") + f"""
SELECT event_id, shown, array_to_string(ents, ',') AS entities, domain, minutes * 60 >= 30 AND NOT {any_of('lower(app)', rules.SYSTEM_APPS)}
  AND NOT {any_of('lower(window_title)', rules.GENERIC_TITLES)} AND length(trim(window_title)) > 0 AS relevant FROM naming""")
def title_entities_and_domain(spark, sf):
    n = text.with_title_parts(named(spark, sf))
    return n.select("event_id", F.col("app_name").alias("shown"), F.array_join(text.entities(F.col("clean_title")), ",").alias("entities"),
                    F.col("domain.domain").alias("domain"),
                    text.relevant_activity(F.col("app"), F.col("window_title"), F.col("minutes") * 60).alias("relevant"))


def shorten_sql(c: str) -> str:
    head = f"{c}[1:50]"
    back = f"instr(reverse({head}), ' ')"
    return f"CASE WHEN length({c}) <= 50 THEN {c} WHEN {back} > 0 AND 50 - {back} > 35 THEN {head}[1:50 - {back}] || '...' ELSE {head} || '...' END"


def name_sql(task: str) -> str:
    """Names of the rows of ``naming`` (alias n) joined to whatever gives ``task``."""
    label = title_case_sql(f"replace(CASE WHEN n.hint IS NOT NULL AND n.continuity < 0.7 THEN n.hint ELSE {task} END, '_', ' ')")
    detail = f"CASE WHEN len(n.ents) > 0 THEN CASE WHEN length(n.ents[1]) > 2 THEN n.ents[1] END WHEN len(n.words) > 0 THEN {title_case_sql('n.words[1]')} END"
    hint = "CASE WHEN n.shown <> '' AND n.shown NOT IN ('Firefox', 'Chrome', 'Edge', 'Safari') THEN '(' || n.shown || ')' END"
    bare = f"CASE WHEN n.clean <> '' THEN {label} || ': ' || {shorten_sql('n.clean')} ELSE {label} END"
    return f"CASE WHEN {detail} IS NULL AND {hint} IS NULL THEN {bare} ELSE concat_ws(' - ', {label}, {detail}, {hint}) END"


@query("smart_task_names", "H15", with_views("naming") + f"SELECT event_id, {name_sql("'deep_development'")} AS name FROM naming n")
def smart_task_names(spark, sf):
    done = text.with_task_name(named(spark, sf), F.lit("deep_development"), F.col("continuity"))
    return done.select("event_id", F.col("task_name").alias("name"))


@query("task_labels", "H16", with_views("named") + f"""
SELECT event_id, CASE WHEN contains(t, ' - ') OR contains(t, ': ') THEN t
  WHEN len(p) >= 3 THEN {title_case_sql("replace(p[1], '_', ' ')")} || ': ' || {shorten_sql('p[3]')}
  WHEN len(p) = 2 THEN {title_case_sql("replace(p[1], '_', ' ')")} || ' (' || {title_case_sql("replace(p[2], '.exe', '')")} || ')'
  ELSE {title_case_sql("replace(t, '_', ' ')")} END AS label
FROM (SELECT *, string_split(t, ' | ') AS p FROM (SELECT event_id, CASE k % 4 WHEN 0 THEN 'deep_development' WHEN 1 THEN 'team_meeting | ' || app
  WHEN 2 THEN 'code_review | ' || app || ' | ' || window_title || ' and some more words to make it long enough' ELSE window_title END AS t FROM named) a) b""")
def task_labels(spark, sf):
    k = F.col("k") % 4
    old = (
        F.when(k == 0, "deep_development").when(k == 1, F.concat(F.lit("team_meeting | "), "app"))
        .when(k == 2, F.concat(F.lit("code_review | "), "app", F.lit(" | "), "window_title", F.lit(" and some more words to make it long enough")))
        .otherwise(F.col("window_title"))
    )
    return named(spark, sf).select("event_id", text.task_label(old).alias("label"))


def app_rule_sql(a: str, t: str, want: str) -> str:
    val = lambda task, conf: f"'{task}'" if want == "task" else str(conf)
    out = "CASE " + f"WHEN {a} = '' THEN NULL "
    for task, parts in rules.APP_RULES:
        out += f"WHEN {any_of(a, parts)} THEN {val(task, 0.85)} "
    browser = any_of(a, rules.RULE_BROWSERS)
    for task, words in rules.BROWSER_TITLE_RULES:
        out += f"WHEN {browser} AND {any_of(t, words)} THEN {val(task, 0.75)} "
    out += f"WHEN {browser} THEN {val('browsing_research', 0.65)} WHEN contains({a}, 'teams') AND {any_of(t, rules.TEAMS_CALL_WORDS)} THEN {val('video_conferencing', 0.85)} "
    return out + f"WHEN contains({a}, 'teams') THEN {val('chat_messaging', 0.75)} END"


def title_rule_sql(t: str, want: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(t, words)} THEN " + (f"'{task}'" if want == "task" else str(conf)) for words, task, conf in rules.TITLE_RULES) + " END"


view("sig", [], "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{s[0]}', {s[1]}::DOUBLE, {s[2]}::DOUBLE, {s[3]}::DOUBLE, {s[4]}::DOUBLE, {s[5]}::DOUBLE, {s[6]}::DOUBLE)" for i, s in enumerate(rules.SIGNATURES))
    + ") v(rank, task, intensity, continuity, entropy, diversity, duration, min_confidence)")

view("nearest_sig", ["named", "sig"], """
SELECT event_id, task AS best, distance, CASE WHEN 1 - distance < min_confidence THEN (1 - distance) * 0.7 ELSE 1 - distance END AS conf FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, rank) AS r FROM (
    SELECT n.event_id, s.task, s.rank, s.min_confidence, least(1.0, sqrt(1.5 * pow(least(1, greatest(0, n.intensity / 100)) - s.intensity, 2)
      + 1.2 * pow(n.continuity - s.continuity, 2) + 1.5 * pow(least(1, greatest(0, n.num_windows / 20)) - s.entropy, 2)
      + 0.8 * pow(n.app_diversity - s.diversity, 2) + 0.6 * pow(least(1, greatest(0, n.duration_hours / 4)) - s.duration, 2)) / 3.5) AS distance
    FROM named n CROSS JOIN sig s) a) b WHERE r = 1
""")


@query("nearest_signature", "C13 H14", with_views("nearest_sig") + """
SELECT event_id, best AS task, round(distance, 6) AS distance, round(conf, 6) AS confidence FROM nearest_sig""")
def nearest_signature(spark, sf):
    best = classify.nearest_signature(*[F.col(c) for c in ("intensity", "continuity", "num_windows", "app_diversity", "duration_hours")])
    rows = named(spark, sf).select("event_id", best.alias("b"))
    return rows.select("event_id", F.col("b.task").alias("task"), F.col("b.distance").alias("distance"), classify.signature_confidence(F.col("b")).alias("confidence"))


@query("rule_classification", "H11 H12", with_views("named") + f"""
SELECT event_id, {app_rule_sql('lower(app)', 'lower(window_title)', 'task')} AS app_task, {app_rule_sql('lower(app)', 'lower(window_title)', 'conf')}::DOUBLE AS app_confidence,
  {title_rule_sql('lower(window_title)', 'task')} AS title_task, {title_rule_sql('lower(window_title)', 'conf')}::DOUBLE AS title_confidence FROM named""")
def rule_classification(spark, sf):
    n = named(spark, sf)
    a, t = classify.by_app(F.col("a"), F.col("t")), classify.by_title(F.col("t"))
    return n.select("event_id", F.lower("app").alias("a"), F.lower("window_title").alias("t")).select("event_id", a["task"].alias("app_task"), a["confidence"].alias("app_confidence"), t["task"].alias("title_task"), t["confidence"].alias("title_confidence"))


@query("document_title_rules", "H12", f"""
SELECT doc_id, {title_rule_sql('lower(text)', 'task')} AS task, {title_rule_sql('lower(text)', 'conf')}::DOUBLE AS confidence FROM documents""")
def document_title_rules(spark, sf):
    docs = src.documents(spark, sf)
    hit = classify.by_title(F.col("t"))
    return docs.select("doc_id", F.lower("text").alias("t")).select("doc_id", hit.alias("h")).select("doc_id", F.col("h")["task"].alias("task"), F.col("h")["confidence"].alias("confidence"))


view("recommended", ["named", "nearest_sig"], f"""
SELECT event_id, app, window_title, CASE WHEN contains(t, 'system tray overflow') OR contains(t, 'systemtrayoverflow') THEN 'ignored_system_ui'
  WHEN ac > 0.7 THEN 'app_match' WHEN tc > 0.6 AND ac > 0.5 THEN 'title_and_app_match' WHEN tc > 0.6 THEN 'title_match'
  WHEN blocked AND {any_of('a', rules.GUARD_BROWSERS)} THEN 'video_conf_blocked_browser_fallback' WHEN blocked THEN 'video_conf_blocked_fallback'
  WHEN a_task = best THEN 'behavioral_with_app_boost' WHEN conf < 0.4 AND {any_of('a', ['browser', 'firefox', 'chrome'])} THEN 'browser_fallback'
  WHEN conf < 0.4 THEN 'low_confidence_fallback' ELSE 'behavioral_match' END AS reason, a_task, ac, tt, tc, best, conf
FROM (SELECT *, best = 'video_conferencing' AND NOT ({any_of('a', rules.CONFERENCE_APPS)} OR {any_of('t', rules.CONFERENCE_WORDS)} OR mic_ratio >= 0.3 OR camera_ratio >= 0.2) AS blocked
  FROM (SELECT *, lower(app) AS a, lower(window_title) AS t, {app_rule_sql('lower(app)', 'lower(window_title)', 'task')} AS a_task,
    coalesce({app_rule_sql('lower(app)', 'lower(window_title)', 'conf')}, 0)::DOUBLE AS ac, {title_rule_sql('lower(window_title)', 'task')} AS tt,
    {title_rule_sql('lower(window_title)', 'conf')}::DOUBLE AS tc FROM named JOIN nearest_sig USING (event_id)) x) y
""")

view("recommended_task", ["recommended"], """
SELECT event_id, reason, CASE reason WHEN 'ignored_system_ui' THEN 'general_productivity' WHEN 'app_match' THEN a_task
    WHEN 'title_and_app_match' THEN CASE WHEN ac > tc THEN a_task ELSE tt END WHEN 'title_match' THEN tt WHEN 'video_conf_blocked_browser_fallback' THEN 'browsing_research'
    WHEN 'video_conf_blocked_fallback' THEN 'content_consumption' WHEN 'browser_fallback' THEN 'browsing_research' WHEN 'low_confidence_fallback' THEN 'general_productivity'
    ELSE best END AS task,
  CASE reason WHEN 'ignored_system_ui' THEN 0.2 WHEN 'app_match' THEN ac WHEN 'title_and_app_match' THEN (tc + ac) / 2 WHEN 'title_match' THEN tc
    WHEN 'video_conf_blocked_browser_fallback' THEN greatest(0.55, conf) WHEN 'video_conf_blocked_fallback' THEN greatest(0.5, conf)
    WHEN 'behavioral_with_app_boost' THEN least(0.95, conf + ac * 0.2) WHEN 'browser_fallback' THEN 0.5 WHEN 'low_confidence_fallback' THEN 0.45 ELSE conf END AS confidence
FROM recommended
""")


@query("task_recommendation", "H13", with_views("recommended_task") + "SELECT event_id, reason, task, round(confidence, 6) AS confidence FROM recommended_task")
def task_recommendation(spark, sf):
    return classify.recommend(named(spark, sf)).select("event_id", "reason", "task", "confidence")


@query("reclassification_summary", "J14 D51", with_views("recommended_task", "flat") + """,
c AS (SELECT r.task AS new_task, 'T' || (f.k % 5)::VARCHAR AS old_id, r.reason, CASE f.k % 5 WHEN 0 THEN 'deep_development' WHEN 1 THEN 'chat_messaging'
  WHEN 2 THEN 'browsing_research' WHEN 3 THEN 'general_productivity' ELSE 'email_communication' END AS old_task FROM recommended_task r JOIN flat f USING (event_id))
SELECT 'outcome' AS kind, CASE WHEN old_task = new_task THEN 'unchanged' ELSE 'changed' END AS value, count(*) AS segments FROM c GROUP BY 1, 2
UNION ALL SELECT 'old_task', old_task, count(*) FROM c GROUP BY 1, 2 UNION ALL SELECT 'new_task', new_task, count(*) FROM c GROUP BY 1, 2
UNION ALL SELECT 'reason', reason, count(*) FROM c GROUP BY 1, 2""")
def reclassification_summary(spark, sf):
    done = classify.recommend(named(spark, sf))
    old = F.element_at(F.array(*[F.lit(v) for v in ("deep_development", "chat_messaging", "browsing_research", "general_productivity", "email_communication")]), (F.col("k") % 5) + 1)
    return classify.reclassification_summary(done.select(old.alias("old_task"), F.col("task").alias("new_task"), "reason"))
