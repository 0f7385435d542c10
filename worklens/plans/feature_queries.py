"""Segment features, encoders and online split rules."""

from pyspark.sql import functions as F

from worklens.functions import rules
from worklens.operators import classify, features, scans, segments, signals
from worklens.plans import segment_queries, table_queries  # noqa: F401  (define the segment views)
from worklens.plans.prelude import view, with_views
from worklens.plans.registry import query
from worklens.plans.text_queries import any_of, feature_tokens_sql, q
from worklens.session import stored
from worklens.sources import tables as src


def closed(spark, sf):
    return scans.closed_segments(src.task_segments(spark, sf))


def history(spark, sf):
    return features.duration_history(src.task_segments(spark, sf))


def vocabulary(spark, sf):
    return features.keyword_vocabulary(closed(spark, sf), "window_title")


def segment_vectors(spark, sf):
    return stored(spark, sf, "segment_vectors", lambda: features.segment_vectors(closed(spark, sf), history(spark, sf), vocabulary(spark, sf)))


view("hist", ["task_segments"], """
SELECT user_id, task_id, avg(minutes) AS avg_task_duration, min(minutes) AS min_task_duration, max(minutes) AS max_task_duration, count(*) AS task_frequency
FROM task_segments WHERE end_time IS NOT NULL AND minutes > 0 GROUP BY 1, 2
""")
view("vocab", ["closed"], f"""
SELECT word, row_number() OVER (ORDER BY n DESC, word) AS p FROM (SELECT word, count(*) AS n FROM (
  SELECT unnest(list_filter({feature_tokens_sql('window_title')}, lambda w: NOT list_contains({q(rules.FEATURE_STOPWORDS)}, w))) AS word FROM closed) t GROUP BY 1) u QUALIFY p <= 50
""")
view("ctx", ["closed"], """
SELECT *, lag(generic_task) OVER w AS previous_task, row_number() OVER w - 1 AS position, coalesce(lag(generic_task, 2) OVER w = generic_task, false) AS is_task_return FROM closed
WINDOW w AS (PARTITION BY session_id ORDER BY start_time, segment_id)
""")


@query("duration_history", "J12 H36", with_views("hist") + """
SELECT user_id, task_id, round(avg_task_duration, 6) AS avg_task_duration, min_task_duration, max_task_duration, task_frequency FROM hist""")
def duration_history(spark, sf):
    return history(spark, sf)


@query("keyword_vocabulary", "F04 H04", with_views("vocab") + "SELECT p AS position, word FROM vocab")
def keyword_vocabulary(spark, sf):
    return vocabulary(spark, sf).select(F.posexplode("vocabulary").alias("position", "word")).withColumn("position", F.col("position") + 1)


@query("sequence_context", "G15", with_views("ctx") + "SELECT segment_id, previous_task, position, is_task_return FROM ctx")
def sequence_context(spark, sf):
    return features.sequence_context(closed(spark, sf)).select("segment_id", "previous_task", "position", "is_task_return")


ONE_TASK = " ".join(f"WHEN contains(lower(previous_task), '{t.replace('_', ' ')}') OR contains(lower(previous_task), '{t}') THEN {i}" for i, t in enumerate(rules.ONEHOT_TASKS))
FLAG_SQL = ", ".join([f"list_has_any(tokens, {q(w)})::INT AS f{i}" for i, (_, w) in enumerate(rules.DOMAIN_WORDS)]
                     + [f"{any_of('lower(title)', p)}::INT AS f{i + 6}" for i, (_, p) in enumerate(rules.TITLE_PARTS)])
view("feat", ["ctx", "hist", "vocab"], f"""
SELECT x.*, {FLAG_SQL}, coalesce(list_position({q(rules.ONEHOT_APPS[:-1])}, lower(app)), 12) AS app_at, len(tokens) AS nt, len(words) AS nw,
  (SELECT list(v.p ORDER BY v.p) FROM vocab v WHERE list_contains(x.words, v.word)) AS bow,
  CASE WHEN m < 2 THEN 1 WHEN m < 10 THEN 2 WHEN m < 30 THEN 3 ELSE 4 END AS bin, CASE WHEN hour(start_time) >= 5 AND hour(start_time) < 12 THEN 1 WHEN hour(start_time) >= 12 AND hour(start_time) < 17 THEN 2 WHEN hour(start_time) >= 17 AND hour(start_time) < 21 THEN 3 ELSE 4 END AS part,
  CASE WHEN position > 0 THEN CASE {ONE_TASK} ELSE -1 END ELSE -1 END AS prev_at
FROM (SELECT *, list_filter(tokens, lambda w: NOT list_contains({q(rules.FEATURE_STOPWORDS)}, w)) AS words FROM (
  SELECT c.*, {feature_tokens_sql("CASE WHEN c.normalized_title <> '' THEN c.normalized_title ELSE c.window_title END")} AS tokens, CASE WHEN c.normalized_title <> '' THEN c.normalized_title ELSE c.window_title END AS title,
    c.duration_seconds / 60 AS m, coalesce(h.task_frequency, 0) AS freq, CASE WHEN h.avg_task_duration > 0 THEN c.duration_seconds / 60 / h.avg_task_duration ELSE 1.0 END AS ratio
  FROM ctx c LEFT JOIN hist h ON h.user_id = c.user_id AND h.task_id = c.generic_task) y) x
""")
# position sums: every feature times its place in the vector, so that a shifted or wrong value shows
PLACED = """app_at + (12 + part) + (16 + bin) + 21 * ln(1 + m) + 22 * hour(start_time) / 24.0 + 23 * (isodow(start_time) - 1) / 7.0 + 24 * (isodow(start_time) >= 6)::INT + 25 * (hour(start_time) >= 9 AND hour(start_time) < 17)::INT
  + CASE WHEN prev_at >= 0 THEN 26 + prev_at ELSE 0 END + 32 * least(position / 10.0, 1.0) + 33 * is_task_return::INT + 34 * least(freq / 100.0, 1.0) + 35 * ratio + 36 * (position = 0)::INT
  + 37 * least(nt / 20.0, 1.0) + 38 * least(nw / 10.0, 1.0) + """ + " + ".join(f"{39 + i} * f{i}" for i in range(9)) + " + coalesce(list_sum(list_transform(bow, lambda p: 47 + p)), 0)"


@query("segment_features", "J11 J13 H07 H19 H27 H28 A25", with_views("feat") + f"SELECT segment_id, generic_task, 97::BIGINT AS dimensions, round({PLACED}, 6) AS placed_sum, len(coalesce(bow, [])) AS known_words FROM feat")
def segment_features(spark, sf):
    rows = segment_vectors(spark, sf)
    placed = F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    known = F.aggregate(F.slice("features", 48, 50), F.lit(0.0), lambda s, v: s + v).cast("long")
    return rows.select("segment_id", "generic_task", F.size("features").alias("dimensions"), placed.alias("placed_sum"), known.alias("known_words"))


@query("segment_feature_groups", "J11 D22", with_views("feat") + """
SELECT generic_task, count(*) AS segments, round(avg(ratio), 6) AS duration_ratio, round(avg(ln(1 + m)), 6) AS duration_log, round(avg(least(nt / 20.0, 1.0)), 6) AS title_length, sum(f0)::BIGINT AS coding, sum(is_task_return::INT)::BIGINT AS returns FROM feat GROUP BY 1""")
def segment_feature_groups(spark, sf):
    at = lambda i: F.col("features")[i]
    return segment_vectors(spark, sf).groupBy("generic_task").agg(
        F.count(F.lit(1)).alias("segments"), F.avg(at(34)).alias("duration_ratio"), F.avg(at(20)).alias("duration_log"), F.avg(at(36)).alias("title_length"),
        F.sum(at(38)).cast("long").alias("coding"), F.sum(at(32)).cast("long").alias("returns"))


view("encoded", ["seg", "seg_apps"], """
SELECT s.*, list_position(k.known, s.primary_app) AS app_at, len(k.known) AS apps, CASE s.time_of_day WHEN 'morning' THEN 0.25 WHEN 'evening' THEN 0.75 WHEN 'night' THEN 0.0 ELSE 0.5 END AS time_numeric,
  (SELECT list(c ORDER BY b) FROM (SELECT b, count(*) FILTER (WHERE (ord(substr(s.primary_window_title, i::INT + 1, 1)) + i) % 10 = b) / length(s.primary_window_title) AS c FROM range(length(s.primary_window_title)) r(i), range(10) bb(b) GROUP BY b) z) AS window_hash
FROM seg s, (SELECT list_sort(list(app)) AS known FROM (SELECT app FROM seg_apps SEMI JOIN seg USING (user_id, segment_no) GROUP BY 1 ORDER BY count(*) DESC, app LIMIT 3) t) k
""")


@query("encoded_segments", "J01 H26 H27 H29 F04", with_views("encoded") + """
SELECT user_id, segment_id, coalesce(app_at, apps + 1)::BIGINT AS app_position, (apps + 1)::BIGINT AS app_dimensions, time_numeric::DOUBLE AS time_numeric,
  round(list_sum(list_transform(generate_series(1, 10), lambda i: i * window_hash[i])), 6) AS placed_hash, round(list_sum(window_hash), 6) AS hash_sum FROM encoded""")
def encoded_segments(spark, sf):
    fitted = features.top_apps(segments.app_time(src.interval_segments(spark, sf), src.MIN_SEGMENT_MINUTES), 3)
    rows = features.encode_segments(src.segments(spark, sf), fitted)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rows.select(
        "user_id", "segment_id", F.array_position("app_onehot", 1).alias("app_position"), F.size("app_onehot").alias("app_dimensions"), "time_numeric",
        add(F.transform("window_hash", lambda v, i: v * (i + 1))).alias("placed_hash"), add(F.col("window_hash")).alias("hash_sum"))


@query("split_decisions", "G30", with_views("closed") + """,
x AS (SELECT *, lag(app) OVER w AS pa, lag(normalized_title) OVER w AS pt, lag(start_time) OVER w AS ps FROM closed WINDOW w AS (PARTITION BY session_id ORDER BY start_time, segment_id)),
y AS (SELECT segment_id, CASE WHEN ps IS NULL THEN 'first' WHEN epoch_us(start_time) - epoch_us(ps) < 3600000000 THEN 'duration_too_short' WHEN confidence < 0.6 THEN 'confidence_too_low' WHEN pa <> app THEN 'app_change_' || pa || '_to_' || app
  WHEN pt <> normalized_title THEN 'window_change' ELSE 'no_context_change' END AS reason FROM x)
SELECT segment_id, reason, starts_with(reason, 'app_change') OR reason = 'window_change' AS split FROM y""")
def split_decisions(spark, sf):
    return signals.split_decisions(closed(spark, sf), ["session_id"], min_seconds=3600).select("segment_id", "reason", "split")


STICKY = q([s[0] for s in rules.SIGNATURES if s[7]])


@query("transition_decisions", "G31", with_views("listed") + f""",
x AS (SELECT segment_id, generic_task AS n, confidence AS nc, lag(generic_task) OVER w AS c, lag(confidence) OVER w AS cc, (epoch_us(start_time) - epoch_us(lag(start_time) OVER w)) / 6e7 AS m FROM listed WINDOW w AS (PARTITION BY session_id ORDER BY start_time, segment_id))
SELECT segment_id, CASE WHEN c = n THEN false WHEN list_contains({STICKY}, c) THEN nc - cc >= 0.10 OR (m >= 10 AND nc - cc >= -0.05)
  ELSE nc - cc > 0.03 OR (abs(nc - cc) <= 0.15 AND m >= 3) OR (m >= 5 AND nc > 0.5) END AS moves FROM x WHERE c IS NOT NULL""")
def transition_decisions(spark, sf):
    from worklens.functions import scoring
    from worklens.functions.sequence import day_chunk, scan_rows

    rows = scans.segment_listing(src.task_segments(spark, sf), src.sessions(spark, sf)).select("session_id", "segment_id", "start_time", "generic_task", "confidence")
    seen = scan_rows(rows, ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"), lag={"p": F.struct("generic_task", "confidence", "start_time")}).filter("p is not null")
    moves = classify.should_transition(F.col("p.generic_task"), F.col("generic_task"), F.col("p.confidence"), F.col("confidence"), scoring.minutes_between(F.col("p.start_time"), "start_time"))
    return seen.select("segment_id", moves.alias("moves"))


@query("reclassified_segments", "J14", with_views("task_segments", "recommended_task") + """
SELECT s.segment_id, r.task AS task_id, round(CASE WHEN r.task <> s.task_id THEN r.confidence ELSE s.confidence END, 6) AS confidence, CASE WHEN r.task <> s.task_id THEN r.reason ELSE s.reason END AS reason
FROM task_segments s JOIN recommended_task r ON r.event_id = s.segment_id""")
def reclassified_segments(spark, sf):
    from worklens.plans.text_queries import named

    done = classify.recommend(named(spark, sf)).select(
        F.col("event_id").alias("segment_id"), F.col("task").alias("new_task"), F.col("confidence").alias("new_confidence"), F.col("reason").alias("new_reason"))
    seg = src.task_segments(spark, sf).select("segment_id", "task_id", "confidence", "reason")
    return classify.apply_reclassification(seg, done, dry_run=False)
