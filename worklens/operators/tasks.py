"""Tasks out of work segments.

Segments are chained in time: each one is compared with the segment before it, never with all others,
so the work grows with the number of segments. The studied system also clusters by comparing every
pair of segments; that does not scale and is not built (see README).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import rules, scoring, text
from worklens.functions.sequence import day_chunk, islands, scan_rows
from worklens.functions.stats import index_percentiles
from worklens.session import cut_lineage

Side = Callable[[str], Column]

# fixed values: weights of the segment similarity
SIMILARITY_WEIGHTS = {"app": 0.25, "window": 0.15, "temporal": 0.15, "interaction": 0.15, "audio_video": 0.10, "system": 0.10, "behavioral": 0.10}
# fixed values: weights of the segment distance
DISTANCE_WEIGHTS = {"text": 0.4, "app": 0.3, "temporal": 0.2, "behavioral": 0.1}

SIMILARITY_COLUMNS = [
    "start_time", "end_time", "primary_app", "title_tokens", "keyboard_intensity_avg", "mouse_intensity_avg", "total_copy_events", "total_paste_events",
    "mic_active_ratio", "camera_active_ratio", "max_audio_volume", "mean_cpu_usage", "mean_ram_usage", "mean_gpu_usage", "multitasking_score",
    "activity_score", "is_active_work",
]


def app_family_similarity(a: Column, b: Column) -> Column:
    """Same app 1, same family .7 (communication .8), else 0."""
    la, lb = F.lower(a), F.lower(b)
    chain = F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0)
    for parts, score in rules.SIMILARITY_FAMILIES:
        chain = chain.when(text.contains_any(la, parts) & text.contains_any(lb, parts), score)
    return chain.otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Token-set overlap; .5 when a side has no tokens."""
    return F.when((F.size(a) < 1) | (F.size(b) < 1), 0.5).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similarity(p: Side, c: Side) -> dict[str, Column]:
    """The seven parts of the similarity of an earlier segment ``p`` and a later one ``c``."""
    near = lambda name, cap: 1.0 - F.abs(F.least(p(name).cast("double"), F.lit(cap)) / cap - F.least(c(name).cast("double"), F.lit(cap)) / cap)
    same = lambda name: 1.0 - F.abs(p(name) - c(name))
    gap = scoring.minutes_between(p("end_time"), c("start_time"))
    paste = lambda s: F.least((s("total_copy_events") + s("total_paste_events")).cast("double"), F.lit(50.0)) / 50.0
    both = same("mean_cpu_usage") + same("mean_ram_usage")
    work = F.when(p("is_active_work") == c("is_active_work"), 1.0).otherwise(0.3)
    return {
        "app": app_family_similarity(p("primary_app"), c("primary_app")),
        "window": jaccard(p("title_tokens"), c("title_tokens")),
        "temporal": F.when(gap <= 0, 1.0).when(gap > 30, 0.0).otherwise(F.pow(F.lit(2.0), -gap / 10.0)),
        "interaction": (near("keyboard_intensity_avg", 100.0) + near("mouse_intensity_avg", 20.0) + 1.0 - F.abs(paste(p) - paste(c))) / 3.0,
        "audio_video": same("mic_active_ratio") * 0.4 + same("camera_active_ratio") * 0.4 + same("max_audio_volume") * 0.2,
        "system": F.when(p("mean_gpu_usage").isNull() | c("mean_gpu_usage").isNull(), both / 2.0).otherwise((both + same("mean_gpu_usage")) / 3.0),
        "behavioral": (same("multitasking_score") + same("activity_score") + work) / 3.0,
    }


def total_similarity(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or SIMILARITY_WEIGHTS
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + value * F.lit(weights[name])
    return out


def with_tokens(segments: DataFrame) -> DataFrame:
    return segments.withColumn("title_tokens", F.array_distinct(F.coalesce(text.cluster_tokens(F.col("primary_window_title")), F.array().cast("array<string>"))))


def neighbour_similarity(segments: DataFrame, keys: list[str]) -> DataFrame:
    """H30 of every segment and the one before it, part by part."""
    seen = scan_rows(with_tokens(segments), keys, ["start_time", "segment_no"], day_chunk("start_time"), lag={"p": F.struct(*SIMILARITY_COLUMNS)}).filter("p is not null")
    parts = similarity(lambda n: F.col("p")[n], F.col)
    named = seen.withColumns({f"{n}_similarity": c for n, c in parts.items()})
    return named.withColumn("similarity", total_similarity({n: F.col(f"{n}_similarity") for n in parts})).drop("p", "title_tokens")


def chain_segments(segments: DataFrame, keys: list[str], max_gap_minutes: float = 30.0, min_similarity: float = 0.5) -> DataFrame:
    """A segment stays in the cluster of the segment before it when the gap is at most
    ``max_gap_minutes`` and the similarity at least ``min_similarity``. Adds cluster (from 0) and the
    similarity to the segment before in the same cluster."""
    prev = lambda n: F.col(f"__p_{n}")
    score = lambda: total_similarity(similarity(prev, F.col))
    apart = lambda: F.when(prev("end_time").isNull(), F.lit(True)).otherwise(
        (scoring.minutes_between(prev("end_time"), "start_time") > max_gap_minutes) | (score() < min_similarity))
    runs = islands(
        with_tokens(segments), keys, ["start_time", "segment_no"], day_chunk("start_time"), apart, out="cluster",
        lag={f"__p_{n}": F.col(n) for n in SIMILARITY_COLUMNS}, uses=SIMILARITY_COLUMNS, within={"earlier": F.struct(*SIMILARITY_COLUMNS)})
    link = F.when(F.col("earlier").isNotNull(), total_similarity(similarity(lambda n: F.col("earlier")[n], F.col)))
    return runs.withColumn("cluster", F.col("cluster") - 1).withColumn("link_similarity", link).drop("earlier", "title_tokens")


def tasks_of(clustered: DataFrame, keys: list[str], min_task_minutes: float = 10.0) -> DataFrame:
    """One row per cluster of at least ``min_task_minutes``. Confidence is the
    mean similarity along the chain, 1 for a single segment."""
    group = [*keys, "cluster"]
    share = lambda flag: F.sum(F.col(flag).cast("int")) > F.count(F.lit(1)) / 2
    base = clustered.groupBy(*group).agg(
        F.min("start_time").alias("start_time"), F.max_by("end_time", F.struct("start_time", "segment_no")).alias("end_time"), F.count(F.lit(1)).alias("segments"),
        F.sum("duration_minutes").alias("duration_minutes"), F.avg("activity_score").alias("avg_activity"), F.avg("mean_cpu_usage").alias("avg_cpu"),
        F.avg("mean_ram_usage").alias("avg_ram"), F.sum("total_keyboard_keys").alias("total_keys"),
        F.sum(F.col("total_copy_events") + F.col("total_paste_events")).alias("copy_paste"), share("is_multitasking").alias("is_multitasking"),
        share("is_active_work").alias("is_active"), F.coalesce(F.avg("link_similarity"), F.lit(1.0)).alias("confidence"),
    ).filter(F.col("duration_minutes") >= min_task_minutes)
    apps = clustered.filter("primary_app is not null").groupBy(*group, "primary_app").agg(
        F.sum("duration_minutes").alias("m"), F.min(F.struct("start_time", "segment_no")).alias("f"))
    primary = apps.groupBy(*group).agg(
        F.min_by("primary_app", F.struct(-F.round("m", 6), F.col("f"))).alias("primary_app"), F.count(F.lit(1)).alias("apps_used"))
    named = base.join(primary.hint("merge"), group, "left").join(title_patterns(clustered, group).hint("merge"), group, "left")
    name = F.coalesce(text.title_case(F.replace(F.replace("primary_app", F.lit(".exe"), F.lit("")), F.lit("_"), F.lit(" "))), F.lit("Unknown Task"))
    pattern = F.when(F.length("title_pattern") > 3, F.concat(F.lit(": "), text.title_case(F.col("title_pattern")))).otherwise("")
    kind = F.when(F.col("is_multitasking"), " (Multitasking)").when(F.col("is_active"), " (Active)").otherwise(" (Passive)")
    return named.withColumns({
        "task_id": F.concat_ws("_", F.lit("task"), F.date_format("start_time", "yyyyMMdd_HHmmss"), F.col("cluster").cast("string")),
        "task_name": F.concat(name, pattern, kind)})


def title_patterns(clustered: DataFrame, group: list[str]) -> DataFrame:
    """The three most frequent words of a cluster's titles, the first seen wins a tie."""
    words = clustered.filter("primary_window_title is not null").select(
        *group, "start_time", "segment_no", F.posexplode(F.split(F.lower("primary_window_title"), f"{text.BLANK}+")).alias("i", "word")).filter("word <> ''")
    counts = words.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_time", "segment_no", "i")).alias("f"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "f")
    top = counts.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), " ")  # three words
    return top.groupBy(*group).agg(joined.alias("title_pattern"))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Totals over all tasks."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return tasks.agg(
        F.count(F.lit(1)).alias("task_count"), (F.sum("duration_minutes") / 60.0).alias("hours"), F.avg("duration_minutes").alias("avg_minutes"),
        F.avg("confidence").alias("avg_confidence"), share("is_active").alias("active_ratio"), share("is_multitasking").alias("multitasking_ratio"))


def top_task_apps(tasks: DataFrame, n: int = 5) -> DataFrame:
    """D14 / F05."""
    return tasks.groupBy("primary_app").agg((F.sum("duration_minutes") / 60.0).alias("hours")).orderBy(F.desc("hours"), "primary_app").limit(n)


def enriched_records(clustered: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Stored task record: tasks with the means and sums of their segments and the most
    frequent session."""
    group = [*keys, "cluster"]
    sums = clustered.groupBy(*group).agg(
        F.coalesce(F.avg("mean_gpu_usage"), F.lit(0.0)).alias("avg_gpu"), F.avg("max_audio_volume").alias("audio_volume"),
        scoring.at_least(F.avg("mic_active_ratio"), 0.5).alias("mic_on"), scoring.at_least(F.avg("camera_active_ratio"), 0.5).alias("camera_on"),
        F.sum("total_copy_events").alias("copy_count"), F.sum("total_paste_events").alias("paste_count"),
        F.avg("keyboard_intensity_avg").alias("keyboard_intensity"), F.sum("total_mouse_clicks").alias("mouse_activity"))
    sessions = clustered.filter("session_id is not null").groupBy(*group, "session_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_time").alias("f"))
    session = sessions.groupBy(*group).agg(F.min_by("session_id", F.struct(-F.col("n"), F.col("f"))).alias("session_id"))
    return tasks.join(sums.hint("merge"), group).join(session.hint("merge"), group, "left")


# ---- distance of stored segments -------------------------------------------------------------------

def app_category(app: Column) -> Column:
    """First category with a part of the app's name."""
    chain = None
    for name, parts in rules.APP_CATEGORIES:
        hit = text.contains_any(app, parts)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("other")


def with_counts(segments: DataFrame) -> DataFrame:
    """Distinct title words of a segment with their counts and the length of that count vector."""
    title = F.when(F.col("normalized_title") != "", F.col("normalized_title")).otherwise(F.col("window_title"))
    rows = segments.withColumn("__t", text.distance_tokens(title)).withColumn("words", F.array_distinct("__t"))
    counts = F.transform("words", lambda w: F.size(F.filter("__t", lambda v: v == w)).cast("double"))
    rows = rows.withColumn("counts", counts)
    norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumns({"norm": norm, "low_app": F.lower("app"), "category": app_category(F.lower("app"))}).drop("__t")


DISTANCE_COLUMNS = ["start_time", "words", "counts", "norm", "low_app", "category", "generic_task"]


def distance_parts(p: Side, c: Side, max_gap_minutes: float = 60.0) -> dict[str, Column]:
    """Text, app, temporal and behavioural distance of two segments."""
    def weight(w: Column) -> Column:
        at = F.array_position(c("words"), w).cast("int")
        return F.when(at > 0, F.element_at(c("counts"), F.greatest(at, F.lit(1)))).otherwise(0.0)

    dot = F.aggregate(F.zip_with(p("words"), p("counts"), lambda w, n: n * weight(w)), F.lit(0.0), lambda s, v: s + v)
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (p("norm") * c("norm"))))
    empty = (F.size(p("words")) < 1) | (F.size(c("words")) < 1)
    unknown = (p("generic_task") == "unknown") | (c("generic_task") == "unknown")
    related = F.lit(False)
    for a, b in rules.RELATED_TASKS:
        related = related | (p("generic_task").isin(a, b) & c("generic_task").isin(a, b))
    gap = F.abs(scoring.minutes_between(p("start_time"), c("start_time")))
    return {
        "text": F.when(empty, 1.0).otherwise(1.0 - cosine),
        "app": F.when((p("low_app") == "") | (c("low_app") == ""), 0.5).when(p("low_app") == c("low_app"), 0.0).when(p("category") == c("category"), 0.3).otherwise(1.0),
        "temporal": F.least(gap / max_gap_minutes, F.lit(1.0)),
        "behavioral": F.when(unknown, 0.5).when(p("generic_task") == c("generic_task"), 0.0).when(related, 0.4).otherwise(1.0),
    }


def neighbour_distances(segments: DataFrame, max_gap_minutes: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Distance of every segment to the one before it in the session."""
    weights = weights or DISTANCE_WEIGHTS
    seen = scan_rows(with_counts(segments), ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"), lag={"p": F.struct(*DISTANCE_COLUMNS)}).filter("p is not null")
    parts = distance_parts(lambda n: F.col("p")[n], F.col, max_gap_minutes)
    rows = seen.withColumns({f"{n}_distance": c for n, c in parts.items()})
    total = F.lit(0.0)
    for n in parts:
        total = total + F.col(f"{n}_distance") * F.lit(weights[n])
    return rows.withColumn("distance", total).drop("p", "words", "counts", "norm", "low_app", "category")


def distance_distribution(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Count, range, mean, quartiles by position and bands of the distances of a key."""
    d = F.col("distance")
    base = distances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.min(d).alias("lowest"), F.max(d).alias("highest"), F.avg(d).alias("mean"),
        F.count_if(d < 0.3).alias("very_similar"), F.count_if((d >= 0.3) & (d < 0.5)).alias("similar"), F.count_if(d >= 0.5).alias("different"))
    n = F.col("n")
    ranks = index_percentiles(distances, keys, "distance", {"q1": F.floor(n / 4), "q2": F.floor(n / 2), "q3": F.floor(n * 3 / 4)}, width=0.01)
    return base.join(ranks.drop("n").hint("merge"), keys)


def merge_neighbours(distances: DataFrame, segments: DataFrame, eps: float = 0.4) -> DataFrame:
    """J03 / J08 on neighbours: segments of a session chained while the distance to the one before is at
    most ``eps``. Adds the cluster number, from 0 per session."""
    near = distances.select("segment_id", "distance")
    rows = segments.join(near.hint("merge"), "segment_id", "left").withColumn("opens", F.when(F.col("distance") <= eps, 0).otherwise(1))
    done = scan_rows(rows, ["session_id"], ["start_time", "segment_id"], day_chunk("start_time"), run_sum={"cluster": F.col("opens")})
    return done.withColumn("cluster", F.col("cluster") - 1).drop("opens")


def merged_segments(clustered: DataFrame) -> DataFrame:
    """One row per session and cluster: modal app and task, mean confidence, duration, and the three
    most frequent title words (a single title stays as it is)."""
    group = ["session_id", "cluster"]
    clustered = cut_lineage(clustered)  # feeds four aggregates
    base = clustered.groupBy(*group).agg(
        F.min("start_time").alias("start_time"), F.max_by("end_time", F.struct("start_time", "segment_id")).alias("end_time"), (F.sum("duration_seconds") / 60).alias("duration_minutes"),
        F.count(F.lit(1)).alias("segment_count"), F.avg("confidence").alias("confidence"), F.count_if(F.col("normalized_title") != "").alias("titles"),
        F.min_by("normalized_title", F.when(F.col("normalized_title") != "", F.struct("start_time", "segment_id"))).alias("first_title"))
    def modal(c: str, out: str) -> DataFrame:
        counts = clustered.groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_time", "segment_id")).alias("f"))
        return counts.groupBy(*group).agg(F.min_by(c, F.struct(-F.col("n"), F.col("f"))).alias(out))
    words = clustered.filter("normalized_title <> ''").select(
        *group, "start_time", "segment_id", F.posexplode(F.split(F.lower("normalized_title"), f"{text.BLANK}+")).alias("i", "word")).filter(F.length("word") > 2)
    counts = words.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_time", "segment_id", "i")).alias("f"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "f")
    top = counts.withColumn("r", F.row_number().over(w)).filter("r <= 3").withColumn("word", F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), " ")  # three words
    title = F.when(F.col("titles") == 0, "Unknown").when(F.col("titles") == 1, F.col("first_title")).otherwise(F.coalesce("words", "first_title"))
    rows = base.join(modal("app", "app").hint("merge"), group).join(modal("generic_task", "generic_task").hint("merge"), group).join(top.groupBy(*group).agg(joined.alias("words")).hint("merge"), group, "left")
    label = text.title_case(F.replace("generic_task", F.lit("_"), F.lit(" ")))
    return rows.withColumn("window_context", title).withColumn("task_name", F.concat_ws(" - ", label, "window_context")).drop("words", "titles", "first_title")


def sweep(distances: DataFrame, segments: DataFrame, eps_values: list[float]) -> DataFrame:
    """Clusters, merged segments and score per session and threshold, in one pass: a cluster
    opens wherever the distance to the segment before exceeds the threshold."""
    rows = segments.select("session_id", "segment_id").join(distances.select("segment_id", "distance").hint("merge"), "segment_id", "left")
    per = F.explode(F.array(*[F.lit(e) for e in eps_values]))
    n, opened = F.count(F.lit(1)), F.sum(F.when(F.col("distance") <= F.col("eps"), 0).otherwise(1))
    tried = rows.withColumn("eps", per).groupBy("session_id", "eps").agg(n.alias("segments"), opened.alias("clusters"))
    ideal = F.greatest(F.lit(2), F.floor(F.col("segments") / 3))
    return tried.withColumns({
        "merged": F.col("segments") - F.col("clusters"), "reduction": 1.0 - F.col("clusters") / F.col("segments"),
        "score": 10 - F.abs(F.col("clusters") - ideal)})


def best_parameters(tried: DataFrame, n: int = 5) -> DataFrame:
    """thresholds of each session by score."""
    w = Window.partitionBy("session_id").orderBy(F.desc("score"), "eps")
    return tried.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
