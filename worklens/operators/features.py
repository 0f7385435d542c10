"""The 97 features of a task segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import rules, scoring, text
from worklens.functions.sequence import CHUNK, day_chunk


def one_hot(value: Column, values: list[str], other_last: bool = False) -> Column:
    """H27."""
    hits = [F.when(value == v, 1.0).otherwise(0.0) for v in values]
    if other_last:
        known = value.isin(values[:-1])
        hits[-1] = F.when(F.coalesce(known, F.lit(False)), 0.0).otherwise(1.0)
    return F.array(*[F.coalesce(h, F.lit(0.0)) for h in hits])


def duration_bin(minutes: Column) -> Column:
    """H19."""
    return F.when(minutes < 2, "very_short").when(minutes < 10, "short").when(minutes < 30, "medium").otherwise("long")


def task_one_hot(task: Column) -> Column:
    """First category named in the task id, with blanks or underscores."""
    low, chain = F.lower(task), None
    for i, name in enumerate(rules.ONEHOT_TASKS):
        hit = low.contains(name.replace("_", " ")) | low.contains(name)
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    at = F.coalesce(chain, F.lit(-1))
    return F.array(*[F.when(at == i, 1.0).otherwise(0.0) for i in range(len(rules.ONEHOT_TASKS))])


def title_flags(title: Column, tokens: Column) -> list[Column]:
    """Six word flags and three part flags."""
    flags = [F.arrays_overlap(tokens, text.literals(words)) for _, words in rules.DOMAIN_WORDS]
    flags += [text.contains_any(title, parts) for _, parts in rules.TITLE_PARTS]
    return [F.coalesce(f, F.lit(False)).cast("double") for f in flags]


def duration_history(segments: DataFrame, newest: int | None = None) -> DataFrame:
    """Per user and task id, durations of the closed segments; with ``newest`` only of a user's newest
    so many, which then are ranked by user in windows that keep no more rows than that."""
    rows = segments.filter("end_time is not null")
    if newest is not None:
        w = Window.partitionBy("user_id").orderBy(F.desc("start_time"), F.desc("segment_id"))
        rows = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= newest)
    return rows.withColumn("m", scoring.minutes_between("start_time", "end_time")).filter("m > 0").groupBy("user_id", "task_id").agg(
        F.avg("m").alias("avg_task_duration"), F.min("m").alias("min_task_duration"), F.max("m").alias("max_task_duration"), F.count(F.lit(1)).alias("task_frequency"))


def keyword_vocabulary(titles: DataFrame, title: str, size: int = 50) -> DataFrame:
    """the most frequent title words with their position."""
    counted = titles.groupBy(F.col(title).alias("title")).agg(F.count(F.lit(1)).alias("n"))  # a title that comes often is split once
    words = counted.select(F.explode(text.feature_keywords(text.feature_tokens(F.col("title")))).alias("word"), "n")
    counts = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    ranked = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("v"))  # at most ``size`` rows
    return ranked.select(F.transform("v", lambda w: w["word"]).alias("vocabulary"))


def sequence_context(segments: DataFrame) -> DataFrame:
    """Previous task, position in the session, and whether the segment goes back to the task of
    two segments ago. A row looks back inside its day (see ``functions.sequence``); the first two rows of a
    day take the last two tasks of the session's days before, all in one scan."""
    order, part = ["start_time", "segment_id"], ["session_id", CHUNK]
    local, across = Window.partitionBy(*part).orderBy(*order), Window.partitionBy("session_id").orderBy(CHUNK)
    task = F.struct(F.col("generic_task").alias("v"))
    rows = segments.withColumn(CHUNK, day_chunk("start_time")).withColumns({
        "__one": F.lag(task).over(local), "__two": F.lag(task, 2).over(local), "__n": F.row_number().over(local)})
    days = rows.groupBy(*part).agg(F.max("__n").alias("__rows"), F.max_by(F.struct(task.alias("one"), F.col("__one").alias("two")), F.struct(*order)).alias("__last"))
    carry = days.select(
        *part, F.lag("__last.one").over(across).alias("__day_one"),
        F.coalesce(F.lag("__last.two").over(across), F.lag("__last.one", 2).over(across)).alias("__day_two"),
        F.coalesce(F.sum("__rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__seen"))
    two = F.coalesce("__two", F.when(F.col("__n") == 1, F.col("__day_two")).otherwise(F.col("__day_one")))["v"]
    return rows.join(carry.hint("merge"), part).select(
        *segments.columns, F.coalesce("__one", "__day_one")["v"].alias("previous_task"), (F.col("__n") + F.col("__seen") - 1).alias("position"),
        F.coalesce((F.col("__n") + F.col("__seen") > 2) & (two == F.col("generic_task")), F.lit(False)).alias("is_task_return"))


def segment_vectors(segments: DataFrame, history: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vector of 97 values for closed segments (see ``scans.closed_segments``).

    ``history`` has one row per user and task id and is joined on them, ``vocabulary`` is one row of at
    most 50 words and is broadcast.
    """
    h = history.select("user_id", F.col("task_id").alias("generic_task"), "avg_task_duration", "task_frequency")
    rows = sequence_context(segments).join(h, ["user_id", "generic_task"], "left")
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(vocabulary.withColumn("__one", F.lit(1))), "__one").drop("__one")
    title = F.when(F.col("normalized_title") != "", F.col("normalized_title")).otherwise(F.col("window_title"))
    rows = rows.withColumns({"title": title, "minutes": F.col("duration_seconds") / 60.0}).withColumns({
        "tokens": text.feature_tokens(F.col("title")), "low": F.lower("title")}).withColumn("words", text.feature_keywords(F.col("tokens")))
    hour, weekday, one = F.hour("start_time"), F.weekday("start_time"), F.lit(1.0)
    part = scoring.time_of_day(hour)
    d = lambda c: c.cast("double")
    ratio = F.when(F.col("avg_task_duration") > 0, F.col("minutes") / F.col("avg_task_duration")).otherwise(1.0)
    has_prev = F.col("position") > 0
    groups = [
        one_hot(F.lower(F.coalesce("app", F.lit("unknown"))), rules.ONEHOT_APPS, other_last=True), one_hot(part, rules.ONEHOT_TIMES),
        one_hot(duration_bin(F.col("minutes")), rules.ONEHOT_DURATIONS),
        F.array(F.log1p("minutes"), hour / 24.0, weekday / 7.0, d(weekday >= 5), d((hour >= 9) & (hour < 17))),
        F.when(has_prev, task_one_hot(F.col("previous_task"))).otherwise(F.array(*[F.lit(0.0)] * 6)),
        F.array(F.least(F.col("position") / 10.0, one), d(F.col("is_task_return")), F.least(F.coalesce("task_frequency", F.lit(0)) / 100.0, one), ratio, d(F.col("position") == 0)),
        F.array(F.least(F.size("tokens") / 20.0, one), F.least(F.size("words") / 10.0, one), *title_flags(F.col("low"), F.col("tokens"))),
        F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.when(F.array_contains(F.col("words"), F.get(F.col("vocabulary"), i - 1)), 1.0).otherwise(0.0)),
    ]
    return rows.select("segment_id", "session_id", "task_id", "generic_task", "start_time", "confidence", F.concat(*groups).alias("features"))


def title_hash(title: Column, dimensions: int = 10) -> Column:
    """Share of characters per bucket; a character falls into (code point + position) mod 10."""
    chars = F.split(title, "")
    place = lambda c, i: (F.ascii(c) + i) % dimensions
    n = F.size(chars).cast("double")
    buckets = F.transform(chars, place)
    share = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda b: F.size(F.filter(buckets, lambda v: v == b)) / n)
    return F.when(title.isNull() | (title == ""), F.array(*[F.lit(0.0)] * dimensions)).otherwise(share)


def time_number(part: Column) -> Column:
    """H29."""
    return F.when(part == "morning", 0.25).when(part == "evening", 0.75).when(part == "night", 0.0).otherwise(0.5)


def top_apps(segment_apps: DataFrame, size: int = 20) -> DataFrame:
    """F04 / J01 fit: the apps found in most segments, sorted by name, as one array of bounded size."""
    counts = segment_apps.groupBy("app").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "app").limit(size)
    return counts.agg(F.array_sort(F.collect_list("app")).alias("known_apps"))


def encode_segments(segments: DataFrame, fitted: DataFrame) -> DataFrame:
    """J01 transform: app one-hot over the fitted apps and OTHER, title hash, time number, flags."""
    rows = segments.withColumn("__one", F.lit(1)).join(F.broadcast(fitted.withColumn("__one", F.lit(1))), "__one").drop("__one")
    known = F.array_contains("known_apps", F.col("primary_app"))
    hot = F.transform("known_apps", lambda a: F.when(a == F.col("primary_app"), 1).otherwise(0))
    other = F.when(F.coalesce(known, F.lit(False)), 0).otherwise(1)
    return rows.withColumns({
        "app_onehot": F.concat(hot, F.array(other)), "window_hash": title_hash(F.col("primary_window_title")), "time_numeric": time_number(F.col("time_of_day"))}).drop("known_apps")
