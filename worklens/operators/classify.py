"""Task classification: app rules, title rules, behavioural signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import rules
from worklens.functions.text import contains_any


def _hit(task: str, confidence: float) -> Column:
    return F.struct(F.lit(task).alias("task"), F.lit(confidence).alias("confidence"))


def by_app(app: Column, title: Column) -> Column:
    """Struct (task, confidence), null when no rule fits. ``app`` and ``title`` are lower case."""
    chain = None
    for task, parts in rules.APP_RULES:
        hit = contains_any(app, parts)
        value = _hit(task, rules.APP_RULE_CONFIDENCE)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    browser = contains_any(app, rules.RULE_BROWSERS)
    for task, words in rules.BROWSER_TITLE_RULES:
        chain = chain.when(browser & contains_any(title, words), _hit(task, 0.75))
    chain = chain.when(browser, _hit("browsing_research", 0.65))
    teams = app.contains("teams")
    chain = chain.when(teams & contains_any(title, rules.TEAMS_CALL_WORDS), _hit("video_conferencing", 0.85))
    return F.when(app != "", chain.when(teams, _hit("chat_messaging", 0.75)))


def by_title(title: Column) -> Column:
    """Struct (task, confidence) of the first title rule that fits."""
    chain = None
    for words, task, confidence in rules.TITLE_RULES:
        hit = contains_any(title, words)
        chain = F.when(hit, _hit(task, confidence)) if chain is None else chain.when(hit, _hit(task, confidence))
    return chain


def unit(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def signature_array() -> Column:
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(
            ("task", "intensity", "continuity", "entropy", "app_diversity", "duration", "min_confidence"), s[:7])], F.lit(i).alias("rank"))
        for i, s in enumerate(rules.SIGNATURES)
    ]
    return F.array(*rows)


def nearest_signature(intensity: Column, continuity: Column, windows: Column, diversity: Column, hours: Column) -> Column:
    """Closest of the 22 signatures as (distance, rank, task, min_confidence). The
    signatures are a literal array inside the row, so no join and no pairs are made."""
    seen = (unit(intensity, 0, 100), continuity, unit(windows, 0, 20), unit(diversity, 0, 1), unit(hours, 0, 4))
    names = ("intensity", "continuity", "entropy", "app_diversity", "duration")

    def measured(s: Column) -> Column:
        parts = [F.lit(w) * (o - s[n]) * (o - s[n]) for w, o, n in zip(rules.SIGNATURE_WEIGHTS, seen, names)]
        distance = F.least(F.lit(1.0), F.sqrt(reduce(lambda a, b: a + b, parts)) / rules.SIGNATURE_SCALE)
        return F.struct(distance.alias("distance"), s["rank"].alias("rank"), s["task"].alias("task"), s["min_confidence"].alias("min_confidence"))

    return F.array_min(F.transform(signature_array(), measured))


def signature_confidence(best: Column) -> Column:
    raw = 1.0 - best["distance"]
    return F.when(raw < best["min_confidence"], raw * 0.7).otherwise(raw)


def recommend(df: DataFrame) -> DataFrame:
    """Adds ``task``, ``confidence``, ``reason``.

    Needs app, window_title, intensity, continuity, num_windows, app_diversity, duration_hours,
    mic_ratio and camera_ratio.
    """
    app = F.lower(F.coalesce("app", F.lit("")))
    title = F.lower(F.coalesce("window_title", F.lit("")))
    step = df.withColumns({"__a": app, "__t": title}).withColumns({
        "__app": by_app(F.col("__a"), F.col("__t")),
        "__title": by_title(F.col("__t")),
        "__best": nearest_signature(*[F.col(c) for c in ("intensity", "continuity", "num_windows", "app_diversity", "duration_hours")]),
    }).withColumn("__conf", signature_confidence(F.col("__best")))
    a, t, best, conf = F.col("__app"), F.col("__title"), F.col("__best"), F.col("__conf")
    a_conf = F.coalesce(a["confidence"], F.lit(0.0))

    def answer(task, confidence, reason) -> Column:
        wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(wrap(task).alias("task"), wrap(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason"))

    meeting_like = (
        contains_any(F.col("__a"), rules.CONFERENCE_APPS) | contains_any(F.col("__t"), rules.CONFERENCE_WORDS)
        | (F.coalesce("mic_ratio", F.lit(0.0)) >= 0.3) | (F.coalesce("camera_ratio", F.lit(0.0)) >= 0.2)
    )
    blocked = (best["task"] == "video_conferencing") & ~meeting_like
    blended = answer(F.when(a_conf > t["confidence"], a["task"]).otherwise(t["task"]), (t["confidence"] + a_conf) / 2, "title_and_app_match")
    result = (
        F.when(contains_any(F.col("__t"), ["system tray overflow", "systemtrayoverflow"]), answer("general_productivity", 0.2, "ignored_system_ui"))
        .when(a_conf > 0.7, answer(a["task"], a_conf, "app_match"))
        .when((t["confidence"] > 0.6) & (a_conf > 0.5), blended)
        .when(t["confidence"] > 0.6, answer(t["task"], t["confidence"], "title_match"))
        .when(blocked & contains_any(F.col("__a"), rules.GUARD_BROWSERS),
              answer("browsing_research", F.greatest(F.lit(0.55), conf), "video_conf_blocked_browser_fallback"))
        .when(blocked, answer("content_consumption", F.greatest(F.lit(0.5), conf), "video_conf_blocked_fallback"))
        .when(a["task"] == best["task"], answer(best["task"], F.least(F.lit(0.95), conf + a_conf * 0.2), "behavioral_with_app_boost"))
        .when((conf < 0.4) & contains_any(F.col("__a"), ["browser", "firefox", "chrome"]), answer("browsing_research", 0.5, "browser_fallback"))
        .when(conf < 0.4, answer("general_productivity", 0.45, "low_confidence_fallback"))
        .otherwise(answer(best["task"], conf, "behavioral_match"))
    )
    return step.withColumn("__r", result).select(
        *df.columns, F.col("__r.task").alias("task"), F.col("__r.confidence").alias("confidence"), F.col("__r.reason").alias("reason")
    )


def should_transition(current: Column, new: Column, current_conf: Column, new_conf: Column, minutes: Column) -> Column:
    """Whether the current task gives way to the new one."""
    sticky = current.isin([s[0] for s in rules.SIGNATURES if s[7]])
    gap = new_conf - current_conf
    held = (gap >= 0.10) | ((minutes >= 10) & (gap >= -0.05))
    free = (gap > 0.03) | ((F.abs(gap) <= 0.15) & (minutes >= 3)) | ((minutes >= 5) & (new_conf > 0.5))
    return F.when(current == new, False).when(sticky, held).otherwise(free)


def reclassification_summary(changes: DataFrame) -> DataFrame:
    """Counts of changed and unchanged segments, and of old tasks, new tasks and reasons.
    ``changes`` has old_task, new_task, reason."""
    outcome = F.when(F.col("old_task") == F.col("new_task"), "unchanged").otherwise("changed")
    rows = changes.select(F.explode(F.array(
        F.struct(F.lit("outcome").alias("kind"), outcome.alias("value")),
        F.struct(F.lit("old_task").alias("kind"), F.col("old_task").alias("value")),
        F.struct(F.lit("new_task").alias("kind"), F.col("new_task").alias("value")),
        F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")),
    )).alias("r")).select("r.*")
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("segments"))


def apply_reclassification(segments: DataFrame, changes: DataFrame, dry_run: bool = True) -> DataFrame:
    """Segments with the new task, confidence and reason of ``changes`` (segment_id, new_task,
    new_confidence, new_reason). A dry run leaves them and only marks what would change."""
    rows = segments.join(changes, "segment_id", "left")
    differs = F.coalesce(F.col("new_task") != F.col("task_id"), F.lit(False))
    if dry_run:
        return rows.withColumn("would_change", differs).drop("new_task", "new_confidence", "new_reason")
    pick = lambda new, old: F.when(differs, F.col(new)).otherwise(F.col(old)).alias(old)
    kept = [c for c in segments.columns if c not in ("task_id", "confidence", "reason")]
    return rows.select(*kept, pick("new_task", "task_id"), pick("new_confidence", "confidence"), pick("new_reason", "reason"))
