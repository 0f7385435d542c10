"""Window-title and app-name expressions. Patterns are spelled so that letters, digits and blanks of
all scripts count."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions import rules

BLANK = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
WORD = r"\p{L}\p{N}_"


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital, the rest is lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2147483647))), "")


def clean_title(title: Column, keep_spaces: bool = False) -> Column:
    """Unify dashes, drop the browser suffix, turn separators into `` | ``.

    By default blanks inside the title are dropped, as the studied behaviour does; ``keep_spaces``
    keeps them and strips every known browser suffix.
    """
    t = F.translate(title, "–—•", "---")
    if keep_spaces:
        for suffix in rules.BROWSER_SUFFIXES:
            t = F.regexp_replace(t, rf"(?i) [-|] {re.escape(suffix)}\z", "")
    else:
        t = F.regexp_replace(t, rf"(?i) - {rules.BROWSER_SUFFIXES[0]}\z", "")
        t = F.replace(t, F.lit(" "), F.lit(""))
    # both look for blanks first, at every place; most titles have no such mark
    parted = F.regexp_replace(F.regexp_replace(t, rf"{BLANK}*[-–—|]{BLANK}*[-–—|]+{BLANK}*", " | "), rf"{BLANK}*[-–—]{BLANK}*", " | ")
    t = F.when(F.translate(t, "-–—|", "") == t, t).otherwise(parted)
    t = F.regexp_replace(t, r"\A[ |\-–—]+|[ |\-–—]+\z", "")
    noisy = F.lower(title).contains("system tray overflow")
    return F.when(title.isNull() | (title == "") | noisy, "").otherwise(t)


def clean_interval_title(title: Column) -> Column:
    """Lower case, browser parts removed, only a-z, 0-9 and single blanks."""
    t = F.lower(title)
    for part in rules.INTERVAL_TITLE_PARTS:
        t = F.replace(t, F.lit(part), F.lit(""))
    t = F.regexp_replace(t, BLANK, " ")
    t = F.regexp_replace(t, r"[^a-z0-9 ]", "")
    return F.coalesce(F.trim(F.regexp_replace(t, " +", " ")), F.lit(""))


def app_display_name(app: Column) -> Column:
    """H03."""
    bare = F.regexp_replace(app, r"(?i)\.exe\z", "")
    out = None
    for key, name in rules.APP_DISPLAY_NAMES.items():
        hit = F.lower(bare) == key
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(app.isNull() | (app == ""), "").otherwise(out.otherwise(title_case(F.replace(bare, F.lit("_"), F.lit(" ")))))


def _split_words(text: Column) -> Column:
    """Lower-case runs of letters, digits, ``_`` and ``-``."""
    return F.split(F.lower(text), f"[^{WORD}-]+")


def feature_tokens(title: Column) -> Column:
    """Words of at least two characters (letters, digits, ``_`` and ``-``)."""
    return F.filter(_split_words(title), lambda w: F.length(w) > 1)


def feature_keywords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(rules.FEATURE_STOPWORDS))


def naming_keywords(title: Column) -> Column:
    """First ten words of three or more characters of the cleaned title."""
    words = F.split(F.lower(clean_title(title)), r"[-_|•·:;\t-\r\x1c-\x1f \x{85}\p{Z}]+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(rules.NAMING_NOISE)), 1, 10)


def cluster_tokens(title: Column) -> Column:
    """Words without surrounding punctuation, three or more characters. The punctuation is taken
    off in one pass over the whole title: marks after or before a blank."""
    blank, marks = r"\t-\r\x1c-\x1f \x{85}\p{Z}", r"""\[\](){}:;,."'"""
    bare = F.regexp_replace(F.lower(title), f"(?=[{marks}])(?:(?<![^{blank}])[{marks}]+|[{marks}]+(?![^{blank}]))", "")
    return F.filter(F.split(bare, f"{BLANK}+"), lambda w: (F.length(w) > 2) & ~w.isin(rules.CLUSTER_STOPWORDS))


def without_distance_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(rules.DISTANCE_STOPWORDS))


def distance_tokens(title: Column) -> Column:
    return F.filter(_split_words(title), lambda w: (F.length(w) > 1) & ~w.isin(rules.DISTANCE_STOPWORDS))


def entities(title: Column) -> Column:
    """Tools named in the title, group by group, then the first three capitalised words."""
    found = [F.regexp_extract_all(F.lower(title), F.lit(p), 1) for p in rules.TOOL_PATTERNS]
    names = F.slice(F.regexp_extract_all(title, F.lit(rules.NAME_PATTERN), 1), 1, 3)
    return F.concat(*found, names)


def domain_scores(title: Column, app: Column) -> Column:
    """Array of (score, -position, domain, category); ``title`` and ``app`` are lower case."""

    def count(text: Column, parts: list[str], weight: int) -> Column:
        return reduce(lambda x, y: x + y, [F.when(text.contains(p), weight).otherwise(0) for p in parts], F.lit(0))

    rows = []
    for i, (name, category, words, endings, sites, apps) in enumerate(rules.DOMAINS):
        score = count(title, words, 2) + count(title, endings, 3) + count(title, sites, 3) + count(app, apps, 4)
        rows.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("domain"), F.lit(category).alias("category")))
    return F.array(*rows)


def domain_of(title: Column, app: Column) -> Column:
    """Best domain as a struct, null when no rule scores."""
    best = F.array_max(domain_scores(title, app))
    return F.when(best["score"] >= 2, best)


def shorten(title: Column, longest: int = 50) -> Column:
    """Cut at the last blank when that keeps at least 70 % of ``longest``."""
    head = F.substring(title, 1, longest)
    back = F.instr(F.reverse(head), " ")
    at = F.lit(longest) - back  # zero-based position of the last blank
    cut = F.when((back > 0) & (at > longest * 0.7), F.concat(F.substring(head, F.lit(1), at), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(title) <= longest, title).otherwise(cut)


def with_title_parts(df: DataFrame, app: str = "app", title: str = "window_title") -> DataFrame:
    """Add clean_title, app_name, lower-case copies and the domain struct, one step per projection so
    that each is computed once per row."""
    return (
        df.withColumns({"clean_title": clean_title(F.col(title)), "app_name": app_display_name(F.col(app))})
        .withColumns({"__lt": F.lower("clean_title"), "__la": F.lower("app_name")})
        .withColumn("domain", domain_of(F.col("__lt"), F.col("__la")))
        .drop("__lt", "__la")
    )


def with_task_name(df: DataFrame, category: Column, confidence: Column, app: str = "app", title: str = "window_title") -> DataFrame:
    """Adds ``task_name``: category, then an entity or keyword, then the app."""
    base = F.when(F.col("domain").isNotNull() & (confidence < 0.7), F.col("domain.category")).otherwise(category)
    step = with_title_parts(df, app, title).withColumns({
        "__label": title_case(F.replace(base, F.lit("_"), F.lit(" "))),
        "__ents": entities(F.col("clean_title")),
        "__words": F.filter(naming_keywords(F.col("clean_title")), lambda w: F.length(w) > 3),
    })
    ents, words, shown, clean, label = (F.col(c) for c in ("__ents", "__words", "app_name", "clean_title", "__label"))
    detail = F.when(
        F.size(ents) > 0, F.when(F.length(F.element_at(ents, 1)) > 2, F.element_at(ents, 1))
    ).when(F.size(words) > 0, title_case(F.element_at(words, 1)))
    app_hint = F.when((shown != "") & ~shown.isin("Firefox", "Chrome", "Edge", "Safari"), F.concat(F.lit("("), shown, F.lit(")")))
    bare = F.when(clean != "", F.concat(label, F.lit(": "), shorten(clean))).otherwise(label)
    step = step.withColumns({"__detail": detail, "__hint": app_hint})
    name = F.when(F.col("__detail").isNull() & F.col("__hint").isNull(), bare).otherwise(F.concat_ws(" - ", "__label", "__detail", "__hint"))
    return step.select(*df.columns, name.alias("task_name"))


def task_label(task: Column) -> Column:
    """Display form of old and new task ids."""
    pretty = lambda c: title_case(F.replace(c, F.lit("_"), F.lit(" ")))
    parts = F.split(task, r" \| ")
    three = F.concat(pretty(parts[0]), F.lit(": "), shorten(F.element_at(parts, 3)))
    two = F.concat(pretty(parts[0]), F.lit(" ("), title_case(F.replace(F.element_at(parts, 2), F.lit(".exe"), F.lit(""))), F.lit(")"))
    return (
        F.when(task.contains(" - ") | task.contains(": "), task)
        .when(F.size(parts) >= 3, three).when(F.size(parts) == 2, two).otherwise(pretty(task))
    )


def relevant_activity(app: Column, title: Column, seconds: Column) -> Column:
    """At least 30 s, a real title, no system app, no generic title. The two mixed-case names
    of the system list never match a lower-cased app; they stay for equal results."""
    a, t = F.lower(F.coalesce(app, F.lit(""))), F.lower(title)
    blank = title.isNull() | (F.length(F.regexp_replace(title, BLANK, "")) == 0)
    return (seconds >= 30) & ~blank & ~contains_any(a, rules.SYSTEM_APPS) & ~contains_any(t, rules.GENERIC_TITLES)


def generic_task(reason: Column, task: Column) -> Column:
    """Category out of the reason of a segment, else out of its task id."""
    parts = F.split(F.coalesce(reason, F.lit("")), "_")
    head, n = parts[0], F.size(parts)
    rest = F.array_join(F.slice(parts, 2, F.size(parts)), "_")
    to_at = F.array_position(parts, "to").cast("int")
    after_to = F.when((to_at > 0) & (to_at < n), F.array_join(F.slice(parts, to_at + 1, F.size(parts)), "_")).otherwise(F.lit("unknown"))
    first = (
        F.when(n < 2, "unknown")
        .when(head.isin("initial", "continuing", "behavioral"), rest)
        .when(head.contains("transition"), after_to)
        .when(head.isin("window", "app", "context"), "context_change")
        .otherwise("unknown")
    )
    known = None
    for cat in rules.ONEHOT_TASKS:
        hit = F.lower(task).contains(cat.replace("_", " "))
        known = F.when(hit, cat) if known is None else known.when(hit, cat)
    return F.when(first.isin("unknown", "context_change"), F.coalesce(known, first)).otherwise(first)
