"""URL filter: rules first, else multinomial naive Bayes over the words of the host and the tokens of the path.

Concatenated host names are split by unigram Viterbi. Word counts come from the pages' own text, plus a
short list of common web words. The classifier learns from the hosts whose words are on the list of unwanted ones.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import LOWER, UPPER, with_fields, written

RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Words that mark a host as unwanted, and words that hosts are commonly made of. Both count as seen ``SEEN`` times.
UNWANTED = [
    "adult", "ads", "bet", "bets", "betting", "casino", "cheap", "clickbait", "escort", "erotic", "gambling",
    "hentai", "jackpot", "lottery", "malware", "nude", "phish", "pills", "poker", "porn", "roulette", "scam", "sex",
    "slots", "spam", "tracker", "track", "viagra", "warez", "xxx",
]
COMMON = [
    "app", "art", "best", "big", "blog", "book", "books", "buy", "car", "city", "club", "daily", "data", "deal",
    "deals", "digital", "easy", "farm", "fast", "film", "food", "forum", "free", "fun", "game", "games", "get",
    "global", "go", "good", "green", "group", "guide", "health", "help", "home", "hot", "house", "info", "lab",
    "life", "line", "live", "local", "mail", "map", "market", "media", "mobile", "money", "music", "my", "net",
    "network", "new", "news", "now", "official", "online", "page", "park", "photo", "pics", "play", "plus", "point",
    "pro", "radio", "review", "sale", "school", "shop", "site", "smart", "social", "sport", "sports", "star", "store",
    "stream", "super", "tech", "the", "time", "today", "top", "town", "track", "travel", "tube", "video", "web",
    "wiki", "win", "work", "world", "zone",
]
SEEN = 1000
#: A word's letters at most; names longer than that are split, never cut.
LONGEST = 20
#: Hashed tokens of the classifier: its table is 2 MB at most.
BITS = 18
THRESHOLD = 0.5


def located(pages: DataFrame) -> DataFrame:
    """page_id, host (A-Z lower-cased) after the first ``://``, and path up to ``?``, ``#`` or the end; empty without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return pages.select("page_id", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of equal rules the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of ``name`` into words; an unseen word of n letters has probability 10 / (total * 10 ** n)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    base = math.log(total + 1)
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            c = counts.get(name[start:end])
            p = math.log(c) - base if c else math.log(10) - base - (end - start) * math.log(10)
            options.append((best[start][0] + p, -start))
        p, start = max(options)
        best.append((p, -start))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages: runs of letters outside the markup, lower case, up to ``LONGEST`` letters."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col("html").cast("string"), F.lit(""))), r"<[^<>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(f"char_length(word) BETWEEN 1 AND {LONGEST}")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, words) for every different host: its names, split at all but letters and then into words.

    The parts of a name that could be words are looked up in the counts by a join, so that neither the counts nor the names have
    to fit in one place; a name gets as many counts as it has parts."""
    counts = word_counts(pages)
    fixed = pages.sparkSession.createDataFrame([(w, SEEN) for w in sorted({*UNWANTED, *COMMON})], "word string, n long")
    counts = written(counts.union(fixed).groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = hosts.select(F.explode(F.split("host", r"[^\p{L}]+")).alias("name")).where("name <> ''").distinct()
    parts = names.select("name", F.explode(F.expr("sequence(1, char_length(name))")).alias("at"))
    parts = parts.select("name", F.explode(F.expr(f"transform(sequence(1, least({LONGEST}, char_length(name) - at + 1)), k -> substring(name, at, k))")).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    names = names.join(known, "name", "left")

    def split(batches):
        for b in batches:
            words = [segment(n.as_py(), {k["word"]: k["n"] for k in known.as_py() or []}, total) for n, known in zip(b.column("name"), b.column("known"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    split_names = names.mapInArrow(split, "name string, words array<string>")
    pieces = hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("nth", "name")).where("name <> ''")
    pieces = pieces.join(split_names, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("nth", "words"))).alias("w"))
    return hosts.join(pieces, "host", "left").select("host", F.coalesce(F.flatten("w.words"), F.array().cast("array<string>")).alias("words"))


_PARTS = re.compile(r"[^\W\d_]+|\d+")


def token_buckets(words: list[str], path: str) -> list[int]:
    """Hashed tokens of one URL, each once: the host's words and the path's runs of letters (lower case) or, by their length, digits."""
    tokens = ["h:" + w for w in words]
    tokens += ["p:#" + str(len(t)) if t[0].isdigit() else "p:" + t for t in _PARTS.findall(path.lower())]
    return [xxhash.xxh64_intdigest(t) >> (64 - BITS) for t in dict.fromkeys(tokens)]


def _token_counts(located_pages: DataFrame) -> DataFrame:
    def tally(batches):
        held: dict[tuple[int, bool], int] = {}
        bad = {*UNWANTED}
        for b in batches:
            for words, path in zip(b.column("words").to_pylist(), b.column("path").to_pylist(), strict=True):
                spam = not bad.isdisjoint(words)
                for t in [-1, *token_buckets(words, path)]:
                    held[t, spam] = held.get((t, spam), 0) + 1
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([held[k] for k in keys], pa.int64())], ["bucket", "spam", "n"])

    return located_pages.select("words", "path").mapInArrow(tally, "bucket int, spam boolean, n long").groupBy("bucket", "spam").agg(F.sum("n").alias("n"))


def fit(counts: pa.Table) -> tuple[float, np.ndarray]:
    """Log odds of the classes and of each hashed token (add one over the buckets seen)."""
    n = np.zeros((2, 2**BITS + 1))
    n[counts["spam"].to_numpy().astype(int), counts["bucket"].to_numpy()] = counts["n"].to_numpy()  # bucket -1 counts URLs
    urls, n = n[:, -1], n[:, :-1]
    seen = max(1, int((n.sum(axis=0) > 0).sum()))
    logp = np.log((n + 1) / (n.sum(axis=1, keepdims=True) + seen))
    return float(np.log(urls[1] + 1) - np.log(urls[0] + 1)), (logp[1] - logp[0]).astype(np.float32)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, words and score (the probability of ``block``) for every row of ``pages``.

    A null URL or one without ``://`` has an empty host and path and is judged by the classes' odds alone; repeated rows
    repeat; an empty table gives no rows. Ties of rules go to the first, a probability equal to ``threshold`` blocks."""
    rules = RULES if rules is None else rules
    places = located(pages)
    hosts = places.select("host").distinct()
    words = written(segment_hosts(pages, hosts)).withColumnRenamed("host", "__host")
    placed = written(places.join(words, F.col("host") == F.col("__host")).drop("__host"))
    model = pages.sparkSession.sparkContext.broadcast(fit(_token_counts(placed).toArrow()))

    def score(batches):
        odds, weights = model.value
        for b in batches:
            z = [odds + float(weights[token_buckets(w, p)].sum()) for w, p in zip(b.column("words").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700))))], [*b.schema.names, "score"])

    scored = placed.mapInArrow(score, with_fields(placed, "score double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "words", "score")
