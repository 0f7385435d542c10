"""Quality rules, with the lines that many documents of a host share; DataFrame functions only.

The lines of every different text are normalised and hashed; a host (the source) counts the different texts that hold a line. Lines in more
than ``LINE_DOCS`` of them are taken out, and a document that keeps less than a third of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import lower_az, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Fewest words of a document, and the largest share of its words in repeated windows, in percent.
MIN_WORDS = 50
REPEATED = 50
#: A line in more different texts of a host than this is taken out.
LINE_DOCS = 20
#: A document is rejected when it keeps less than this share of its words, in percent.
LEFT = 33


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normal_line(line: Column) -> Column:
    """Without A-Z, with one space for white space and one 0 for digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(lower_az(line), SPACE, " "), "[0-9]+", "0"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from ``words``: words in windows of three that stand twice or more.

    A window's number is 33 bits of its hash above 31 bits of its place, so that sorted numbers bring windows together that may be
    equal; those are then compared as words. Each step is one sort or one pass over the windows of a text."""
    window = "concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2))"
    equal = "coalesce(e.t = get({0}, k - 1).t, false) OR coalesce(e.t = get({0}, k + 1).t, false)"
    df = df.withColumn(
        "numbers",
        F.expr("""CASE WHEN size(words) > 2 THEN sort_array(transform(sequence(0, size(words) - 3), i ->
            shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 31) | bigint(i))) ELSE array(0L) END"""),
    )
    near = "coalesce(shiftright(x, 31) = shiftright(get(numbers, k - 1), 31), false) OR coalesce(shiftright(x, 31) = shiftright(get(numbers, k + 1), 31), false)"
    df = df.withColumn("found", F.expr(f"filter(numbers, (x, k) -> {near})"))
    df = df.withColumn("found", F.expr(f"sort_array(transform(transform(found, x -> int(x & 2147483647L)), i -> struct({window} AS t, i AS i)))"))
    df = df.withColumn("found", F.expr(f"sort_array(transform(filter(found, (e, k) -> {equal.format('found')}), e -> e.i))"))
    # a window begins three words, or as many as there are up to the next one
    covered = "aggregate(transform(found, (i, k) -> coalesce(least(3, get(found, k + 1) - i), 3)), 0L, (s, n) -> s + n)"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("numbers", "found")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, digest of the text, the measures of the text, and ``lines``: hash and words of every line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    # the split's pattern is fixed, so the words' letters are those of the text without white space
    letters = F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long")
    normal = F.transform("lines", normal_line)
    n_words = lambda line: (1 + F.char_length(line) - F.char_length(F.translate(line, " ", ""))).alias("words")
    return df.select(
        "doc_id",
        "host",
        F.md5("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        letters.alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(normal, lambda line: F.struct(F.xxhash64(line).alias("line"), n_words(line))).alias("lines"),
    )


def common_lines(texts: DataFrame, limit: int = LINE_DOCS) -> DataFrame:
    """(host, line, n_texts) of the lines in more than ``limit`` of ``texts`` (host, digest, lines), whose digests are all different in a host."""
    held = texts.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return held.groupBy("host", "line").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > limit)


def judge(docs: DataFrame, limit: int = LINE_DOCS, left: int = LEFT) -> DataFrame:
    """doc_id, the measures, base_failed, kept and n_common_words for every row of ``docs`` (doc_id, text, source).

    A null text has no words, a null source is the empty host. Equal texts of a host count as one document for its lines, so that copies
    alone make no line common, and share their fate; repeated rows come back as often as they stand. A line in exactly ``limit`` texts stays. An empty
    table gives no rows; other columns are not read, whatever their names."""
    base = written(measured(docs))
    texts = written(base.groupBy("host", "digest").agg(F.first("lines").alias("lines")))
    common = common_lines(texts, limit)
    lines = texts.select("host", "digest", F.explode("lines").alias("x")).select("host", "digest", "x.line", "x.words")
    gone = lines.join(common, ["host", "line"]).groupBy("host", "digest").agg(F.sum("words").alias("n_common_words"))
    out = base.drop("lines").join(gone, ["host", "digest"], "left").fillna(0, ["n_common_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("n_common_words")) >= left * F.col("n_words"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *measures, failed.alias("base_failed"), kept.alias("kept"), "n_common_words")
