"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Entries are the different texts with their 64-bit key. The directory starts with one bucket and doubles
while a bucket is overfull: a bucket of local depth d owns the keys with one d-bit prefix. Texts whose
keys collide stand as a chain of entries with the same key, told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import lower_az, written

#: Entries of a bucket before it splits, and the largest directory (2 ** 16 cells, under 1 MB).
CAPACITY = 4096
MAX_DEPTH = 16


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the normalised text, its key and the directory cell the key falls in."""
    k = docs.select("doc_id", lower_az(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    return k.withColumn("cell", F.shiftrightunsigned("key", 64 - MAX_DEPTH))


def entries(docs: DataFrame) -> DataFrame:
    """One entry for each different text. Grouping by key and text compares the bytes of a chain; copies
    are counted before the shuffle, so a text with very many copies sends one row from each task."""
    return (
        keyed(docs)
        .groupBy("cell", "key", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("cell", "key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size")
    )


def directory(index: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, depth, bucket): at most 2 ** 16 rows. A cell belongs to the shallowest prefix that holds no
    more than ``capacity`` entries; at the largest depth a bucket grows by chaining instead."""
    cells = index.groupBy("cell").agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    local = levels.join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return local.withColumn("bucket", F.expr(f"shiftleft(1L, depth) + shiftright(cell, {MAX_DEPTH} - depth)"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket for every row of ``docs`` (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; a null text is the empty text. The largest doc_id
    of a group stays. Repeated rows of one doc_id and text count in ``group_size`` and share their fate; a
    group whose ids are all null keeps its rows, other null ids are dropped copies. An empty table gives no
    rows; other columns are not read.
    """
    index = written(entries(docs))
    cells = written(directory(index, capacity))
    index = index.join(F.broadcast(cells), "cell").select("bucket", "key", "text_sha256", "keep_id", "group_size")
    probe = keyed(docs).select("doc_id", "cell", "key", F.sha2("norm", 256).alias("text_sha256")).join(F.broadcast(cells), "cell")
    return probe.join(index, ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket"
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps; repeated rows of one id and text stay once."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.withColumn("__sha", F.sha2(lower_az(F.col("text")), 256))
    both = rows.join(stay, (rows["doc_id"].eqNullSafe(stay["__id"])) & (rows["__sha"] == stay["__sha"]), "left_semi")
    return both.dropDuplicates(["doc_id", "__sha"]).drop("__sha")
