"""What several operators share: table reads, stored intermediates and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.session import cut_lineage, shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (in folders ``by`` columns), read back without its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and the fields of ``ddl`` after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def lower_az(text: Column) -> Column:
    """``text`` with only A-Z lower-cased, null as empty. ``lower`` does just that on ASCII text, and faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of ``texts`` of about ``size`` bytes, so that a worker's arrays stay small; a longer text
    makes a run of its own."""
    bytes_ = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(bytes_) - bytes_) // size if len(bytes_) else bytes_
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    yield from zip(starts.tolist(), np.diff(starts, append=len(run)).tolist(), strict=True)


def free_memory() -> None:
    """Give what a task has freed back to the machine: Python workers live on for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes. Each
    step is an aggregate and a join on the node, so a node with very many edges is split like any skewed
    join key; edges stay as many as they were. Every step is checkpointed.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node below all its neighbours keeps them by the rows above; the others point at the smallest
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
