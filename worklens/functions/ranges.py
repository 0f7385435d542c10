"""Range, overlap and as-of joins written as equi-joins on time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.sequence import day_chunk, scan_rows, span_islands


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    a_span: tuple[str, str],
    b_span: tuple[str, str],
    bucket_seconds: int = 21600,
    closed: bool = False,
    how: str = "inner",
) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose spans overlap.

    Both sides are repeated once per bucket they touch and joined on (keys, bucket); a pair that
    meets in several buckets is kept only in the bucket of the later start, so no distinct is
    needed. Half-open spans by default, ``closed`` makes both ends count. Column names of the two
    sides must differ except for ``keys``. ``how='left'`` keeps the unmatched rows of ``a``, which
    needs the first column of ``a`` to identify a row.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    left = a.withColumn("__bk", F.explode(F.sequence(_bucket(F.col(a0), bucket_seconds), _bucket(F.greatest(a0, a1), bucket_seconds))))
    right = b.withColumn("__bk", F.explode(F.sequence(_bucket(F.col(b0), bucket_seconds), _bucket(F.greatest(b0, b1), bucket_seconds))))
    if closed:
        meets = (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))
    else:
        meets = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    pairs = (
        left.join(right.hint("merge"), [*keys, "__bk"])
        .filter(meets & (F.col("__bk") == _bucket(F.greatest(a0, b0), bucket_seconds)))
        .drop("__bk")
    )
    if how == "inner":
        return pairs
    row_id = a.columns[0]
    lone = a.join(pairs.select(row_id).distinct().hint("merge"), row_id, "left_anti")
    return pairs.unionByName(lone, allowMissingColumns=True)


def asof_join(
    probes: DataFrame,
    log: DataFrame,
    keys: Sequence[str],
    probe_ts: str,
    log_ts: str,
    value: str,
    out: str,
    tie: str,
) -> DataFrame:
    """For every probe the ``value`` of the latest log row with ``log_ts <= probe_ts``.

    Both sides go through one ordered scan; log rows sort before probe rows at the same time, and
    log rows of one time sort by ``tie``. Probe rows keep all their columns.
    """
    payload = F.struct(*[F.col(c) for c in probes.columns])
    left = probes.select(
        *keys, F.col(probe_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__tie"),
        payload.alias("__row"), F.lit(None).cast(log.schema[value].dataType).alias("__v"),
    )
    right = log.select(
        *keys, F.col(log_ts).alias("__ts"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"),
        F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"),
    )
    both = left.unionByName(right)
    seen = scan_rows(both, keys, ["__ts", "__side", "__tie"], day_chunk("__ts"), known={out: F.col("__v")})
    return seen.filter("__side = 1").select("__row.*", out)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, chunk: Column | None = None) -> DataFrame:
    """Merge spans of a key that overlap or touch (``start <= end so far``): keys, start, end, n."""
    marked = span_islands(
        df.select(*keys, start, end), keys, start, end, [end], chunk if chunk is not None else day_chunk(start),
        lambda s, seen: s > seen, out="__isl",
    )
    return marked.groupBy(*keys, F.col("__isl").alias(start)).agg(
        F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")
    )
