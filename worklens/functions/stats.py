"""Exact order statistics and modes that never gather a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.sequence import scan_rows


def index_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column], width: float = 1.0, times: str | None = None
) -> DataFrame:
    """Order statistics by position (D44): for each name the value at a zero-based rank.

    Equal values are counted first; ranks then come from a running count cut into value ranges of
    ``width``, so a key with a third of all rows is spread over many tasks. ``positions`` maps a name
    to an expression over ``n`` (the rows of the key). ``times`` names a column that says how often a row counts.
    """
    present = df.filter(F.col(value).isNotNull())
    weight = F.sum(times) if times else F.count(F.lit(1))
    counts = present.groupBy(*keys, value).agg(weight.alias("__c"))
    ranked = scan_rows(counts, keys, [value], F.floor(F.col(value) / width), run_sum={"__upto": F.col("__c")})
    totals = present.groupBy(*keys).agg(weight.alias("n"))
    joined = ranked.join(totals.hint("merge"), list(keys))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col(value)))

    return joined.groupBy(*keys).agg(F.first("n").alias("n"), *[at(p).alias(name) for name, p in positions.items()])


def percent_rank_at(percent: float) -> Column:
    """Rank of a percentile: min(int(n * p), n - 1)."""
    return F.least((F.col("n") * F.lit(percent / 100.0)).cast("long"), F.col("n") - 1)


def mode_of(df: DataFrame, keys: Sequence[str], value: str, first_seen: Column, out: str) -> DataFrame:
    """most frequent value; the one seen first wins a tie. Two partial aggregations."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n"), F.min(first_seen).alias("__first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__first"))).alias(out))
