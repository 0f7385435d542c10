"""Changes of stored tables that are kept by date: only the dates that a change touches are written again.

Tables are Parquet folders with a folder for each date (``sinks.append``). A change reads the touched dates, and Spark's dynamic partition overwrite
replaces just these; the files of all other dates stay as they are. Dates left without rows are dropped as folders. A change is
repeatable: after a failure the same call gives the same table.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.session import cut_lineage

#: Files of a date.
FILES = 32


def create(df: DataFrame, path: str, ts: str) -> None:
    """The rows of ``df`` as a table by the date of ``ts``; rows without a time stand under no date, which no age ever reaches."""
    _write(df.withColumn("date", F.to_date(ts)), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dates_of(spark: SparkSession, path: str) -> dict[datetime.date | None, str]:
    """The dates of a table and their folders; the folder names are read, no rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.getPath().getName().startswith("date=")]
    values = [(p.getName().removeprefix("date="), p.toString()) for p in names]
    return {None if v == "__HIVE_DEFAULT_PARTITION__" else datetime.date.fromisoformat(v): p for v, p in values}


def _write(rows: DataFrame, path: str) -> None:
    spread = rows.repartition("date", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "date"]), F.lit(FILES)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def _drop(spark: SparkSession, path: str, gone: list[datetime.date | None]) -> None:
    for date, folder in dates_of(spark, path).items():
        if date in gone:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _on(dates: list[datetime.date | None]):
    """A condition on the partition column alone, so that other dates are not listed as input."""
    known = [d for d in dates if d is not None]
    on = F.col("date").isin(known) if known else F.lit(False)
    return on | F.col("date").isNull() if None in dates else on


def _change(spark: SparkSession, path: str, touched: DataFrame, make) -> list[datetime.date | None]:
    """Write the dates in ``touched`` (date) again as ``make`` of their rows; returns them. There are as many as the calendar has."""
    dates = [r["date"] for r in touched.select("date").distinct().collect()]
    if dates:
        old = read(spark, path)
        # a stored copy first: the dates are read and replaced, and a task that is run again must find the old rows
        rows = cut_lineage(make(old.where(_on(dates))).select(old.columns))
        _write(rows, path)
        held = {r["date"] for r in rows.select("date").distinct().collect()}
        _drop(spark, path, [d for d in dates if d not in held])
    return dates


def _placed(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The dates that hold rows of ``keys``: only key columns are read."""
    return read(spark, path).join(keys.distinct(), keys.columns, "left_semi").select("date")


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: list[str], ts: str) -> list[datetime.date | None]:
    """The newest row of every changed key, by ``order``, is its row; others stay. A key may move to another date."""
    fresh = changes.withColumn("date", F.to_date(ts))

    def make(old: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in keys]
        both = old.unionByName(fresh)
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")

    return _change(spark, path, _placed(spark, path, changes.select(*keys)).union(fresh.select("date")), make)


def replace(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str], required: list[str], ts: str) -> list[datetime.date | None]:
    """All rows of the keys in ``fresh`` are replaced; fresh rows without a required column are dropped, their keys are cleared."""
    rows = fresh.withColumn("date", F.to_date(ts))
    gone = fresh.select(*keys).distinct()
    make = lambda old: old.join(gone, keys, "left_anti").unionByName(rows.na.drop(subset=required))
    return _change(spark, path, _placed(spark, path, gone).union(rows.na.drop(subset=required).select("date")), make)


def delete(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> list[datetime.date | None]:
    """Rows of the keys in ``gone`` are deleted; apply it to a session table and to its child tables."""
    gone = gone.select(*keys).distinct()
    return _change(spark, path, _placed(spark, path, gone), lambda old: old.join(gone, keys, "left_anti"))


def expire(spark: SparkSession, path: str, ts: str, now: datetime.datetime, days: int) -> tuple[int, list[datetime.date | None]]:
    """Rows older than ``days`` go. Dates before that of the cut-off are dropped as folders, without reading a row; only
    the date of the cut-off is written again. Returns how many were dropped and which were written."""
    cut = now - datetime.timedelta(days=days)
    limit = F.lit(cut.isoformat(sep=" ")).cast("timestamp")
    old = [d for d in dates_of(spark, path) if d is not None and d < cut.date()]
    _drop(spark, path, old)
    held = read(spark, path).where(_on([cut.date()])) if cut.date() in dates_of(spark, path) else None
    if held is None:
        return len(old), []
    late = held.where(F.col(ts) < limit).select("date").limit(1)
    return len(old), _change(spark, path, late, lambda rows: rows.where(~F.coalesce(F.col(ts) < limit, F.lit(False))))
