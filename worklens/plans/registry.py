"""The list of registered queries: name -> Spark callable, and name -> equal SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}
NUDGE = 1e-9


def tidy(df: DataFrame) -> DataFrame:
    """Rounded doubles, 64-bit counts and text dates, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = F.round(c + F.signum(c) * NUDGE, 6)
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, covers: str, sql: str | None = None, like: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists the SURVEY ids. ``like`` names an earlier query with the same rows and SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = _outer(sql)
        if like is not None:
            ORACLE[name] = ORACLE[like]
        return fn

    return wrap


def _outer(sql: str) -> str:
    """Nudge every ``round(x, 6)`` away from exact halves, as ``tidy`` does, because the two engines
    represent a half slightly differently."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out).strip()
        depth, k, comma, quoted = 1, j + 6, -1, False
        while depth:
            ch = sql[k]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch in "([{") - (ch in ")]}")
                if ch == "," and depth == 1:
                    comma = k
            k += 1
        word_start = j == 0 or not (sql[j - 1].isalnum() or sql[j - 1] == "_")
        if word_start and comma > 0 and sql[comma + 1 : k - 1].strip() == "6":
            x = _outer(sql[j + 6 : comma])
            out.append(f"{sql[i:j]}round(({x}) + sign({x}) * {NUDGE}, 6)")
        else:
            out.append(sql[i : j + 6] + _outer(sql[j + 6 : k]))
        i = k
