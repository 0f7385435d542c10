"""Ordered-row operators that survive a hot key.

``Window.partitionBy(user).orderBy(ts)`` sends all rows of one user to one task. The log of one
user can be a third of the data, so ``scan_rows`` cuts each key's log into time chunks, runs the
window inside each ``(key, chunk)``, reduces every chunk to one carry row, runs the same function
over the few carry rows of a key, and joins the carry back. The largest task then holds one chunk of
one key, and the second window holds one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "__chunk"


def day_chunk(ts: str = "ts") -> Column:
    """Default chunk: the calendar day of the ordering timestamp."""
    return F.to_date(F.col(ts))


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def scan_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    known: dict[str, Column] | None = None,
    known_before: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
    run_sum: dict[str, Column] | None = None,
) -> DataFrame:
    """Add sequence columns computed over each key in ``order``.

    lag / lead     value of the previous / next row
    known          last non-null value up to and including the row
    known_before   last non-null value strictly before the row
    max_before     maximum strictly before the row
    run_sum        running sum including the row

    ``chunk`` must not decrease along ``order``; keys and order columns must not be NULL.
    """
    lag, lead, known = lag or {}, lead or {}, known or {}
    known_before, max_before, run_sum = known_before or {}, max_before or {}, run_sum or {}
    base = df.withColumn(CHUNK, chunk)
    part = [*keys, CHUNK]
    local = Window.partitionBy(*part).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)

    rows, aggs, carries = base, [], []
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    across_before = across.rowsBetween(Window.unboundedPreceding, -1)
    key = _order_key(order)

    def boxed(expr: Column) -> Column:
        return F.struct(expr.alias("v"))

    added: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for name, expr in lag.items():
        added[f"__l_{name}"] = F.lag(boxed(expr)).over(local)
        aggs.append(F.max_by(boxed(expr), key).alias(f"__s_{name}"))
        carries.append(F.lag(f"__s_{name}").over(across).alias(f"__c_{name}"))
        final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))["v"]
    for name, expr in lead.items():
        added[f"__l_{name}"] = F.lead(boxed(expr)).over(local)
        aggs.append(F.min_by(boxed(expr), key).alias(f"__s_{name}"))
        carries.append(F.lead(f"__s_{name}").over(across).alias(f"__c_{name}"))
        final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))["v"]
    for group, frame in ((known, upto), (known_before, before)):
        for name, expr in group.items():
            added[f"__l_{name}"] = F.last(expr, ignorenulls=True).over(frame)
            aggs.append(F.max_by(expr, F.when(expr.isNotNull(), key)).alias(f"__s_{name}"))
            carries.append(F.last(f"__s_{name}", ignorenulls=True).over(across_before).alias(f"__c_{name}"))
            final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    for name, expr in max_before.items():
        added[f"__l_{name}"] = F.max(expr).over(before)
        aggs.append(F.max(expr).alias(f"__s_{name}"))
        carries.append(F.max(f"__s_{name}").over(across_before).alias(f"__c_{name}"))
        final[name] = F.greatest(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    for name, expr in run_sum.items():
        added[f"__l_{name}"] = F.sum(expr).over(upto)
        aggs.append(F.sum(expr).alias(f"__s_{name}"))
        carries.append(F.sum(f"__s_{name}").over(across_before).alias(f"__c_{name}"))
        final[name] = F.col(f"__l_{name}") + F.coalesce(F.col(f"__c_{name}"), F.lit(0))

    rows = base.withColumns(added)
    carry = base.groupBy(*part).agg(*aggs).select(*part, *carries)
    return rows.join(carry.hint("merge"), part).select(*df.columns, *[c.alias(n) for n, c in final.items()])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    is_break: Callable[[], Column],
    *,
    lag: dict[str, Column],
    uses: Sequence[str],
    out: str = "island",
    within: dict[str, Column] | None = None,
) -> DataFrame:
    """Number the runs of each key from 1.

    ``is_break`` sees the previous-row columns named in ``lag`` and the row's own columns listed in
    ``uses``. Breaks are counted inside each chunk; only the first row of a chunk needs the chunk
    before it, and that row is decided on the carry rows. ``within`` adds the last non-null value
    of an earlier row of the same run.
    """
    within = within or {}
    part = [*keys, CHUNK]
    local = Window.partitionBy(*part).orderBy(*order)
    boxed = {n: F.struct(e.alias("v")) for n, e in lag.items()}
    first_row = F.row_number().over(local) == 1
    rows = (
        df.withColumn(CHUNK, chunk)
        .withColumns({"__first": first_row, **{n: F.lag(b).over(local)["v"] for n, b in boxed.items()}})
        .withColumn("__brk", F.when(F.col("__first"), F.lit(0)).otherwise(F.coalesce(is_break(), F.lit(True)).cast("int")))
    )
    rows = rows.withColumn("__cum", F.sum("__brk").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    key = _order_key(order)
    placed = {n: F.struct(e.alias("v"), F.col("__cum").alias("c")) for n, e in within.items()}
    heads = (
        rows.groupBy(*part)
        .agg(
            F.min_by(F.struct(*uses), key).alias("__head"),
            F.max_by(F.struct(*[e.alias(n) for n, e in lag.items()]), key).alias("__tail"),
            F.sum("__brk").alias("__breaks"),
            *[F.max_by(placed[n], F.when(e.isNotNull(), key)).alias(f"__k_{n}") for n, e in within.items()],
        )
        .withColumn("__prev", F.lag("__tail").over(across))
    )
    plain = [u for u in uses if u not in part]
    carry = (
        heads.select(*part, "__breaks", *[f"__k_{n}" for n in within], *[F.col("__head")[u].alias(u) for u in plain], *[F.col("__prev")[n].alias(n) for n in lag])
        .withColumn("__open", F.coalesce(is_break(), F.lit(True)).cast("int"))
        .withColumn("__off", F.sum(F.col("__breaks") + F.col("__open")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__breaks"))
    )
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*part, "__off", *[
        F.last(F.when(F.col(f"__k_{n}").isNotNull(), F.struct(F.col(f"__k_{n}")["v"].alias("v"), (F.col(f"__k_{n}")["c"] + F.col("__off")).alias("c"))),
               ignorenulls=True).over(earlier).alias(f"__kc_{n}") for n in within
    ])
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        f"__kl_{n}": F.last(F.when(e.isNotNull(), placed[n]), ignorenulls=True).over(before) for n, e in within.items()
    })
    number = F.col("__cum") + F.col("__off")
    kept = [
        F.when(F.col(f"__kl_{n}").isNotNull(), F.when(F.col(f"__kl_{n}")["c"] == F.col("__cum"), F.col(f"__kl_{n}")["v"]))
        .otherwise(F.when(F.col(f"__kc_{n}")["c"] == number, F.col(f"__kc_{n}")["v"])).alias(n)
        for n in within
    ]
    return rows.join(carry.hint("merge"), part).select(*df.columns, number.cast("long").alias(out), *kept)


def span_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tie: Sequence[str],
    chunk: Column,
    is_break: Callable[[Column, Column], Column],
    out: str = "island_start",
) -> DataFrame:
    """Islands of spans: a row opens one when ``is_break(start, latest end of all earlier rows)``.

    ``is_break`` must not turn true when the latest end grows. The island is named by the start of
    its first row, so no numbering is needed: inside a chunk it is the last local break that also
    beats the carried end, and before that the last break of the chunks before.
    """
    part = [*keys, CHUNK]
    local = Window.partitionBy(*part).orderBy(start, *tie)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        df.withColumn(CHUNK, chunk)
        .withColumn("__seen", F.max(end).over(before))
        .withColumn("__hit", F.when(F.coalesce(is_break(F.col(start), F.col("__seen")), F.lit(True)), F.col(start)))
        .withColumn("__at", F.max("__hit").over(upto))
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*part).agg(F.max(end).alias("__end"), F.max("__hit").alias("__last"))
        .withColumn("__cend", F.max("__end").over(across))
        .withColumn("__real", F.when(F.coalesce(is_break(F.col("__last"), F.col("__cend")), F.lit(True)), F.col("__last")))
        .withColumn("__cat", F.max("__real").over(across))
        .select(*part, "__cend", "__cat")
    )
    opened = F.coalesce(is_break(F.col("__at"), F.col("__cend")), F.lit(True))
    return rows.join(carry.hint("merge"), part).select(
        *df.columns, F.when(opened, F.col("__at")).otherwise(F.col("__cat")).alias(out)
    )
