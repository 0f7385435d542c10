"""Session vectors, centroids, nearest tasks and live predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.sequence import day_chunk, scan_rows
from worklens.session import cut_lineage

DIMENSIONS = 8
MATCH_DISTANCE = 0.35


def session_vectors(sessions: DataFrame) -> DataFrame:
    """Eight values in [0, 1]. ``sessions`` has entropy, focus_continuity, max_sustained, avg_focus,
    consistency, n_apps, minutes, input_per_minute."""
    cap = lambda c: F.least(c, F.lit(1.0))
    parts = [
        cap(F.col("entropy")), cap(F.col("focus_continuity")), cap(F.col("max_sustained") / 300.0), cap(F.col("avg_focus") / 120.0), cap(F.col("consistency")),
        cap(F.col("n_apps") / 20.0), cap(F.col("minutes") / 480.0), cap(F.col("input_per_minute") / 8.0),
    ]
    return sessions.withColumn("vector", F.array(*[p.cast("double") for p in parts]))


def distance(a: Column, b: Column, dimensions: int = DIMENSIONS) -> Column:
    """Root of the mean squared difference, at most 1."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.least(F.sqrt(squares / float(dimensions)), F.lit(1.0))


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Mean vector and member count per key. Members are summed position by position in partial
    aggregates, no member list is built."""
    spread = rows.select(*keys, F.posexplode(vector).alias("i", "v"))
    mean = spread.groupBy(*keys, "i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("members"))
    return mean.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"), F.max("members").alias("members"))


def nearest_tasks(rows: DataFrame, centres: DataFrame, keys: list[str], name: str, k: int = 1, vector: str = "vector", dimensions: int = DIMENSIONS) -> DataFrame:
    """The ``k`` nearest centroids of the row's own key as a sorted array of (distance, name,
    members). A key's centroids are one short array (its tasks), joined on the key: the candidates are
    compared inside the row and never become rows."""
    packed = centres.groupBy(*keys).agg(F.collect_list(F.struct(F.col(name).alias("name"), "centroid", "members")).alias("__c"))
    scored = F.transform("__c", lambda c: F.struct(distance(F.col(vector), c["centroid"], dimensions).alias("distance"), c["name"].alias("name"), c["members"].alias("members")))
    return rows.join(packed, keys).withColumn("nearest", F.slice(F.array_sort(scored), 1, k)).drop("__c")


def balls_of(centres: DataFrame, name: str, balls: int, block: int, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Every centroid in the ball of its nearest pivot (name, centroid, members, ball, part), and one row with the balls: number, pivot,
    radius, centroids and parts of about ``block``. Pivots are ``balls`` centroids in the order of a hash, so the second row has a fixed size."""
    pivots = centres.select("centroid", F.xxhash64(name).alias("h"), F.col(name).alias("n")).orderBy("h", "n").limit(balls)
    listed = pivots.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "n", "centroid"))), lambda p: p["centroid"]).alias("__pivots"))
    far = lambda c, p: _apart(c, p, dimensions)
    placed = centres.join(F.broadcast(listed)).withColumn("__at", F.array_min(F.transform("__pivots", lambda p, i: F.struct(far(F.col("centroid"), p).alias("d"), i.alias("i")))))
    placed = cut_lineage(placed.select(F.col(name).alias("name"), "centroid", "members", F.col("__at.i").alias("ball"), F.col("__at.d").alias("d"), F.col("__pivots")[F.col("__at.i")].alias("pivot")))
    each = placed.groupBy("ball").agg(F.first("pivot").alias("pivot"), F.max("d").alias("radius"), F.count(F.lit(1)).alias("n"))
    top = each.agg(F.collect_list(F.struct("ball", "pivot", "radius", "n", F.ceil(F.col("n") / block).cast("int").alias("parts"))).alias("__balls"))
    parts = each.select("ball", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    return placed.join(parts, "ball").select("name", "centroid", "members", "ball", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part")), top


def _apart(a: Column, b: Column, dimensions: int) -> Column:
    """The distance without its cap, for which the triangle inequality holds."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / float(dimensions))


def reachable_balls(balls: Column, vector: Column, k: int, dimensions: int) -> Column:
    """The balls that may hold one of the ``k`` nearest centroids of ``vector``. Each pivot is a centroid, so the k-th nearest pivot bounds the k-th distance, and
    so does the far end of the balls that hold ``k``; balls whose near end is beyond it are left out. At a bound of 1 or more capped distances tie, and
    none is."""
    seen = F.transform(balls, lambda b: F.struct(_apart(vector, b["pivot"], dimensions).alias("d"), b["radius"].alias("radius"), b["n"].alias("n"), b["ball"].alias("ball"), b["parts"].alias("parts")))
    far = F.array_sort(F.transform(seen, lambda b: F.struct((b["d"] + b["radius"]).alias("far"), b["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("bound"))
    step = lambda s, b: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + b["n"]).alias("n"), b["far"].alias("bound")))
    held = F.aggregate(far, start, step, lambda s: s["bound"])
    pivots = F.get(F.array_sort(F.transform(seen, lambda b: b["d"])), F.lit(k - 1))
    bound = F.least(held, pivots)  # least leaves a null out
    return F.filter(seen, lambda b: (b["d"] - b["radius"] <= bound + 1e-9) | (bound >= 1.0 - 1e-9))


def nearest_in_space(rows: DataFrame, centres: DataFrame, row_id: str, name: str, k: int = 1, vector: str = "vector", dimensions: int = DIMENSIONS, block: int = 1024, most_balls: int = 1024) -> DataFrame:
    """C12 / C14 without a key: the ``k`` nearest of all centroids for every row.

    The centroids are counted first. Up to ``block`` of them are one short array that is broadcast; above that they are put into balls, at most
    ``most_balls``, which are broadcast instead: every row meets only the balls that may hold its nearest (``reachable_balls``), in parts of about
    ``block``, keeps its ``k`` best of each, and the bests are merged per row.
    """
    n = centres.count()
    scored = F.transform("__c", lambda c: F.struct(distance(F.col(vector), c["centroid"], dimensions).alias("distance"), c["name"].alias("name"), c["members"].alias("members")))
    best = F.slice(F.array_sort(scored), 1, k)
    if n <= block:
        packed = centres.groupBy(F.lit(0).alias("__b")).agg(F.collect_list(F.struct(F.col(name).alias("name"), "centroid", "members")).alias("__c"))
        return rows.withColumn("__b", F.lit(0)).join(F.broadcast(packed), "__b").withColumn("nearest", best).drop("__b", "__c")
    placed, top = balls_of(centres, name, min(most_balls, max(2, 4 * n // block)), block, dimensions)
    packed = placed.groupBy("ball", "part").agg(F.collect_list(F.struct("name", "centroid", "members")).alias("__c"))
    met = rows.select(row_id, vector).join(F.broadcast(top)).select(row_id, vector, F.explode(reachable_balls(F.col("__balls"), F.col(vector), k, dimensions)).alias("__r"))
    met = met.select(row_id, vector, F.col("__r.ball").alias("ball"), F.explode(F.sequence(F.lit(0), F.col("__r.parts") - 1)).alias("part"))
    per_row = met.join(packed, ["ball", "part"]).select(row_id, F.explode(best).alias("n")).groupBy(row_id).agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("nearest"))
    return rows.join(per_row, row_id)


def match_confidence(d: Column) -> Column:
    return 1.0 - F.least(d / MATCH_DISTANCE, F.lit(1.0))


def live_predictions(rows: DataFrame) -> DataFrame:
    """Prediction out of ``nearest`` (best first): distance share plus a bonus for many members,
    kept when it reaches the threshold for its own size. Adds the next best tasks as text."""
    best = F.col("nearest")[0]
    bonus = F.when(best["members"] >= 1, F.least(0.15 * F.log(best["members"] + 1.0), F.lit(0.25))).otherwise(0.0)
    confidence = F.least(match_confidence(best["distance"]) + bonus, F.lit(1.0))
    need = F.when(F.col("confidence") < 0.5, 0.45).when(F.col("confidence") >= 0.8, 0.65).otherwise(0.50)
    others = F.transform(F.slice("nearest", 2, 2), lambda n: n["name"])
    return (
        rows.withColumns({"task": best["name"], "distance": best["distance"], "confidence": confidence, "alternatives": F.array_join(others, ",")})
        .filter(F.col("confidence") >= need).drop("nearest")
    )


def smoothed(predictions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """At every prediction the most confident of the last three of the key, the earliest of equals. Two
    chunked scans, so a key with very many predictions is not one task."""
    chunk = day_chunk(order[0])
    one = scan_rows(predictions, keys, order, chunk, lag={"__1": F.struct("task", "confidence")})
    two = scan_rows(one, keys, order, chunk, lag={"__2": F.col("__1")})
    older = F.when(F.col("__2.confidence") >= F.col("__1.confidence"), F.col("__2")).otherwise(F.col("__1"))
    best = F.when(older["confidence"] >= F.col("confidence"), older).otherwise(F.struct("task", "confidence"))
    return two.withColumn("best", best).select(*predictions.columns, F.col("best.task").alias("smoothed_task"), F.col("best.confidence").alias("smoothed_confidence"))


def feature_variances(rows: DataFrame, vector: str, top_n: int = 20) -> DataFrame:
    """Positions by population variance."""
    spread = rows.select(F.posexplode(vector).alias("position", "v"))
    stats = spread.groupBy("position").agg(F.var_pop("v").alias("variance"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return stats.orderBy(F.desc("variance"), "position").limit(top_n)


def feature_matrix_stats(rows: DataFrame, vector: str) -> DataFrame:
    """Moments and share of zeros over all values."""
    return rows.select(F.explode(vector).alias("v")).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0)).alias("sparsity"), F.count(F.lit(1)).alias("values"))


def normalized_metadata(df: DataFrame) -> DataFrame:
    """Fractions become percent, everything is clamped to [0, 1], lists are cleaned and cut at ten."""
    def share(c: str) -> Column:
        percent = F.when(F.col(c) <= 1.0, F.col(c) * 100.0).otherwise(F.col(c))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100.0))

    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    minutes = F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(1.0)
    return df.withColumns({
        "cpu_normalized": share("avg_cpu"), "ram_normalized": share("avg_ram"), "gpu_normalized": share("avg_gpu"),
        "input_intensity_normalized": clamp((F.col("keys") + F.col("clicks")) / minutes / 8.0), "signal_quality": clamp(F.col("event_count") / 300.0),
        "top_apps": F.transform(F.slice("apps", 1, 10), lambda a: F.lower(F.trim(a)))})


def unstable_tasks(tasks: DataFrame) -> DataFrame:
    """Centroids that drift, worst first."""
    rows = tasks.filter((F.col("drift") > 0.15) | (F.col("drift_cumulative") > 1.0) | (F.col("feature_drift_avg") > 0.08))
    return rows.withColumn("severity", F.when(F.col("drift") > 0.35, "critical").otherwise("high")).orderBy(F.desc("drift"))
