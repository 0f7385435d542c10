"""The mean similarity of all pairs of segments of a cluster, without its pairs.

The similarity (H30) is a sum of parts, and each part can be summed over all pairs from counts: absolute differences from the counts of
smaller values, apps and title words from the counts of equal ones, and closeness in time from running sums over the segments that ended
in the last half hour. Long clusters are cut by value and by time, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions.sequence import scan_rows
from worklens.operators.tasks import SIMILARITY_WEIGHTS, app_family_similarity, jaccard, with_tokens
from worklens.session import cut_lineage

#: Minutes after which a segment is no longer close to the one before, and those that halve the closeness.
NEAR, HALF = 30, 10
MINUTE = 60_000_000


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def difference_sums(rows: DataFrame, keys: list[str], value: str, pieces: int = 64) -> DataFrame:
    """keys and total: the sum of |x - y| over all pairs of the non-null values of each key. Equal values are counted, then each
    counts with those below it; a key's values are scanned in ``pieces`` ranges of one unit."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = scan_rows(counted, keys, [value], F.floor(F.col(value) * pieces), run_sum={"__upto": F.col("__n")})
    n = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    # below less above: upto - n on one side, all - upto on the other
    each = F.col(value) * F.col("__n") * (2 * F.col("__upto") - F.col("__n") - F.col("__all"))
    return upto.join(n, keys).groupBy(*keys).agg(F.sum(each).alias("total"))


def closeness_sums(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and total: the sum over all pairs, in ``order`` (start_time first), of 1 for a later segment that starts before the earlier one's end,
    of a half for every HALF minutes up to NEAR between them, of 0 beyond.

    An earlier segment that ended before the later one's start is counted in the latter's block of NEAR minutes, as its end's power of two: the
    sum over the ends in reach, times the power of the start, is the sum of their closeness. A segment must not end before it starts."""
    width = NEAR * MINUTE
    rows = rows.select(*keys, *order, "end_time", F.unix_micros("start_time").alias("from"), F.unix_micros("end_time").alias("to"))
    # all earlier ones, less those that have ended
    place = scan_rows(rows, keys, order, F.to_date(order[0]), run_sum={"nth": F.lit(1)})
    ended = rows.select(*keys, F.col("to").alias("at"), F.lit(1).alias("ends"), F.lit(1).alias("kind"))
    began = rows.select(*keys, F.col("from").alias("at"), F.lit(0).alias("ends"), F.lit(0).alias("kind"))
    events = ended.union(began).groupBy(*keys, "at", "kind").agg(F.sum("ends").alias("ends"), F.count(F.lit(1)).alias("n"))
    before = scan_rows(events, keys, ["at", "kind"], F.expr("at div 86400000000"), run_sum={"done": F.col("ends")})
    open_ = place.groupBy(*keys).agg(F.sum(F.col("nth") - 1).alias("earlier")).join(before.where("kind = 0").groupBy(*keys).agg(F.sum(F.col("done") * F.col("n")).alias("done")), keys)
    # ends in [start - NEAR, start), by the block of the start; powers count from the start of the block before
    block = lambda c: F.floor(F.col(c) / width)
    power = lambda at, origin, sign: F.pow(F.lit(2.0), sign * (F.col(at) - F.col(origin)) / float(HALF * MINUTE))
    told = rows.select(*keys, "to", F.explode(F.array(block("to"), block("to") + 1)).alias("block")).withColumn("origin", (F.col("block") - 1) * width)
    told = told.select(*keys, "block", F.col("to").alias("at"), F.lit(1).alias("kind"), power("to", "origin", 1.0).alias("v"), F.lit(0.0).alias("times"))
    asked = rows.withColumn("block", block("from")).withColumn("origin", (F.col("block") - 1) * width)
    asked = asked.select(*keys, "block", "from", power("from", "origin", -1.0).alias("p")).select(*keys, "block", F.explode(F.array(
        F.struct((F.col("from") - width).alias("at"), F.lit(0).alias("kind"), (-F.col("p")).alias("times")),
        F.struct(F.col("from").alias("at"), F.lit(0).alias("kind"), F.col("p").alias("times")))).alias("e")).select(*keys, "block", "e.at", "e.kind", F.lit(0.0).alias("v"), "e.times")
    order_ = Window.partitionBy(*keys, "block").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = told.union(asked).withColumn("upto", F.sum("v").over(order_)).groupBy(*keys).agg(F.sum(F.col("times") * F.col("upto")).alias("near"))
    return open_.join(near, keys).select(*keys, (F.col("earlier") - F.col("done") + F.col("near")).alias("total"))


def app_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and total: the app similarity over all pairs, from the counts of each app."""
    apps = cut_lineage(rows.groupBy(*keys, "primary_app").agg(F.count(F.lit(1)).alias("n")).where("primary_app IS NOT NULL"))
    same = apps.select(*keys, _pairs(F.col("n")).alias("s"))
    a, b = apps.toDF(*keys, "a", "an"), apps.toDF(*keys, "b", "bn")
    other = a.join(b, keys).where("a < b").select(*keys, (F.col("an") * F.col("bn") * app_family_similarity(F.col("a"), F.col("b"))).alias("s"))
    return same.union(other).groupBy(*keys).agg(F.sum("s").alias("total"))


def title_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and total: the overlap of title words over all pairs, from the counts of each set of words. Sets that share no word add
    nothing, so only sets that meet at a word are compared, at the first word they share."""
    sets = rows.withColumn("title_tokens", F.array_sort("title_tokens")).groupBy(*keys, "title_tokens").agg(F.count(F.lit(1)).alias("n"))
    sets = cut_lineage(sets)
    all_ = sets.groupBy(*keys).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.size("title_tokens") < 1, F.col("n"))), F.lit(0)).alias("bare"))
    bare = all_.select(*keys, (0.5 * (_pairs(F.col("bare")) + F.col("bare") * (F.col("all") - F.col("bare")))).alias("s"))
    worded = sets.where(F.size("title_tokens") > 0)
    same = worded.select(*keys, _pairs(F.col("n")).alias("s"))
    words = worded.select(*keys, F.explode("title_tokens").alias("word"), "title_tokens", "n")
    a, b = words.toDF(*keys, "word", "a", "an"), words.toDF(*keys, "word", "b", "bn")
    met = a.join(b, [*keys, "word"]).where((F.col("a") < F.col("b")) & (F.col("word") == F.array_min(F.array_intersect("a", "b"))))
    met = met.select(*keys, (F.col("an") * F.col("bn") * jaccard(F.col("a"), F.col("b"))).alias("s"))
    return bare.union(same).union(met).groupBy(*keys).agg(F.sum("s").alias("total"))


def mean_similarity(clustered: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """keys, segments and mean_similarity (1 for a single segment) of every cluster of ``clustered`` segments, pairs taken in ``order``."""
    order = order or ["start_time", "segment_no"]
    cap = lambda c, most: F.least(F.col(c).cast("double"), F.lit(most)) / most
    measures = {
        "kb": cap("keyboard_intensity_avg", 100.0), "mouse": cap("mouse_intensity_avg", 20.0),
        "paste": F.least((F.col("total_copy_events") + F.col("total_paste_events")).cast("double"), F.lit(50.0)) / 50.0,
        "mic": F.col("mic_active_ratio"), "camera": F.col("camera_active_ratio"), "volume": F.col("max_audio_volume"),
        "cpu": F.col("mean_cpu_usage"), "ram": F.col("mean_ram_usage"), "gpu": F.col("mean_gpu_usage"),
        "gpu_cpu": F.when(F.col("mean_gpu_usage").isNotNull(), F.col("mean_cpu_usage")), "gpu_ram": F.when(F.col("mean_gpu_usage").isNotNull(), F.col("mean_ram_usage")),
        "tasks": F.col("multitasking_score"), "activity": F.col("activity_score"), "work": F.col("is_active_work").cast("double"),
    }
    rows = cut_lineage(with_tokens(clustered).select(*keys, *order, "end_time", "primary_app", "title_tokens", *[c.cast("double").alias(n) for n, c in measures.items()]))
    long = rows.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in measures]), F.array(*[F.col(n) for n in measures]))).alias("measure", "x"))
    apart = difference_sums(long, [*keys, "measure"], "x").groupBy(*keys).pivot("measure", list(measures)).agg(F.first("total"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments")).join(apart, keys, "left")
    for name, sums in (("app", app_sums), ("window", title_sums)):
        out = out.join(sums(rows, keys).withColumnRenamed("total", f"{name}_sum"), keys, "left")
    out = out.join(closeness_sums(rows, keys, order).withColumnRenamed("total", "temporal_sum"), keys, "left").fillna(0.0)
    n = _pairs(F.col("segments"))
    sums = {
        "app": F.col("app_sum"), "window": F.col("window_sum"), "temporal": F.col("temporal_sum"),
        "interaction": n - (F.col("kb") + F.col("mouse") + F.col("paste")) / 3.0,
        "audio_video": n - F.col("mic") * 0.4 - F.col("camera") * 0.4 - F.col("volume") * 0.2,
        # pairs with both values have a third part; the others two
        "system": n - (F.col("gpu_cpu") + F.col("gpu_ram") + F.col("gpu")) / 3.0 - (F.col("cpu") - F.col("gpu_cpu") + F.col("ram") - F.col("gpu_ram")) / 2.0,
        "behavioral": n - (F.col("tasks") + F.col("activity") + F.col("work") * 0.7) / 3.0,
    }
    total = F.lit(0.0)
    for name, value in sums.items():
        total = total + value * F.lit(SIMILARITY_WEIGHTS[name])
    return out.select(*keys, "segments", F.when(F.col("segments") < 2, 1.0).otherwise(total / n).alias("mean_similarity")).withColumn("segments", F.col("segments").cast("long"))
