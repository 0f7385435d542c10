"""Density clustering of all segments of a user by similarity (H30), without their pairs.

Two segments are linked when 1 - similarity is at most ``eps``; with one neighbour being enough, clusters are the components of the links.

* Segments at most NEAR minutes apart are compared as such: in time blocks, so their number follows the time.
* Segments further apart have no closeness in time. What is left for the measures (input, audio, load, behaviour) then depends on apps and title
  words alone: the *budget* of two classes (app, set of words). Classes are compared only when they share a word, or one has none, and
  apps are the same or of one family; others have no budget.
* The measures differ by a weighted L1 distance. Segments of a class are put into cells of a grid no wider than the class's own budget:
  each cell is a chain of links already, and equal segments are in one. Cells, not segments, are then compared, in squares of blocks: two cells whose first members
  are within the budget are linked, and a square gives only a spanning forest of its links. Cells that may still have linked
  members, by their boxes, and are not in one component yet are opened, and the nearest two members decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.functions import rules, text
from worklens.functions.graph import components, merged
from worklens.functions.ranges import overlap_join
from worklens.operators.tasks import SIMILARITY_COLUMNS, SIMILARITY_WEIGHTS, app_family_similarity, jaccard, similarity, total_similarity, with_tokens
from worklens.session import cut_lineage

NEAR = 30
#: Cells on a side of a square, and members on a side of an opened pair of cells.
SIDE = 1024
#: Pairs of cells that are compared at once, and squares that share a group of a task.
PAIRS, SHARED = 1 << 18, 1 << 14
#: What rounding may add to a distance; anything closer to a bound than this is decided by the similarity itself.
SLACK = 1e-9


_I, _A, _S, _B = SIMILARITY_WEIGHTS["interaction"] / 3, SIMILARITY_WEIGHTS["audio_video"], SIMILARITY_WEIGHTS["system"], SIMILARITY_WEIGHTS["behavioral"] / 3
#: The weight of each measure in the distance of two segments with gpu values, and of two others.
WEIGHTS = {
    "kb": (_I, _I), "mouse": (_I, _I), "paste": (_I, _I), "mic": (_A * 0.4, _A * 0.4), "camera": (_A * 0.4, _A * 0.4), "volume": (_A * 0.2, _A * 0.2),
    "cpu": (_S / 3, _S / 2), "ram": (_S / 3, _S / 2), "gpu": (_S / 3, 0.0), "tasks": (_B, _B), "activity": (_B, _B), "work": (_B * 0.7, _B * 0.7),
}


def measures() -> list[Column]:
    """The measures in the order of WEIGHTS."""
    cap = lambda c, most: F.least(F.col(c).cast("double"), F.lit(most)) / most
    paste = F.least((F.col("total_copy_events") + F.col("total_paste_events")).cast("double"), F.lit(50.0)) / 50.0
    plain = ["mic_active_ratio", "camera_active_ratio", "max_audio_volume", "mean_cpu_usage", "mean_ram_usage"]
    return [
        cap("keyboard_intensity_avg", 100.0), cap("mouse_intensity_avg", 20.0), paste, *[F.col(c) for c in plain], F.coalesce("mean_gpu_usage", F.lit(0.0)),
        F.col("multitasking_score"), F.col("activity_score"), F.col("is_active_work").cast("double"),
    ]


def linked(pairs: DataFrame, eps: float) -> Column:
    """Whether p, the earlier, and c are linked, by the similarity itself."""
    parts = similarity(lambda n: F.col("p")[n], lambda n: F.col("c")[n])
    return 1.0 - total_similarity(parts) <= eps


def near_links(rows: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """(keys, u, v) of linked segments at most NEAR minutes apart, overlapping ones too."""
    span = rows.select(*keys, "node", F.struct("node", *SIMILARITY_COLUMNS).alias("s"), F.col("start_time").alias("a"), F.timestamp_micros(F.unix_micros(F.greatest("start_time", "end_time")) + NEAR * 60_000_000).alias("z"))
    p, c = span.toDF(*keys, "u", "p", "p0", "p1"), span.toDF(*keys, "v", "c", "c0", "c1")
    both = overlap_join(p, c, keys, ("p0", "p1"), ("c0", "c1"), closed=True).where("p0 < c0 OR (p0 = c0 AND u < v)")
    return both.where(linked(both, eps)).select(*keys, "u", "v")


def budgets(classes: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """(keys, a, b, budget) for every two classes, a <= b, that have one: what their measures may differ at most."""
    w = SIMILARITY_WEIGHTS
    left = eps - w["temporal"]
    family = F.array_compact(F.array(F.concat(F.lit("="), "app"), *[F.when(text.contains_any(F.lower("app"), parts), F.lit(f"{k}")) for k, (parts, _) in enumerate(rules.SIMILARITY_FAMILIES)]))
    c = classes.select(*keys, "class", "app", "words", F.explode(family).alias("family"))
    side = lambda df, x: df.select(*keys, "family", *(["word"] if "word" in df.columns else []), F.col("class").alias(x), F.struct("app", "words").alias(f"_{x}"))
    if left > w["window"] + SLACK:
        both = side(c, "a").join(side(c, "b").hint("merge"), [*keys, "family"])
    else:  # without a word in common nothing is left, but for titles without words, which count as half alike
        words = c.withColumn("word", F.explode("words"))
        both = side(words, "a").join(side(words, "b").hint("merge"), [*keys, "family", "word"]).drop("word")
        both = both.union(side(c.where(F.size("words") < 1), "a").join(side(c, "b").hint("merge"), [*keys, "family"]))
    both = both.select(*keys, F.least(F.struct("a", "_a"), F.struct(F.col("b").alias("a"), F.col("_b").alias("_a"))).alias("x"), F.greatest(F.struct("a", "_a"), F.struct(F.col("b").alias("a"), F.col("_b").alias("_a"))).alias("y"))
    both = both.select(*keys, F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x._a").alias("p"), F.col("y._a").alias("q")).dropDuplicates([*keys, "a", "b"])
    cost = w["window"] * (1 - jaccard(F.col("p.words"), F.col("q.words"))) + w["app"] * (1 - app_family_similarity(F.col("p.app"), F.col("q.app")))
    return both.select(*keys, "a", "b", (F.lit(left) - cost).alias("budget")).where(F.col("budget") > SLACK)


def _pairs(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of the rows of ``left`` and ``right`` that share a square, every one with every other, and the square's number, in
    order: whole squares, as many at once as have about PAIRS pairs, since most squares are small."""
    codes, names = pd.factorize(pd.concat([left["square"], right["square"]]))
    a, b = codes[: len(left)], codes[len(left) :]
    row_a, row_b = a.argsort(kind="stable"), b.argsort(kind="stable")
    n_a, n_b = np.bincount(a, minlength=len(names)), np.bincount(b, minlength=len(names))
    from_a, from_b, n = n_a.cumsum() - n_a, n_b.cumsum() - n_b, n_a * n_b
    run = (n.cumsum() - n) // PAIRS
    for squares in np.split(np.arange(len(names)), np.flatnonzero(np.diff(run)) + 1):
        square = np.repeat(squares, n[squares])
        at = np.arange(len(square)) - np.repeat(n[squares].cumsum() - n[squares], n[squares])
        if len(square):
            yield row_a[from_a[square] + at // n_b[square]], row_b[from_b[square] + at % n_b[square]], square


def _distances(x: pd.DataFrame, y: pd.DataFrame, low: str = "at", high: str = "at") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of ``_pairs`` with the weighted L1 distance of the two rows, or of their boxes: nothing where ranges of a measure overlap."""
    if not len(x) or not len(y):
        return
    a0, a1, b0, b1 = (np.stack(df[c].to_numpy()).T.copy() for df, c in ((x, low), (x, high), (y, low), (y, high)))
    gpu_x, gpu_y = x["gpu"].to_numpy(), y["gpu"].to_numpy()
    for i, j, square in _pairs(x, y):
        both, out = gpu_x[i] & gpu_y[j], np.zeros(len(i))
        for k, (full, bare) in enumerate(WEIGHTS.values()):
            apart = np.maximum(np.maximum(b0[k][j] - a1[k][i], a0[k][i] - b1[k][j]), 0.0)
            out += apart * np.where(both, full, bare)
        yield i, j, square, out


def _forest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the sure links of the squares: first members within the budget."""
    out, budget = [], left["budget"].to_numpy()
    for i, j, _, d in _distances(left, right):
        near = d <= budget[i] - SLACK
        u, v = left["node"].to_numpy()[i[near]], right["node"].to_numpy()[j[near]]
        used, _, _ = merged(u, v, np.flatnonzero(u != v).tolist())
        out.append(pd.DataFrame({"u": u[used], "v": v[used]}))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype=np.int64)


def _open(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Cells of different components whose boxes are within the budget."""
    out, budget, x, y = [], left["budget"].to_numpy(), left["component"].to_numpy(), right["component"].to_numpy()
    for i, j, _, d in _distances(left, right, "low", "high"):
        near = (x[i] != y[j]) & (d <= budget[i] + SLACK)
        out.append(pd.DataFrame({"u": left["node"].to_numpy()[i[near]], "v": right["node"].to_numpy()[j[near]]}))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype=np.int64)


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The nearest two members of each opened pair of cells."""
    out = []
    for i, j, square, d in _distances(left, right):
        order = np.lexsort((d, square))
        best = order[np.r_[True, np.diff(square[order]) > 0]]
        ends = left["square"].iloc[i[best]].str.split(" ", expand=True)
        out.append(pd.DataFrame({"x": ends[0].to_numpy(), "y": ends[1].to_numpy(), "u": left["node"].to_numpy()[i[best]], "v": right["node"].to_numpy()[j[best]], "d": d[best]}))
    out = pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "u": [], "v": [], "d": []})
    return out.astype({"x": np.int64, "y": np.int64, "u": np.int64, "v": np.int64, "d": np.float64})


def _meet(squares: DataFrame, left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over both sides of every square; small squares share a task, SHARED of them at most on the average."""
    right = right.toDF(*right.columns)  # columns of its own, for the cogroup
    n = F.pmod(F.xxhash64("square"), F.lit(max(8, left.sparkSession.sparkContext.defaultParallelism * 4, squares.count() // SHARED)))
    return left.withColumn("task", n).groupBy("task").cogroup(right.withColumn("task", n).groupBy("task")).applyInPandas(lambda x, y: fn(x, y), schema)


def far_links(rows: DataFrame, keys: list[str], eps: float, side: int = SIDE) -> DataFrame:
    """(keys, u, v): links by which segments of any distance in time hang together. ``rows`` has node, class, app, words."""
    named = measures()
    least = SIMILARITY_WEIGHTS["window"] / 2
    own = F.lit(eps - SIMILARITY_WEIGHTS["temporal"]) - F.when(F.size("words") < 1, least).otherwise(0.0)
    # no cell is wider than its class's budget, whichever of the two distances holds
    step = own * 0.999 / len(named)
    cell = F.when(own > SLACK, F.md5(F.concat_ws(",", F.col("mean_gpu_usage").isNotNull().cast("string"), *[F.floor(c * max(ab) / step).cast("string") for c, ab in zip(named, WEIGHTS.values(), strict=True)]))).otherwise(F.col("node").cast("string"))
    at = F.array(*[c.cast("double") for c in named])
    points = cut_lineage(rows.where("app IS NOT NULL").select(*keys, "node", "class", cell.alias("cell"), F.col("mean_gpu_usage").isNotNull().alias("gpu"), at.alias("at"), *SIMILARITY_COLUMNS))
    bound = lambda f: F.array(*[f(F.col("at")[k]) for k in range(len(named))])
    cells = points.groupBy(*keys, "class", "cell").agg(F.min("node").alias("first"), F.first("gpu").alias("gpu"), F.min_by("at", "node").alias("at"), bound(F.min).alias("low"), bound(F.max).alias("high"))
    cells = cut_lineage(cells.withColumnRenamed("first", "node"))
    members = points.select(*keys, F.col("node").alias("v"), "class", "cell").join(cells.select(*keys, "class", "cell", F.col("node").alias("u")).hint("merge"), [*keys, "class", "cell"])
    chains = members.where("u <> v").select(*keys, "u", "v")

    sizes = cells.groupBy(*keys, "class").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("blocks"))
    pairs = budgets(rows.where("app IS NOT NULL").groupBy(*keys, "class").agg(F.first("app").alias("app"), F.first("words").alias("words")), keys, eps)
    pairs = pairs.join(sizes.toDF(*keys, "a", "a_blocks").hint("merge"), [*keys, "a"]).join(sizes.toDF(*keys, "b", "b_blocks").hint("merge"), [*keys, "b"])
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    pairs = cut_lineage(pairs.where("a < b OR i <= j").withColumn("square", F.monotonically_increasing_id()))
    blocks = sizes.join(cells.hint("merge"), [*keys, "class"]).withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int"))

    def sides(cells: DataFrame, columns: list[str]) -> list[DataFrame]:
        return [pairs.select(*keys, F.col(c).alias("class"), F.col(b).alias("block"), "square", "budget").join(cells.hint("merge"), [*keys, "class", "block"]).select("square", "budget", "node", "gpu", *columns) for c, b in (("a", "i"), ("b", "j"))]

    sure = _meet(pairs, *sides(blocks, ["at"]), _forest, "u long, v long").where("u <> v")
    owner = cut_lineage(points.select("node", *keys))
    sure = cut_lineage(owner.withColumnRenamed("node", "u").join(sure.hint("merge"), "u").select(*keys, "u", "v").union(chains))
    label = components(sure, keys).select("node", "component")
    labelled = cut_lineage(blocks.join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    opened = cut_lineage(_meet(pairs, *sides(labelled, ["low", "high", "component"]), _open, "u long, v long").distinct())
    # members of opened cells, in blocks again; one candidate for each pair of cells
    held = members.select(F.col("u").alias("first"), F.col("v").alias("node")).join(points.select("node", "gpu", "at").hint("merge"), "node")
    parts = held.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("blocks"))
    held = held.join(parts.hint("merge"), "first").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asked = opened.join(parts.toDF("u", "n").hint("merge"), "u").join(parts.toDF("v", "m").hint("merge"), "v").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    asked = cut_lineage(asked.withColumn("square", F.concat_ws(" ", "u", "v", "i", "j")))
    ends = [asked.select(F.col(c).alias("first"), F.col(b).alias("block"), "square").join(held.hint("merge"), ["first", "block"]).select("square", "node", "gpu", "at") for c, b in (("u", "i"), ("v", "j"))]
    nearest = _meet(asked, *ends, _nearest, "x long, y long, u long, v long, d double").groupBy("x", "y").agg(F.min_by(F.struct("u", "v"), "d").alias("e")).select("e.u", "e.v")
    s = points.select("node", F.struct("node", *SIMILARITY_COLUMNS).alias("s"), *keys)
    both = nearest.join(s.toDF("u", "x", *keys).hint("merge"), "u").join(s.select("node", "s").toDF("v", "y").hint("merge"), "v")
    first = F.struct(F.col("x.start_time"), "u") <= F.struct(F.col("y.start_time"), F.col("v").alias("u"))
    both = both.select(*keys, "u", "v", F.when(first, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("c"))
    return sure.union(both.where(linked(both, eps)).select(*keys, "u", "v"))


def cluster_all(segments: DataFrame, keys: list[str], eps: float = 0.3, side: int = SIDE) -> DataFrame:
    """``segments`` (segment_no and the columns of the similarity) with cluster: numbered from 0 by the first segment in each ``keys``. ``eps`` must be below
    .4: from there on apps without a family have a budget too, and all classes of a user would meet."""
    if eps >= SIMILARITY_WEIGHTS["temporal"] + SIMILARITY_WEIGHTS["app"]:
        raise ValueError("eps must be below 0.4")
    segments = segments.drop("cluster")
    rows = with_tokens(segments).withColumns({"node": F.monotonically_increasing_id(), "app": F.col("primary_app"), "words": F.array_sort("title_tokens")})
    rows = cut_lineage(rows.withColumn("class", F.md5(F.concat_ws("\x1f", "app", F.array_join("words", "\x1e")))))
    links = near_links(rows, keys, eps)
    if eps > SIMILARITY_WEIGHTS["temporal"] + SLACK:
        links = links.union(far_links(rows, keys, eps, side))
    label = components(links, keys).select("node", "component")
    rows = rows.join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = rows.groupBy(*keys, "component").agg(F.min(F.struct("start_time", "segment_no")).alias("first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    first = first.withColumn("cluster", number.cast("long")).drop("first")
    return rows.join(first.hint("merge"), [*keys, "component"]).select(*segments.columns, "cluster")
