"""Smallest spanning forests and components of weighted edges.

Edges belong to a key (a session, a user) and never cross keys. Keys with few edges share a task, which solves them whole.
A key with more edges is cut into blocks: every block keeps only its own spanning forest, since an edge that closes a circle
of lighter edges in a block does so in the whole key too, and Borůvka rounds in DataFrames join what is left. So no task
holds more edges than a block, however many a key has.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.session import cut_lineage

#: Edges that one task solves at once.
BLOCK = 200_000


def merged(u: np.ndarray, v: np.ndarray, order: Iterable[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Union-find over ``u`` and ``v``: the positions in ``order`` that join two parts, all nodes, and the smallest node of each one's part."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up, used = at[: len(u)].tolist(), at[len(u) :].tolist(), list(range(len(nodes))), []
    for k in order:
        x, y = a[k], b[k]
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            used.append(k)
    root = np.array(up, np.int64)
    while (step := root[root] != root).any():
        root[step] = root[root[step]]
    return used, nodes, nodes[root] if len(nodes) else nodes


def _forest_of_block(table: pa.Table) -> pa.Table:
    u, v, w = (table[c].to_numpy() for c in ("u", "v", "w"))
    used, _, _ = merged(u, v, np.lexsort((np.maximum(u, v), np.minimum(u, v), w)).tolist())
    return table.take(pa.array(sorted(used), pa.int64()))


def _labels_of_block(table: pa.Table) -> pa.Table:
    u, v = table["u"].to_numpy(), table["v"].to_numpy()
    _, nodes, low = merged(u, v, range(len(u)))
    return pa.table([pa.array(nodes), pa.array(low)], ["node", "component"])


def _sized(edges: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``edges`` with __blocks, how many blocks the key needs, and __part, the task of a key that needs one."""
    counts = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    counts = counts.withColumn("__blocks", F.ceil(F.col("__n") / block)).withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(1 + total // block)))
    return edges.join(counts.drop("__n").hint("merge"), keys)


def _order() -> Column:
    return F.struct("w", "u", "v")


def spanning_forest(edges: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """The edges (keys, u, v, w) of a smallest spanning forest of every key; equal weights are ordered by their ends.

    Nodes are whole numbers, each of one key only; weights must not be null. Loops and repeated edges do not matter."""
    columns = [*keys, "u", "v", "w"]
    ordered = edges.where("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    e = cut_lineage(_sized(ordered, keys, block))
    schema = e.select(*columns).schema
    done = e.where("__blocks = 1").groupBy("__part").applyInArrow(lambda t: _forest_of_block(t.select(columns)), schema)
    large = e.where("__blocks > 1").withColumn("__salt", F.pmod(F.xxhash64("u", "v"), F.col("__blocks")))
    large = cut_lineage(large.groupBy(*keys, "__salt").applyInArrow(lambda t: _forest_of_block(t.select(columns)), schema))
    live = large.withColumns({"a": F.col("u"), "b": F.col("v")})
    while not live.isEmpty():
        ends = live.select("*", F.col("a").alias("n")).union(live.select("*", F.col("b").alias("n")))
        picked = ends.groupBy("n").agg(F.min_by(F.struct(*columns, "a", "b"), _order()).alias("x")).select("x.*").distinct()
        picked = cut_lineage(picked)
        done = done.union(picked.select(*columns))
        labels = components(picked.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys, block).drop(*keys)
        for end in ("a", "b"):
            live = live.join(labels.select(F.col("node").alias(end), F.col("component").alias("__c")).hint("merge"), end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
        live = live.where("a <> b")
        # of several edges between two parts only the lightest can be picked
        live = cut_lineage(live.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by(F.struct(*columns), _order()).alias("x")).select("x.*", "a", "b"))
    return done


def components(edges: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, node, component) for every node of the edges (keys, u, v); the component is its smallest node."""
    e = cut_lineage(_sized(edges.select(*keys, "u", "v").where("u <> v").distinct(), keys, block))
    done = e.where("__blocks = 1").groupBy("__part").applyInArrow(_labels_of_block, "node long, component long")
    large = e.where("__blocks > 1").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not large.isEmpty():
        done = done.union(_stars(cut_lineage(large)))
    key_of = e.select(F.col("u").alias("node"), *keys).union(e.select("v", *keys)).distinct()
    return key_of.join(done.hint("merge"), "node").select(*keys, "node", "component")


def _stars(e: DataFrame) -> DataFrame:
    """Large-star and small-star steps until every edge (u, v), u > v, points at the smallest node of its component."""
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
