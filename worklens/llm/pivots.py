"""Embedding near-dedup over a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest pivots in order. Its postings are the sets of ``SHARED`` of them, so two
vectors meet in a list exactly when they share that many pivots; the pair is verified in double precision in the
list of its smallest shared pivots alone. Equal vectors are one class with a count.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import connected_components, written

MIN_COSINE = 0.9
PIVOTS = 128
NEAREST = 8
SHARED = 4
#: Cosine between pivots taken from the sample, at most.
APART = 0.5
#: Vectors that the pivots are chosen from, a bounded sample in the order of a hash.
SAMPLE = 1024
#: Vectors of one posting list that are compared in one task; longer lists are cut into blocks, and blocks meet in pairs.
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """``n`` reference points: the sample's, farthest first, as long as one is left with a cosine below ``APART`` to all chosen;
    random directions for the rest. Pivots inside one dense group would tell its own vectors apart."""
    extra = unit(np.random.default_rng(7).normal(size=(n, sample.shape[1])))
    if not len(sample):
        return extra
    pool = unit(sample)
    chosen, near = [0], pool @ pool[0]
    while len(chosen) < n and near.min() < APART:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, pool @ pool[chosen[-1]])
    return np.concatenate([pool[chosen], extra[: n - len(chosen)]])


def postings(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its keys (rows, keys) and for each key the bits of its other near pivots below the key's largest."""
    order = np.argsort(-(unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :nearest]
    near = np.sort(order, axis=1).astype(np.int64)
    sets = np.array(list(combinations(range(near.shape[1]), shared)))
    key = np.zeros((len(near), len(sets)), np.int64)
    for c in range(shared):
        key = key << 8 | near[:, sets[:, c]]
    words = np.zeros((len(near), len(sets), 2), np.uint64)
    for k, s in enumerate(sets):
        for c in range(s[-1]):
            if c not in s:
                p = near[:, c]
                np.bitwise_or.at(words, (np.arange(len(near)), k, p // 64), np.uint64(1) << (p % 64).astype(np.uint64))
    return key, words.view(np.int64)


def verify(vectors: np.ndarray, words: np.ndarray, copies: np.ndarray, side: np.ndarray | None, least: float = MIN_COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Copies linked to each row, and the row that stands for its linked group here. ``side``: only pairs of two sides."""
    ok = unit(vectors)
    ok = ok @ ok.T >= least
    np.fill_diagonal(ok, False)
    if side is not None:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(ok)
    own = ((words[i] & words[j]) == 0).all(axis=1)  # else the pair meets in a list of smaller pivots
    i, j = i[own], j[own]
    linked = np.bincount(i, copies[j], minlength=len(vectors)).astype(np.int64)
    root = np.arange(len(vectors))
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return linked, root


def _matrix(column: pa.Array, size: int, double: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64 if double else np.float32).reshape(-1, size)


def links(classes: DataFrame, double: bool, least: float = MIN_COSINE) -> DataFrame:
    """(rid, linked, root) from ``classes`` (rid, copies, size, data): found links of a class and a class it is reached from."""
    sample = classes.select("size", "data", "rid").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).toArrow()
    sizes = sorted({*sample["size"].to_pylist()})
    pivots = {s: choose_pivots(_matrix(sample.filter(pc.equal(sample["size"], s))["data"], s, double)) for s in sizes}

    def post(batches):
        for b in batches:
            size = b.column("size").to_numpy()
            for s in np.unique(size):
                own = b.filter(pa.array(size == s))
                at = pivots.get(int(s))
                at = choose_pivots(np.zeros((0, int(s)))) if at is None else at
                key, words = postings(_matrix(own.column("data"), int(s), double), at)
                rid = np.repeat(own.column("rid").to_numpy(), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), s, np.int32)), *map(pa.array, (key.ravel(), rid, words[..., 0].ravel(), words[..., 1].ravel()))], ["size", "key", "rid", "w0", "w1"])

    posts = written(classes.select("rid", "size", "data").mapInArrow(post, "size int, key long, rid long, w0 long, w1 long"))
    # a list whose vectors all share a smaller pivot has no pair of its own
    lists = posts.groupBy("size", "key").agg(F.count("*").alias("held"), F.bit_and("w0").alias("a0"), F.bit_and("w1").alias("a1"))
    lists = lists.where("held > 1 AND a0 = 0 AND a1 = 0").select("size", "key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    work = posts.join(lists, ["size", "key"]).join(classes.select("rid", "copies", "data"), "rid")
    work = work.withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "blocks")
    group = ["size", "key", "x", "y"]
    work = work.repartition(*group).sortWithinPartitions(*group)

    def pairs(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            ids = np.stack([t[c].to_numpy() for c in group])
            starts = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
            rest = t.slice(starts[-1])
            if len(starts) > 1:
                yield compare(t.slice(0, starts[-1]).combine_chunks(), starts)
        if rest is not None:
            yield compare(rest.combine_chunks(), np.array([0, len(rest)]))

    def compare(t, starts):
        rid, copies, own, x, y, size = (t[c].to_numpy() for c in ("rid", "copies", "own", "x", "y", "size"))
        words = np.stack([t["w0"].to_numpy(), t["w1"].to_numpy()], axis=1)
        data = t["data"].combine_chunks()
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                vectors = _matrix(data.slice(a, b - a), int(size[a]), double)
                linked, root = verify(vectors, words[a:b], copies[a:b], own[a:b] if x[a] != y[a] else None, least)
                hit = np.flatnonzero(linked)
                out.append((rid[a + hit], linked[hit], rid[a + root[hit]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "linked", "root"])

    return work.mapInArrow(pairs, "rid long, linked long, root long")


def near_dedup(vectors: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept, as are vectors of a
    length of their own: only equal lengths are compared. Rows with equal vectors link with each other, repeated ids
    included. Null ids are never a component's id unless all its ids are null. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    double = rows.schema["embedding"].dataType.elementType.typeName() != "float"
    if double:
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (v < float("inf")) & (v > float("-inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    same = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    same = written(same.withColumn("rid", F.monotonically_increasing_id()))

    def pack(batches):
        for b in batches:
            lists = b.column("embedding")
            flat = lists.flatten().to_numpy().astype("<f8" if double else "<f4")
            ends = np.cumsum([0, *pc.list_value_length(lists).to_numpy()]) * flat.itemsize
            raw = flat.tobytes()
            data = pa.array([raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("copies"), pc.list_value_length(lists), data], ["rid", "copies", "size", "data"])

    classes = same.select("rid", "copies", "embedding").mapInArrow(pack, "rid long, copies long, size int, data binary")
    found = written(links(classes, double, least))
    counts = found.groupBy("rid").agg(F.sum("linked").alias("linked"))
    group = connected_components(found.where("rid <> root").select("rid", "root").distinct(), "rid", "root")
    named = same.select("rid", "least", "copies", "embedding").join(group, same["rid"] == group["node"], "left")
    named = named.select("rid", "least", "copies", "embedding", F.coalesce("component", "rid").alias("root"))
    named = written(named.join(counts, "rid", "left").select("root", "least", "embedding", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(first, "root").select(F.col("embedding").alias("__v"), "n_links", "component_id")
    linked = rows.where("good").join(named, F.col("embedding") == F.col("__v")).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
