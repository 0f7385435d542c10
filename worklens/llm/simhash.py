"""SimHash near-dedup over an inverted index of byte positions.

Fingerprints of 8 bytes that differ in at most 2 bits agree in at least 6 byte positions. Of the four
pairs of positions (0-1, 2-3, 4-5, 6-7) two then agree in full, so each fingerprint stands in the posting
lists of the six pairs of pairs. Pairs met in a list are tallied by the byte positions they share, kept from
six on, and verified by their bits. Wider bounds, up to seven bits, leave one byte position equal: lists are then those of single
positions, cut into blocks that meet in pairs.

The pipeline's stage takes such links as candidates only and joins documents by the Jaccard similarity of their shingle sets. As most
pairs of that similarity differ in more bits than byte positions can bear, texts that share a band of MinHash values are candidates too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import connected_components, free_memory, with_fields, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints in a posting list up to which its pairs are formed; longer lists are linked over their neighbourhoods.
PAIRS_UP_TO = 64
#: The pipeline's stage: five words, the most bits that leave a byte position equal, and the similarity that decides.
STAGE_SHINGLE, STAGE_BITS, STAGE_SIMILARITY = 5, 7, 0.8
#: Bands of MinHash values and values of each: a pair of similarity 0.8 shares no band once in 17 000 times.
BANDS, BAND = 32, 6
_ODD, _ADD = np.random.default_rng(9).integers(0, 2**64, (2, BANDS * BAND), np.uint64)
_ODD |= np.uint64(1)
#: Fingerprints of a byte position's list, and texts of a group of candidates, that are compared in one task.
BLOCK, TEXTS = 2048, 256
_STEP = 1 << 16


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of the lower-cased (A-Z) words in runs of ``_STEP``, repeats included; none without words."""
    words = text.lower().split()
    if not words:
        return
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for i in range(0, len(starts), _STEP):
        parts = map(line.__getitem__, map(slice, starts[i : i + _STEP], ends[i : i + _STEP]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), ">u8", len(starts[i : i + _STEP]))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles, repeats included; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _hashes(text, shingle):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different shingle hashes of ``text`` in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(h.astype(np.uint64) for h in _hashes(text, shingle))]))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values of a set of shingle hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        mixed = hashes[i : i + (1 << 12), None] * _ODD + _ADD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), n) for n, r in enumerate(rows)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. A null text is the empty text."""

    def make(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        free_memory()

    ids = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(make, with_fields(ids.select("doc_id"), "fp long"))


def _shared_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))


def links(fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) between different fingerprints of ``fps`` (fp), enough for every link of at most ``max_bits`` bits to be connected.

    Up to two bits: a list of up to ``pairs_up_to`` fingerprints gives its verified pairs. In a longer list two fingerprints differ in two
    bits or less exactly when both are within one bit of a common centre; each names its 33 centres (itself and
    one flip in the 32 bits that the list leaves open), and those of a centre, 33 at most, are linked to its smallest.
    Work stays in proportion to the list. From three bits on see ``byte_links``."""
    if max_bits > MAX_BITS:
        return byte_links(fps, max_bits)
    if max_bits < MAX_BITS:
        raise ValueError("long lists are linked over centres one bit away, which is for two bits")
    part = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    combos = list(combinations(range(4), 2))
    keys = F.array(*[F.lit(n * 2**32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for n, (i, j) in enumerate(combos)])
    posts = fps.select("fp", F.explode(keys).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    posts = written(posts.join(lists, "key"))
    few = posts.where(F.col("held") <= pairs_up_to).select("key", "fp")
    met = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key").where("src < dst")
    met = met.where(_shared_bytes(F.col("src"), F.col("dst")) >= 8 - MAX_BITS)
    met = met.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS).select("src", "dst")

    def open_bits(i: int, j: int) -> Column:
        masks = [0] + [1 << b for p in range(4) if p not in (i, j) for b in range(48 - 16 * p, 64 - 16 * p)]
        return F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in masks])

    which = F.shiftrightunsigned("key", 32)
    flips = F.coalesce(*[F.when(which == n, open_bits(i, j)) for n, (i, j) in enumerate(combos)])
    near = posts.where(F.col("held") > pairs_up_to).select("key", "fp", F.explode(flips).alias("flip"))
    near = near.groupBy("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    near = near.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    return met.union(near)


def _forest(near: np.ndarray) -> np.ndarray:
    """The smallest row that each row of the symmetric matrix ``near`` is connected with."""
    i, j = np.nonzero(near)
    root = np.arange(len(near))
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def byte_links(fps: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """``links`` for up to seven bits: two such fingerprints agree in one of the eight byte positions at least.

    The list of a position's value is cut into blocks of about ``block`` fingerprints, and blocks meet in pairs; tasks give a
    spanning forest, not pairs. Blocks of a list grow with the square of its length, at one machine word a pair."""
    if max_bits > 7:
        raise ValueError("fingerprints that differ in more than seven bits need not share a byte position")
    keys = F.array(*[F.lit(256 * i).cast("long").bitwiseOR(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))) for i in range(8)])
    posts = fps.select("fp", F.explode(keys).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")  # 2048 rows at most
    lists = lists.select("key", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    parts = posts.join(F.broadcast(lists), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    parts = written(parts.groupBy("key", "own", "blocks").agg(F.collect_list("fp").alias("fps")))
    one = parts.select("key", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("fps").alias("a"))
    two = parts.select("key", F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("x"), F.col("fps").alias("b"))
    work = one.join(two, ["key", "x", "y"]).select(F.col("x") == F.col("y"), "a", "b").toDF("same", "a", "b")

    def compare(batches):
        for batch in batches:
            out = [np.zeros((2, 0), np.int64)]
            for same, a, b in zip(batch.column("same"), batch.column("a"), batch.column("b"), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                near = np.stack([np.bitwise_count((b ^ f).view(np.uint64)) <= max_bits for f in a])
                if same.as_py():
                    every = a
                else:
                    every, cross = np.concatenate([a, b]), near
                    near = np.zeros((len(every),) * 2, bool)
                    near[: len(a), len(a) :], near[len(a) :, : len(a)] = cross, cross.T
                root = _forest(near)
                hit = np.flatnonzero(root != np.arange(len(root)))
                out.append(np.stack([every[root[hit]], every[hit]]))
            src, dst = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])
        free_memory()

    return work.mapInArrow(compare, "src long, dst long")


def _joined(t: pa.Table, least: float, cross: bool) -> pa.Table:
    """(src, dst) that join the rows of ``t`` (cls, own, comp, hashes) whose sets have a similarity of ``least``; rows of one comp
    are joined already, and with ``cross`` rows of one own were compared before."""
    cls, own, comp = (t[c].to_numpy() for c in ("cls", "own", "comp"))
    sets = [np.frombuffer(h, np.uint64) for h in t["hashes"].to_pylist()]
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    up = {c: c for c in comp.tolist()}

    def find(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    src, dst = [], []
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if len(sets[i]) < least * len(sets[j]):
                break
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a == b or cross and own[i] == own[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared):
                up[max(a, b)] = min(a, b)
                src.append(int(cls[i]))
                dst.append(int(cls[j]))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def similar_links(docs: DataFrame, rows: DataFrame, shingle: int, max_bits: int, least: float, texts: int = TEXTS) -> DataFrame:
    """(src, dst) between classes (cls) of equal words in ``rows`` (digest, fp, cls, bands), enough to connect all that are candidates and
    whose shingle sets have a Jaccard similarity of ``least``. Candidates have fingerprints that are linked by at most ``max_bits`` bits, or share a band.

    Such classes are a list; equal lists are taken once. First every block of ``texts`` classes of a list is compared,
    the list's smallest class with all; only where that leaves several components in several blocks do blocks meet in pairs."""
    classes = written(rows.groupBy("cls", "fp").agg(F.min("digest").alias("digest"), F.first("bands").alias("bands")))
    near = connected_components(links(classes.select("fp").distinct(), max_bits=max_bits))
    by_bits = classes.join(near, classes["fp"] == near["node"], "left").select(F.coalesce("component", "fp").alias("key"), F.lit(0).alias("kind"), "cls", "digest")
    grouped = by_bits.union(classes.select(F.explode("bands").alias("key"), F.lit(1).alias("kind"), "cls", "digest"))
    held = grouped.groupBy("key", "kind").agg(F.count("*").alias("held"), F.min("cls").alias("centre"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("all")).where("held > 1")
    held = held.groupBy("held", "centre", "all").agg(F.min(F.struct("key", "kind")).alias("k"))
    held = held.select("k.key", "k.kind", "centre", F.ceil(F.col("held") / texts).cast("int").alias("blocks"))
    work = grouped.join(held, ["key", "kind"]).select(F.xxhash64("key", "kind").alias("bucket"), "cls", "digest", "centre", "blocks")
    work = written(work.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))

    def make(batches):
        for b in batches:
            sets = [shingle_set(t or b"", shingle).tobytes() for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(sets, pa.binary())], ["digest", "hashes"])
        free_memory()

    some = docs.select(_digest(), F.col("text").cast("string").alias("text")).join(work.select("digest"), "digest", "left_semi")
    sets = some.dropDuplicates(["digest"]).mapInArrow(make, "digest long, hashes binary")
    work = written(work.join(sets, "digest").drop("digest"))
    blocks = F.when(F.col("cls") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = work.select("bucket", "cls", "own", F.col("cls").alias("comp"), "hashes", F.explode(blocks).alias("x"))
    first = written(first.groupBy("bucket", "x").applyInArrow(lambda t: _joined(t, least, False), "src long, dst long"))
    large = work.where("blocks > 1")
    found = connected_components(first)
    large = large.join(found, large["cls"] == found["node"], "left").withColumn("comp", F.coalesce("component", "cls"))
    open_ = large.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bucket")
    open_ = large.join(open_, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    open_ = open_.select("bucket", "cls", "own", "comp", "hashes", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return first.union(open_.groupBy("bucket", "x", "y").applyInArrow(lambda t: _joined(t, least, True), "src long, dst long"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs`` (doc_id, text).

    Documents of one fingerprint are one class; links are sought between classes, so copies cost nothing. Texts without
    words have fingerprint 0 and link like any other. component_id is the smallest doc_id reached, null if
    the component has none. Repeated rows repeat in the result; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, shingle))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(classes.select("fp"), max_bits=max_bits))
    whole = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    whole = written(whole)
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("__fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, fp, cls, bands): digest of the text, fingerprint, hash of the lower-cased words, and keys of the MinHash bands."""

    def make(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            cls = np.fromiter((xxhash.xxh64_intdigest(b" ".join(t.lower().split())) for t in texts), np.uint64, len(texts))
            keys = pa.array([bands(shingle_set(t, shingle)) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(fp.view(np.int64)), pa.array(cls.view(np.int64)), keys], ["doc_id", "digest", "fp", "cls", "bands"])
        free_memory()

    ids = docs.select("doc_id", _digest(), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(make, with_fields(ids.select("doc_id", "digest"), "fp long, cls long, bands array<long>"))


def keep_documents(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group, repeated rows of that id once; rows without an id stay.

    Without ``least`` a group is linked by fingerprints that differ in at most ``max_bits`` bits; with it such documents
    or those with a shared band are candidates, linked when their shingle sets have that Jaccard similarity."""
    if least is None:
        stay = simhash_groups(docs, shingle, max_bits).where("doc_id = component_id").select("doc_id").distinct()
        kept = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return kept.select(docs.columns).union(docs.where("doc_id IS NULL"))
    rows = written(_described(docs, shingle))
    found = connected_components(similar_links(docs, rows, shingle, max_bits, least))
    whole = rows.where("doc_id IS NOT NULL").join(found, rows["cls"] == found["node"], "left")
    stay = whole.groupBy(F.coalesce("component", "cls").alias("root")).agg(F.min(F.struct("doc_id", "digest")).alias("s"))
    stay = written(stay.select(F.col("s.doc_id").alias("__id"), F.col("s.digest").alias("__digest")))
    kept = docs.where("doc_id IS NOT NULL").withColumn("__text", _digest())
    kept = kept.join(stay, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_semi").dropDuplicates(["doc_id", "__text"])
    return kept.select(docs.columns).union(docs.where("doc_id IS NULL"))
