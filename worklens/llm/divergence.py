"""How far the words of a source stand from those of the other sources of its language.

Terms are counted in the Python workers by length: those of up to 8 bytes become one 64-bit number, those of up to 16 bytes two, and both are
radix-sorted, 16 bits at a time; equal neighbours are counted as runs. Longer terms go to buckets by the power of two above their length
and are sorted there as bytes. Spark adds the counts of all blocks by (language, term), and the shares of every source follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import free_memory, written

#: A language keeps the terms in so many of its documents; the smoothing is added to every count; shares are counted in parts of SCALE.
MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms reported for a source.
TOP = 50
#: Bytes of text whose terms are sorted together, and rows of such a block (their number is one digit of the sort).
BLOCK = 8_000_000
BLOCK_ROWS = 1 << 16
#: Sources and, about, terms of the squares in which shares are compared.
TILE = 256
TILE_TERMS = 8192

_BYTES = np.arange(256)
#: Bytes of terms: A-Z, a-z and all of other scripts; only A-Z get lower case.
_IN_TERM = (_BYTES >= 128) | ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)


def _radix(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` sorted by the unsigned ``key``, least digit first; every pass keeps the order of the one before."""
    for shift in range(0, key.itemsize * 8, 16):
        digit = (key >> key.dtype.type(shift)).astype(np.uint16)
        if digit[0] != digit[-1] or (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for numbers of 16 bits
    return order


def _strings(padded: np.ndarray) -> pa.Array:
    """Rows of bytes, padded with zeros, as strings; terms hold no zero."""
    real = padded != 0
    ends = np.cumsum(real.sum(1), dtype=np.int64)
    offsets = np.concatenate((np.zeros(1, np.int64), ends))
    return pa.Array.from_buffers(pa.large_string(), len(padded), [None, pa.py_buffer(offsets), pa.py_buffer(padded[real])]).cast(pa.string())


def _counted(padded: np.ndarray, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For every group and term: the group, the term, its occurrences and its rows. ``row`` ascends."""
    width = padded.shape[1]
    order = np.arange(len(padded))
    if width <= 16:
        for word in reversed(padded.view(">u8").astype(np.uint64).T):
            order = _radix(order, word)
    else:
        order = np.argsort(padded.view(f"S{width}")[:, 0], kind="stable")
    order = _radix(order, group.astype(np.uint16))
    padded, group, row = padded[order], group[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (padded[1:] != padded[:-1]).any(1)
    at = np.flatnonzero(new)
    new[1:] |= row[1:] != row[:-1]
    return group[at], _strings(padded[at]), np.diff(at, append=len(order)), np.add.reduceat(new.astype(np.int64), at)


def count_block(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, rows) of the terms of ``texts``, whose group numbers are below 2 ** 16, by bucket of length."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1])[offsets[0] :] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _IN_TERM[raw]
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))) if len(raw) else np.zeros(0, np.int64)
    # a text that begins with a term just behind one that ends with a term begins a term of its own
    edges = np.unique(offsets[1:-1])
    edges = edges[(edges > 0) & (edges < len(raw))]
    first = np.union1d(first, edges[inside[edges]])
    last = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1 if len(raw) else first
    last = np.union1d(last, edges[inside[edges - 1]])
    row = np.searchsorted(offsets, first, "right") - 1
    size = last - first
    raw = np.concatenate((_LOWER[raw], np.zeros(16, np.uint8)))
    below, width = 0, 8
    while below < size.max(initial=0):
        some = np.flatnonzero((size > below) & (size <= width))
        if len(some):
            if width > 16:
                raw = np.concatenate((raw, np.zeros(max(0, int(first[some].max()) + width - len(raw)), np.uint8)))
            padded = np.lib.stride_tricks.sliding_window_view(raw, width)[first[some]]
            padded[np.arange(width) >= size[some][:, None]] = 0
            yield _counted(padded, group[row[some]], row[some])
        below, width = width, width * 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of about BLOCK bytes of text, fewer than BLOCK_ROWS; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        text = b.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            used = int(ends[at - 1]) if at else 0
            stop = max(int(np.searchsorted(ends, used + BLOCK - size, "right")), at if held else at + 1)
            stop = min(stop, at + BLOCK_ROWS - rows, len(b))
            if stop > at:
                held.append(b.slice(at, stop - at))
                size, rows = size + int(ends[stop - 1]) - used, rows + stop - at
            if stop < len(b):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def named(docs: DataFrame) -> DataFrame:
    """text, lang and source as strings, null as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, count, docs): occurrences of every term in every source of every language, and the documents of
    the source that hold it. The rows of a (lang, term) stand in one partition."""

    def count(batches):
        for block in _blocks(batches):
            who = pa.StructArray.from_arrays([block.column(c).combine_chunks() for c in ("lang", "source")], ["lang", "source"])
            langs, sources = (c.dictionary_encode() for c in (who.field(0), who.field(1)))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            known, group = np.unique(code, return_inverse=True)
            for g, term, n, rows in count_block(block.column("text").combine_chunks(), group):
                lang, source = known[g] // len(sources.dictionary), known[g] % len(sources.dictionary)
                table = pa.table([langs.dictionary.take(pa.array(lang)), term, sources.dictionary.take(pa.array(source)), pa.array(n), pa.array(rows)], ["lang", "term", "source", "count", "docs"])
                yield from table.to_batches(max_chunksize=100_000)
        free_memory()

    parts = named(docs).mapInArrow(count, "lang string, term string, source string, count long, docs long")
    dealt = parts.repartition("lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, count, lang_count) of the terms that stand in ``min_docs`` documents of the language."""
    same = Window.partitionBy("lang", "term")
    all_ = term_counts(docs).withColumns({"lang_docs": F.sum("docs").over(same), "lang_count": F.sum("count").over(same)})
    return written(all_.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"))


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (count + s) / (total + s * terms)), in whole numbers of up to 38 digits."""
    of = total.cast("decimal(38,0)") + (terms * smoothing).cast("decimal(38,0)")
    return 1 + F.call_function("div", (count + smoothing).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), of)


def sources_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each (lang, source) of ``docs``: total (N of the source), lang_total, terms (V of the language), base (the share of
    a term that does not occur; null without terms) and nth (the source's number in its language, from 0)."""
    groups = named(docs.select(F.lit(None).cast("string").alias("text"), "lang", "source")).select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    out = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    out = out.withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))
    return written(out.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))


def term_part(kept: DataFrame, sources: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms that stand out of the language in each source, ``top`` at most."""
    x = kept.join(sources, ["lang", "source"])
    p, q = share(F.col("count"), F.col("total"), F.col("terms")), share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    x = x.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return x.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)


def pair_sums(kept: DataFrame, sources: DataFrame, tile: int = TILE, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language: the sum of the differences of their shares of all its terms.

    Shares are compared in squares: the terms of a language are dealt to chunks of about ``tile_terms``, its sources to tiles of
    ``tile``, and one group holds a chunk and two tiles. A term that a source lacks has its base share there, so a group needs the
    counted rows and the base shares only, and gives no more rows than pairs of sources."""
    sources = sources.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / tile_terms)).cast("int")).withColumn("tile", F.expr(f"int(nth div {tile})"))
    tiles = sources.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    sources = sources.join(tiles, "lang")
    place = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    met = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    shares = kept.join(sources, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("terms")))
    shares = shares.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    shares = shares.select("lang", "chunk", "term", "nth", "p", "tile", met).select("lang", "chunk", *place, "term", "nth", "p")
    known = sources.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    known = known.select("lang", "chunk", "source", "nth", "base", "terms", "tile", met).select("lang", "chunk", *place, "source", "nth", "base", "terms")
    known = known.toDF(*known.columns)  # columns of its own, for the cogroup

    def differences(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, low, high = (key[k].as_py() for k in (1, 2, 3))
        right = right.sort_by("nth")
        nth, names = right["nth"].to_numpy(), right["source"].combine_chunks()
        base = pc.fill_null(right["base"], 0).to_numpy()
        terms = right["terms"].to_numpy()
        term = left["term"].combine_chunks().dictionary_encode()
        column = np.searchsorted(nth, left["nth"].to_numpy())
        grid = np.repeat(base[None, :], len(term.dictionary), axis=0)
        if len(term):
            grid[term.indices.to_numpy(), column] = left["p"].to_numpy()
        a_, b_, values = [], [], []
        for a in np.flatnonzero(nth // tile == low).tolist():
            b = np.flatnonzero((nth // tile == high) & (nth > nth[a]))
            flat = np.abs(base[a] - base[b])
            # all terms at the base shares, once, and what the occurring terms of this chunk change
            values.append(np.abs(grid[:, [a]] - grid[:, b]).sum(0) - flat * len(grid) + (flat * terms[a] if chunk == 0 else 0))
            a_.append(np.full(len(b), a))
            b_.append(b)
        lang = pa.array([key[0].as_py()] * sum(map(len, b_)), pa.string())
        joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a_, b_, values)]
        return pa.table([lang, names.take(pa.array(joined[0])), names.take(pa.array(joined[1])), pa.array(joined[2], pa.int64())], ["lang", "a", "b", "value"])

    by = ["lang", "chunk", "low", "high"]
    sums = shares.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(differences, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE, tile_terms: int = TILE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank over all rows of ``docs`` (text, lang, source).

    Part ``pair`` has every other source of the language with the sum of the differences of shares, part ``term`` the terms whose share
    is above the language's. Null text, lang and source are empty strings; every row counts as a document, repeated ones too. Ties are
    ranked by the item's bytes. A language without kept terms has pairs of value 0; an empty table gives no rows; other columns are not read."""
    kept = kept_terms(docs, min_docs)
    sources = sources_of(docs, kept)
    pairs = written(pair_sums(kept, sources, tile, tile_terms))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, part in (("pair", both), ("term", term_part(kept, sources, top)))]
    return out[0].union(out[1])
