"""Language-model scoring by context-tree weighting over bytes, beside a unigram base.

Every byte is coded as eight binary choices. A choice has a node for each depth of context, 0 to ``DEPTH`` bytes back, with a
Krichevsky-Trofimov estimate of its own; a node mixes its estimate with its children's by their probabilities of all training text.
These depend on counts alone, so the tree is built from counts of the (``DEPTH`` + 1)-byte strings of the corpus.

No task holds the model. The documents are read in blocks; a block sends each different string and word once to the owner of its hash,
and gets back its code length or count. Trees are built by the last two context bytes; only the nodes of depth 0 and 1 (65 535 at
most, whatever the corpus) pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import crc_fold, free_memory, slices, with_fields, written

DEPTH = 5
#: Bytes of text in a block, and documents for one bucket of hashes.
BLOCK = 32_000_000
BUCKET_DOCS = 4000
#: Bytes of text whose strings are held at a time.
SLICE = 1_000_000
#: Stands before and after each text; no UTF-8 text has it.
EDGE = b"\xff"
END_TOKEN = "\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)

_HALF = np.cumsum(np.concatenate(([0.5 * math.log(math.pi)], np.log(np.arange(4096) + 0.5))))  # lgamma(n + 1/2)
_ONE = np.cumsum(np.concatenate(([0.0], np.log(np.arange(1, 4097)))))  # lgamma(n + 1)


def _lgamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, 4095)]
    big = n > 4095
    if big.any():
        x = n[big] + shift
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of any sequence with these counts."""
    return _lgamma(zeros, 0.5, _HALF) + _lgamma(ones, 0.5, _HALF) - _lgamma(zeros + ones, 1.0, _ONE) - math.log(math.pi)


# --- strings of a text: the context's bytes from the nearest on, then the byte itself


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte strings of the lower-cased (A-Z) texts with an end each, and where each text's begin."""
    pad = EDGE * depth
    data = np.frombuffer(b"".join([pad + t.lower() + EDGE for t in texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes + depth) - sizes - depth
    key = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        key |= data[depth - back : len(data) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    real = np.ones(len(data), bool)
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[real[depth:]], np.cumsum(sizes) - sizes


def _owner(keys: np.ndarray, n: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * _MIX
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.compress(raw, 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw, size = zstandard.decompress(data), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


# --- the tree


class Tree:
    """Nodes of depths ``top`` to ``depth`` over strings with counts. A node's id is its context's bytes and the bits of the byte so far."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH):
        self.top, self.depth, self.nodes = top, depth, {}
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(np.int64)
        below = None
        for d in range(depth, top - 1, -1):
            ctx, sym = keys >> np.uint64(8), keys & np.uint64(255)
            ids, ones, both = [], [], []
            for k in range(8):
                ids.append(ctx << np.uint64(8) | (np.uint64(1 << k) | sym >> np.uint64(8 - k)))
                ones.append(counts * ((sym >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64))
                both.append(counts)
            node, one, all_ = _sum_by(*map(np.concatenate, (ids, ones, both)))
            kt = log_kt(all_ - one, one)
            if below is None:
                weight, lpw = np.full(len(node), np.inf), kt
            else:
                up, children = _sum_by((below[0] >> np.uint64(16)) << np.uint64(8) | (below[0] & np.uint64(255)), below[1])
                weight = kt - children  # log odds of the own estimate; up and node are the same ids
                lpw = np.logaddexp(kt, children) - math.log(2)
            self.nodes[d] = (node, one, all_, weight, lpw)
            below = (node, lpw)
            keys, counts = _sum_by((ctx >> np.uint64(8)) << np.uint64(8) | sym, counts)

    def ones(self, keys: np.ndarray, k: int, p: np.ndarray | None = None) -> np.ndarray:
        """Probability that bit ``k`` of each string's byte is one, after its context and the bits before; ``p``: from below."""
        p = np.full(len(keys), 0.5) if p is None else p
        ctx, sym = keys >> np.uint64(8), keys & np.uint64(255)
        bits = np.uint64(1 << k) | sym >> np.uint64(8 - k)
        for d in range(self.depth, self.top - 1, -1):
            node, one, all_, weight, _ = self.nodes[d]
            want = (ctx >> np.uint64(8 * (self.depth - d))) << np.uint64(8) | bits
            at = np.minimum(np.searchsorted(node, want), max(0, len(node) - 1))
            hit = np.flatnonzero(node[at] == want) if len(node) else np.zeros(0, np.int64)
            at = at[hit]
            own = (one[at] + 0.5) / (all_[at] + 1)
            p[hit] = p[hit] + (own - p[hit]) / (1 + np.exp(-np.clip(weight[at], -700, 700)))
        return p


def finish(tree: Tree, upper: dict | None, keys: np.ndarray) -> np.ndarray:
    """Log10 probability of each string's byte. ``upper``: own estimates and their weights at depths 1 and 0."""
    total = np.zeros(len(keys))
    sym = keys & np.uint64(255)
    near = (keys >> np.uint64(8 * tree.depth)).astype(np.int64)
    for k in range(8):
        p = tree.ones(keys, k)
        bits = ((np.uint64(1 << k) | sym >> np.uint64(8 - k))).astype(np.int64)
        if upper is not None:
            for own, weight in ((upper["own1"][near, bits], upper["w1"][near, bits]), (upper["own0"][bits], upper["w0"][bits])):
                p = p + (own - p) * weight
        bit = (sym >> np.uint64(7 - k)) & np.uint64(1)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def upper_levels(c1: np.ndarray, bits: np.ndarray, lpw: np.ndarray, ones: np.ndarray, both: np.ndarray) -> dict:
    """Depths 1 and 0 from the sums of depth 2 by (nearest byte, bits so far): 256 x 256 cells at most."""
    children, one, all_ = np.zeros((256, 256)), np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64)
    children[c1, bits], one[c1, bits], all_[c1, bits] = lpw, ones, both
    kt = log_kt(all_ - one, one)
    w1, lpw1 = kt - children, np.logaddexp(kt, children) - math.log(2)
    one0, all0, below = one.sum(axis=0), all_.sum(axis=0), np.where(all_ > 0, lpw1, 0).sum(axis=0)
    w0 = log_kt(all0 - one0, one0) - below

    def share(w, n):  # a context never seen leaves all to what is below: one half
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(w, -700, 700))), 0.0)

    return {"own1": (one + 0.5) / (all_ + 1), "w1": share(w1, all_), "own0": (one0 + 0.5) / (all0 + 1), "w0": share(w0, all0)}


# --- tokens


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row and the word of every token of the lower-cased texts, without the ends."""
    own = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])  # ascii_lower misreads slices
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    rows, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    real = pc.not_equal(flat, "")
    return rows[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()


def _pack_words(words: pa.Array) -> bytes:
    """Words hold no blanks; the end is the empty word and stands alone."""
    return zstandard.compress(" ".join(words.to_pylist()).encode(), 1)


def _unpack_words(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split(" ")


# --- stages


class Block:
    """Different strings and words of the texts read so far, with their training counts."""

    def __init__(self):
        self.size = self.ends = 0
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, texts: pa.Array, train: np.ndarray) -> None:
        key, starts = strings(texts.cast(pa.large_binary()).to_pylist())
        use = np.repeat(train, np.diff(starts, append=len(key)))
        coded = pa.array(key).dictionary_encode()
        own = coded.dictionary.to_numpy()
        self.strings.append((own, np.bincount(coded.indices.to_numpy()[use], minlength=len(own))))
        row, word = tokens(texts)
        self.words.append((word.dictionary, np.bincount(word.indices.to_numpy()[train[row]], minlength=len(word.dictionary))))
        self.ends += int(train.sum())
        self.size += texts.nbytes
        if len(self.strings) >= 8:
            self.shrink()

    def shrink(self) -> None:
        self.strings = [_sum_by(*map(np.concatenate, zip(*self.strings, strict=True)))]
        coded = pa.concat_arrays([w for w, _ in self.words]).dictionary_encode()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, coded.indices.to_numpy(), np.concatenate([c for _, c in self.words]))
        self.words = [(coded.dictionary, total)]

    def rows(self, n: int) -> Iterator[tuple[str, int, bytes, bytes]]:
        """(kind, bucket, strings or words, counts), by the hash of the string or word."""
        self.shrink()
        ((key, count),), ((word, held),) = self.strings, self.words
        for to, kind, pack, values, counts in (
            (_owner(key, n), "strings", _pack, key, count),
            (np.fromiter((xxhash.xxh64_intdigest(w.as_py()) % n for w in word), np.int64, len(word)), "words", _pack_words, word, held),
        ):
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                yield kind, k, pack(values.take(own)), _pack(counts[own].astype(np.int64))
        yield "words", xxhash.xxh64_intdigest(END_TOKEN) % n, _pack_words(pa.array([""])), _pack(np.array([self.ends], np.int64))


def _send(docs: DataFrame, n: int) -> DataFrame:
    """By block: its packed rows (kind body), and for each bucket its different strings and words with their training counts."""

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "block", "data", "counts"])

    def send(batches):
        task, nth, block = TaskContext.get().partitionId(), 0, Block()
        for b in batches:
            for at, size in slices(b.column("text"), SLICE):
                part = b.slice(at, size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield row("body", -1, task << 24 | nth, zstandard.compress(sink.getvalue(), 1), b"")
                block.add(part.column("text"), ~part.column("held_out").to_numpy(zero_copy_only=False))
                if block.size >= BLOCK:
                    for kind, bucket, data, counts in block.rows(n):
                        yield row(kind, bucket, task << 24 | nth, data, counts)
                    nth, block = nth + 1, Block()
        if block.strings:
            for kind, bucket, data, counts in block.rows(n):
                yield row(kind, bucket, task << 24 | nth, data, counts)
        del block
        free_memory()

    return docs.mapInArrow(send, "kind string, bucket int, block long, data binary, counts binary")


def _merge(sent: DataFrame) -> DataFrame:
    """Different strings of the whole corpus with their counts, by the last two context bytes."""

    def merge(table: pa.Table) -> pa.Table:
        key = np.concatenate([_unpack(x, np.uint64) for x in table["data"].to_pylist()])
        count = np.concatenate([_unpack(x, np.int64) for x in table["counts"].to_pylist()])
        key, count = _sum_by(key, count)
        near = (key >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
        ends = np.append(at[1:], len(key))
        return pa.table({"near": pa.array(near[at], pa.int32()), "data": pa.array([_pack(key[i:j]) for i, j in zip(at, ends)]), "counts": pa.array([_pack(count[i:j]) for i, j in zip(at, ends)])})

    return sent.groupBy("bucket").applyInArrow(merge, "near int, data binary, counts binary")


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([_unpack(x, np.uint64) for x in table["data"].to_pylist()])
    count = np.concatenate([_unpack(x, np.int64) for x in table["counts"].to_pylist()])
    order = np.argsort(key)
    return key[order], count[order]


def _upper(merged: DataFrame) -> dict:
    def sums(table: pa.Table) -> pa.Table:
        key, count = _gather(table)
        node, one, all_, _, lpw = Tree(key, count, 2).nodes[2]
        c1 = (node >> np.uint64(16)).astype(np.int32)
        return pa.table({"c1": c1, "bits": (node & np.uint64(255)).astype(np.int32), "lpw": lpw, "ones": one, "both": all_})

    level = merged.groupBy("near").applyInArrow(sums, "c1 int, bits int, lpw double, ones long, both long")
    # 256 x 255 rows at most
    got = level.groupBy("c1", "bits").agg(F.sum("lpw").alias("lpw"), F.sum("ones").alias("ones"), F.sum("both").alias("both")).toArrow()
    return upper_levels(*(got[c].to_numpy() for c in ("c1", "bits", "lpw", "ones", "both")))


def _code(merged: DataFrame, upper: dict, n: int) -> DataFrame:
    """For each bucket the strings with their log10 probabilities."""
    levels = merged.sparkSession.sparkContext.broadcast(upper)

    def code(table: pa.Table) -> pa.Table:
        key, count = _gather(table)
        value = finish(Tree(key, count, 2), levels.value, key)
        to = _owner(key, n)
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.diff(to[order], prepend=-1))
        ends = np.append(at[1:], len(order))
        runs = [order[i:j] for i, j in zip(at, ends)]
        return pa.table({"bucket": pa.array(to[order[at]], pa.int32()), "data": pa.array([_pack(key[r]) for r in runs]), "counts": pa.array([_pack(value[r]) for r in runs])})

    return merged.groupBy("near").applyInArrow(code, "bucket int, data binary, counts binary")


def _answer_strings(sent: DataFrame, coded: DataFrame) -> DataFrame:
    """Back to each block: its strings with their log10 probabilities."""

    def answer(table: pa.Table) -> pa.Table:
        block = np.array(table["block"].to_pylist(), object)
        data, counts = table["data"].to_pylist(), table["counts"].to_pylist()
        model = [k for k, b in enumerate(block) if b is None]
        key = np.concatenate([_unpack(data[k], np.uint64) for k in model])
        value = np.concatenate([_unpack(counts[k], np.float64) for k in model])
        order = np.argsort(key)
        key, value = key[order], value[order]
        asked = [k for k, b in enumerate(block) if b is not None]
        found = [_pack(value[np.searchsorted(key, _unpack(data[k], np.uint64))]) for k in asked]
        return pa.table({"block": pa.array([block[k] for k in asked], pa.int64()), "data": pa.array([data[k] for k in asked], pa.binary()), "counts": pa.array(found, pa.binary())})

    rows = sent.select("bucket", "block", "data", "counts").union(coded.select("bucket", F.lit(None).cast("long"), "data", "counts"))
    return rows.groupBy("bucket").applyInArrow(answer, "block long, data binary, counts binary").withColumn("kind", F.lit("strings"))


def _answer_words(sent: DataFrame) -> DataFrame:
    """Back to each block: its words with their training counts; block -1 has the numbers of tokens and of different words."""

    def answer(table: pa.Table) -> pa.Table:
        words = [_unpack_words(x) for x in table["data"].to_pylist()]
        counts = [_unpack(x, np.int64) for x in table["counts"].to_pylist()]
        coded = pa.array([w for ws in words for w in ws]).dictionary_encode().indices.to_numpy()
        total = np.zeros(int(coded.max()) + 1, np.int64)
        np.add.at(total, coded, np.concatenate(counts))
        ends = np.cumsum([len(w) for w in words])
        back = [_pack(total[coded[e - len(w) : e]]) for e, w in zip(ends, words, strict=True)]
        stats = _pack(np.array([total.sum(), (total > 0).sum()], np.int64))
        return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "data": pa.array([*table["data"].to_pylist(), b""], pa.binary()), "counts": pa.array([*back, stats], pa.binary())})

    return sent.select("bucket", "block", "data", "counts").groupBy("bucket").applyInArrow(answer, "block long, data binary, counts binary").withColumn("kind", F.lit("words"))


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row of ``docs`` (doc_id, text).

    ``held_out`` marks the rows that nothing is learned from (default: crc32 of the id modulo 5 is 1). A null text is the empty text,
    which has its end alone; repeated rows are learned and scored each time; without training rows every choice has
    probability one half. The score is of the lower-cased (A-Z) bytes and the end. An empty table gives no rows.
    """
    held = crc_fold(F.col("doc_id")) == 1 if held_out is None else held_out
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    n = max(4, rows.count() // BUCKET_DOCS)
    sent = written(_send(rows, n), "kind")
    strings_, words = sent.where("kind = 'strings'"), sent.where("kind = 'words'")
    merged = written(_merge(strings_))
    coded = _code(merged, _upper(merged), n)
    counted = written(_answer_words(words))
    total = distinct = 0
    for (x,) in counted.where("block = -1").select("counts").toLocalIterator():  # one row for each bucket
        a, b = _unpack(bytes(x), np.int64).tolist()
        total, distinct = total + a, distinct + b
    body = sent.where("kind = 'body'").select("block", "data", "counts", "kind")
    answers = body.union(_answer_strings(strings_, coded)).union(counted.where("block >= 0").select("block", "data", "counts", "kind"))
    schema = with_fields(docs.select("doc_id"), "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")

    def score(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_pylist()
        data, counts = table["data"].to_pylist(), table["counts"].to_pylist()
        pick = {k: [x for x, name in enumerate(kind) if name == k] for k in ("body", "strings", "words")}
        key = np.concatenate([_unpack(data[x], np.uint64) for x in pick["strings"]])
        value = np.concatenate([_unpack(counts[x], np.float64) for x in pick["strings"]])
        order = np.argsort(key)
        key, value = key[order], value[order]
        vocabulary = pa.array([w for x in pick["words"] for w in _unpack_words(data[x])], pa.large_string())
        seen = np.concatenate([_unpack(counts[x], np.int64) for x in pick["words"]])
        log = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
        end = pc.index(vocabulary, pa.scalar("", pa.large_string())).as_py()
        out = []
        for x in pick["body"]:
            rows = pa.ipc.open_stream(zstandard.decompress(data[x])).read_all().combine_chunks()
            texts = rows["text"].combine_chunks()
            for at, size in slices(texts, SLICE):
                part = texts.slice(at, size)
                k, starts = strings(part.cast(pa.large_binary()).to_pylist())
                coded = pa.array(k).dictionary_encode()
                own = value[np.searchsorted(key, coded.dictionary.to_numpy())]
                s = np.add.reduceat(own[coded.indices.to_numpy()], starts)
                lengths = np.diff(starts, append=len(k))
                row, word = tokens(part)
                code = pc.index_in(word.dictionary, value_set=vocabulary).to_numpy()[word.indices.to_numpy()] if len(word) else np.zeros(0, np.int64)
                base = np.bincount(row, log[code], minlength=size) + log[end] if len(row) else np.full(size, log[end])
                known = np.bincount(row, seen[code] > 0, minlength=size).astype(np.int64) + int(seen[end] > 0) if len(row) else np.full(size, int(seen[end] > 0))
                count = np.bincount(row, minlength=size) + 1 if len(row) else np.ones(size, np.int64)
                kept = rows.slice(at, size)
                columns = [kept["doc_id"].combine_chunks(), kept["held_out"].combine_chunks(), *map(pa.array, (count.astype(np.int64), known, np.full(size, total), base, s, -s / lengths / math.log10(2)))]
                out.append(pa.table(columns, schema.names))
        result = pa.concat_tables(out).combine_chunks()
        del out, key, value, order, vocabulary, seen, log, data, counts
        free_memory()
        return result

    return answers.groupBy("block").applyInArrow(score, schema)
