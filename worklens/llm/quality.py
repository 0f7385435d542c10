"""Quality classifier: logistic regression over hashed word n-grams, learned by follow the regularised leader.

Features of a text are its words and word pairs (lower case), and runs of one to three word shapes, all
hashed into ``2 ** BITS`` buckets; a feature's value is its share of the text's words. A shape keeps the
case, digits and marks of a word and drops its letters, so that unseen words still say something.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import crc_fold, free_memory, slices, with_fields

BITS = 20
#: Labelled rows to learn from: a bounded sample in the order of the id's hash. Passes over them.
TRAIN_ROWS = 3000
EPOCHS = 4
THRESHOLD = 0.3
#: FTRL: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-3

_LETTERS, _DIGITS, _RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _cased(m: re.Match) -> str:
    w = m[0]
    return "a" if w.islower() else "A" if len(w) > 1 and w.isupper() else "Aa"


def shape(word: str) -> str:
    return _RUNS.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub(_cased, word)))


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * _ODD + b) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the row and the bucket of every occurrence; the words of each row come with it."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows = pc.list_parent_indices(split).to_numpy()
    flat = pc.list_flatten(split)
    real = pc.not_equal(flat, "")
    rows, coded = rows[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
    known = coded.dictionary.to_pylist()
    low = pc.ascii_lower(coded.dictionary).to_pylist()
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in low), np.uint64, len(low))
    form = np.fromiter((xxhash.xxh64_intdigest(shape(w)) for w in known), np.uint64, len(known))
    codes = coded.indices.to_numpy()
    n = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), np.int64)
    w, s = word[codes], form[codes]
    pair = rows[1:] == rows[:-1]
    triple = pair[1:] & pair[:-1]
    same = np.where(codes[1:] == codes[:-1], np.uint64(1), np.uint64(0))
    two = _mix(s[:-1], s[1:], 3)
    for kind, at in (
        (_mix(w, w, 1), rows),
        (_mix(w[:-1], w[1:], 2)[pair], rows[1:][pair]),
        (_mix(s, s, 4), rows),
        (_mix(two, same, 5)[pair], rows[1:][pair]),
        (_mix(two[:-1], s[2:], 6)[triple] if len(two) > 1 else w[:0], rows[2:][triple] if len(two) > 1 else rows[:0]),
    ):
        yield at, (kind >> np.uint64(64 - BITS)).astype(np.int64), n


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(examples: Iterable[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by bucket, the bias last. One example is (buckets, values, label)."""
    size = 2**BITS + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        step = (BETA + np.sqrt(n[i])) / ALPHA + L2
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / step)

    examples = list(examples)
    for _ in range(epochs):
        for i, x, label in examples:
            w = weights(i)
            g = (_sigmoid(w @ x) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def examples(texts: pa.Array, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for k, label in enumerate(labels):
        found = list(buckets(texts.slice(k, 1)))
        words = max(1, int(found[0][2][0]))
        i, count = np.unique(np.concatenate([b for _, b, _ in found]), return_counts=True)
        yield np.append(i, 2**BITS), np.append(count / words, 1.0), int(label)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from ``rows`` labelled rows at most, all of the folds 1 to 4. One task learns from the bounded
    sample and only the weights (4 MB) come back. Without labelled rows all weights are zero."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(crc_fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "text")

    def learn(batches):
        got = [e for b in batches for e in examples(b.column("text"), b.column("quality").to_numpy())]
        w = fit(got)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float32())], ["bucket", "weight"])
        del got, w, at
        free_memory()

    w = np.zeros(2**BITS + 1, np.float32)
    got = sample.select("text", "quality").mapInArrow(learn, "bucket int, weight float").toArrow()
    w[got["bucket"].to_numpy()] = got["weight"].to_numpy()
    return w


def score(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, rows in slices(texts, 2_000_000):
        total = np.zeros(rows)
        for at, b, n in buckets(texts.slice(first, rows)):
            total += np.bincount(at, w[b], minlength=rows) if len(at) else 0.0
        out[first : first + rows] = _sigmoid(w[-1] + total / np.maximum(n, 1))
    return out


def score_documents(docs: DataFrame, w: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with held_out, score and predicted after them. A null text is the empty text and gets the
    score of the bias alone; repeated rows get equal scores. Columns of these names in ``docs`` are replaced."""
    weights = docs.sparkSession.sparkContext.broadcast(w)
    base = docs.drop("score", "held_out", "predicted")
    schema = with_fields(base, "score double")

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column("text"), weights.value))], [*b.schema.names, "score"])
        free_memory()

    out = base.mapInArrow(add, schema)
    return out.withColumn("held_out", crc_fold(F.col("doc_id")) == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
