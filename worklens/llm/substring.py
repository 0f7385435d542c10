"""Substring dedup by sliding sentence spans.

Sentences of more than ``CLAUSES_FROM`` words count as the clauses between their commas, so that a passage that starts or ends inside
one is found up to a clause. A span is a run of consecutive sentences: for every sentence the shortest run that begins with it and the shortest
that ends with it, of two sentences and ``MIN_WORDS`` words at least (a very long sentence is a run of its own). Every span is
hashed; a span repeats when another one, in any document, has the same hash; the first is the one at the smallest
(doc_id, sentence). Sentences that any other repeat covers are removed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import free_memory, slices, with_fields

MIN_WORDS = 20
#: Words of a sentence that is a span alone.
LONG = 40
#: Documents for one bucket of span hashes.
BUCKET_DOCS = 4000
#: Bytes of text whose spans are compared inside a task before they are sent out.
BLOCK = 16_000_000

#: Words from which a sentence is cut at commas, semicolons and colons.
CLAUSES_FROM = 20
_CLAUSE = re.compile(r"(?<=[,;:])(?=[ \t])")
_END = re.compile(r"(?<=[.!?])(?=[ \t])")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: str) -> list[list[str]]:
    """The sentences of each line. They end at a line end, or after full stops, ! and ? before a blank, which goes with the next;
    long ones are cut into clauses in the same way."""
    return [[c for s in _END.split(line) for c in (_CLAUSE.split(s) if s.count(" ") >= CLAUSES_FROM else (s,))] for line in text.split("\n")]


def without(text: str, gone: set[int]) -> str:
    """``text`` without the sentences numbered ``gone``; lines left without a word go too, others stay as they are."""
    out, at = [], 0
    for line in lines_of(text):
        kept = [s for k, s in enumerate(line, at) if k not in gone]
        at += len(line)
        if len(kept) == len(line):
            out.append("".join(line))
        elif "".join(kept).strip():
            out.append("".join(kept).strip(" \t"))
    return "\n".join(out)


def spans(texts: list[str], min_words: int = MIN_WORDS, long: int = LONG) -> tuple[np.ndarray, ...]:
    """For every span of ``texts``: the row, its first and last sentence, and its hash."""
    row: list[int] = []
    nth: list[int] = []
    words: list[int] = []
    hashes: list[int] = []
    for r, text in enumerate(texts):
        k = 0
        for line in lines_of(text.lower()):
            for sentence in line:
                if w := sentence.split():
                    row.append(r)
                    nth.append(k)
                    words.append(len(w))
                    hashes.append(xxhash.xxh64_intdigest(" ".join(w)))
                k += 1
    n = len(row)
    doc, pos, count = np.array(row, np.int64), np.array(nth, np.int64), np.array(words, np.int64)
    total = np.concatenate(([0], np.cumsum(count)))
    i = np.arange(n)
    last = np.maximum(np.searchsorted(total, total[:-1] + min_words) - 1, np.where(count >= long, i, i + 1))
    first = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, np.where(count >= long, i, i - 1))
    a, b = np.concatenate((i, first)), np.concatenate((last, i))
    ok = (a >= 0) & (b < n)
    a, b = a[ok], b[ok]
    ok = doc[a] == doc[b]
    pairs = np.unique(a[ok] * np.int64(n + 1) + b[ok])
    a, b = pairs // (n + 1), pairs % (n + 1)
    # hash of a run: polynomial over the sentences' hashes, modulo 2 ** 64, mixed with its length
    power = np.cumprod(np.full(int((b - a).max(initial=0)) + 2, _BASE)) if n else np.zeros(0, np.uint64)
    value = np.array(hashes, np.uint64)
    h = np.zeros(len(a), np.uint64)
    for step in range(int((b - a).max(initial=-1)) + 1):
        inside = a + step <= b
        h[inside] += value[a[inside] + step] * power[step]
    h = (h ^ (h >> np.uint64(32))) * _BASE + (b - a).astype(np.uint64)
    return doc[a], pos[a], pos[b], (h ^ (h >> np.uint64(29))).view(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(c, np.int64) for c in columns]).tobytes()


def _unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(columns, -1)


def _firsts(h: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold the first span of each hash, and the other rows."""
    order = np.lexsort((stop, start, doc, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    # rows of one document id and place are the same span
    same = np.zeros(len(order), bool)
    same[1:] = ~new[1:] & (doc[order[1:]] == doc[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    tied = same & (doc[order] == doc[order[lead]]) & (start[order] == start[order[lead]])
    return order[new], order[~new & ~tied]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first, last): sentences of spans that repeat an earlier span.

    A task compares the spans of a block of texts first: only the first of each hash is sent to the hash's bucket, all
    others are repeats already. So a passage that many documents share sends one row a block. The buckets, in proportion
    to the documents, then tell which of these firsts is the first of all."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, rows.count() // BUCKET_DOCS)

    def local(held):
        doc, start, stop, h = (np.concatenate(c) for c in zip(*held, strict=True))
        lead, repeats = _firsts(h, doc, start, stop)
        to = h[lead].view(np.uint64) % np.uint64(n)
        order = np.argsort(to, kind="stable")
        lead, edges = lead[order], np.searchsorted(to[order], np.arange(n + 1, dtype=np.uint64))
        again = np.array_split(repeats, n)
        out = [(k, _pack(h[x], doc[x], start[x], stop[x]), _pack(doc[y], start[y], stop[y])) for k in range(n) for x, y in ((lead[edges[k] : edges[k + 1]], again[k]),) if len(x) or len(y)]
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "firsts", "repeats"])

    def blocks(batches):
        held, size = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for at, count in slices(b.column("text"), 2_000_000):
                part = b.column("text").slice(at, count)
                row, start, stop, h = spans(part.to_pylist(), min_words)
                held.append((ids[at : at + count][row], start, stop, h))
                size += part.nbytes
                if size >= BLOCK:
                    yield local(held)
                    held, size = [], 0
        if held:
            yield local(held)
        held = []
        free_memory()

    def meet(table: pa.Table) -> pa.Table:
        h, doc, start, stop = np.concatenate([_unpack(x, 4) for x in table["firsts"].to_pylist()], axis=1)
        _, repeats = _firsts(h, doc, start, stop)
        known = np.concatenate([_unpack(x, 3) for x in table["repeats"].to_pylist()], axis=1)
        found = np.concatenate([known, np.stack([doc[repeats], start[repeats], stop[repeats]])], axis=1)
        return pa.table([pa.array(x) for x in found], ["doc_id", "first", "last"])

    sent = rows.mapInArrow(blocks, "bucket int, firsts binary, repeats binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, first long, last long")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without the repeated spans and, after its columns, n_sentences and n_removed.

    Null ids and null texts stay as they are and take no part (0 sentences); rows of one doc_id are the same document, whose
    places are told apart by sentence. A text that repeats an earlier one in full becomes empty. Texts without a repeat
    come back unchanged. An empty table gives no rows."""
    gone = repeated_spans(docs, min_words)
    # overlapping runs of a document become one list of its sentences, no longer than the document
    gone = gone.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("__gone"))
    base = docs.drop("n_sentences", "n_removed")
    joined = base.join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    names = base.columns
    at = names.index("text")

    def cut(batches):
        for b in batches:
            texts, lists = b.column("text"), b.column("__gone")
            out, total, removed = [], [], []
            for text, numbers in zip(texts, lists, strict=True):
                text, numbers = text.as_py(), numbers.as_py()
                total.append(0 if text is None else sum(map(len, lines_of(text))) if text else 0)
                removed.append(len(numbers) if numbers and text else 0)
                out.append(without(text, set(numbers)) if numbers and text else text)
            arrays = [b.column(c) for c in names]
            arrays[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_sentences", "n_removed"])

    return joined.mapInArrow(cut, with_fields(base, "n_sentences long, n_removed long"))


def clean_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans removed and n_chars counted anew where there is such a column."""
    out = remove_repeats(docs, min_words)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
