"""Best-fit packing of token sequences by large-item matching.

Only the number of pieces of each length goes to the driver. There pieces longer than a third of the capacity
are matched, at most two to a sequence, the largest partner that fits first; smaller pieces then go, longest first,
into the fullest sequences that still hold them. The result is a list of slots for the pieces of each length by their
rank, so that pieces find their places on the executors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.llm.common import free_memory, with_fields, written
from worklens.llm.tokens import byte_bpe

CAPACITY = 1024
END = 2


@dataclass
class Bins:
    """``count`` sequences from ``first`` on that are filled alike."""

    first: int
    count: int


@dataclass
class Slots:
    """Pieces of one length with ranks from ``rank`` on: ``each`` in a row in every one of ``bins``, from ``offset`` on."""

    size: int
    rank: int
    bins: Bins
    each: int
    offset: int


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Slots], int]:
    """Slots for ``counts[size]`` pieces of each size up to ``capacity``, and the number of sequences."""
    left = [int(c) for c in counts]
    used = [0] * (capacity + 1)
    slots: list[Slots] = []
    open_bins: list[list[Bins]] = [[] for _ in range(capacity + 1)]  # by the room left
    made = 0

    def place(size: int, bins: Bins, each: int, room: int) -> None:
        slots.append(Slots(size, used[size], bins, each, capacity - room))
        used[size] += each * bins.count
        left[size] -= each * bins.count

    large = capacity // 3 + 1
    for size in range(capacity, large - 1, -1):
        while left[size]:
            room = capacity - size
            partner = next((s for s in range(min(room, size), large - 1, -1) if left[s]), 0)
            n = left[size] if not partner else left[size] // 2 or 1 if partner == size else min(left[size], left[partner])
            if partner == size and left[size] == 1:
                partner = next((s for s in range(min(room, size - 1), large - 1, -1) if left[s]), 0)
            bins = Bins(made, n)
            made += n
            place(size, bins, 1, capacity)
            if partner:
                place(partner, bins, 1, room)
                room -= partner
            open_bins[room].append(bins)
    for size in range(large - 1, 0, -1):
        room = size
        while left[size]:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room > capacity:
                n = max(1, left[size] // (capacity // size))
                bins, made = Bins(made, n), made + n
                room = capacity
            else:
                bins = open_bins[room].pop()
            each = min(room // size, left[size])
            n = min(bins.count, left[size] // each)
            if n < bins.count:
                open_bins[room].append(Bins(bins.first + n, bins.count - n))
            place(size, Bins(bins.first, n), each, room)
            open_bins[room - each * size].append(Bins(bins.first, n))
    return slots, made


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, tokens: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, the task that made it and its rank among that
    task's pieces of the length; with ``tokens`` also the little-endian ids.

    A document longer than ``capacity`` is cut from its end into pieces of ``capacity``, so only the first can be shorter."""
    ddl = "piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * tokens
    ids = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = with_fields(ids.select("doc_id"), ddl)
    tail = int(end).to_bytes(4, "little")

    def cut(batches):
        bpe, task, nth = byte_bpe(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            which: list[int] = []
            for at, text in enumerate(b.column("text")):
                data = bpe.ids(text.as_py() or "") + tail
                n = len(data) // 4
                stops = range(n % capacity or capacity, n + 1, capacity)
                for piece, stop in enumerate(stops):
                    start = stop - (stops[0] if not piece else capacity)
                    part = data[4 * start : 4 * stop]
                    rows.append((piece, start, stop - start, zlib.crc32(part), task, nth[stop - start], part)[: 6 + tokens])
                    nth[stop - start] += 1
                    which.append(at)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (6 + tokens)
            arrays = [b.column("doc_id").take(pa.array(which, pa.int64()))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names)
        free_memory()

    names = schema.names
    return ids.mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, tokens: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and the ``offset`` in the sequence, gapless from 0.

    A null or empty text is one piece with the end id alone; rows with the same doc_id are documents of their own; an empty
    table gives no rows. At most ``capacity`` counts and one slot list of a few thousand entries pass the driver, whatever
    the size of the table: each length opens and splits a bounded number of groups of like sequences.
    """
    made = written(pieces(docs, tokenizer, capacity, end, tokens))
    counts = np.zeros(capacity + 1, np.int64)
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("held"))
    for length, n in per_task.groupBy("length").agg(F.sum("held")).collect():  # one row for each length
        counts[length] = n
    slots, _ = plan(counts, capacity)
    slots.sort(key=lambda s: (s.size, s.rank))
    size = np.array([s.size for s in slots], np.int64)
    lists = [np.array(x, np.int64) for x in zip(*[(s.rank, s.bins.first, s.each, s.offset) for s in slots], strict=True)] or [np.zeros(0, np.int64)] * 4
    table = docs.sparkSession.sparkContext.broadcast((np.searchsorted(size, np.arange(capacity + 2)), *lists))

    before = F.sum("held").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0))
    starts = per_task.select("length", "task", (before - F.col("held")).alias("rank0"))
    ranked = made.join(starts, ["length", "task"]).select(*made.columns, (F.col("rank0") + F.col("nth")).alias("rank"))

    def seat(batches):
        first, rank0, bin0, each, offset = table.value
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.zeros(len(n), np.int64)
            for s in np.unique(n):
                own = n == s
                at[own] = first[s] + np.searchsorted(rank0[first[s] : first[s + 1]], r[own], "right") - 1
            k = r - rank0[at]
            seats = {"sequence_id": bin0[at] + k // each[at], "offset": offset[at] + k % each[at] * n}
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, seats.values())], [*b.schema.names, *seats])

    kept = [c for c in made.columns if c not in ("task", "nth")]
    ranked = ranked.select(*kept, "rank")
    return ranked.mapInArrow(seat, with_fields(ranked, "sequence_id long, offset long")).drop("rank")

