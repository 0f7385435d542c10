"""Periodic runs of words, found from Lyndon roots.

A run is a stretch of words with smallest period q that no neighbour extends. Every run has a Lyndon root: the longest Lyndon word
at some place of it, under the order of the words or the reversed one. The first phase of Baier's suffix sorter gives these lengths
directly: groups of suffixes are taken from the highest down, and each of their members lengthens the nearest lower suffix to its
left; a group's common prefix is then the longest Lyndon prefix of its members. Each root is extended to both sides by longest common
extensions (ranks of runs of 1, 2, 4, ... words) and is a run if at least twice as long as its root.

Words that no run can hold are left out first: a run of ``m`` words or more is covered by runs of half as many words that stand twice
in the text. What remains are stretches of covered words, and every run lies within one of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import free_memory, slices

MIN_LENGTH = 12
#: Bytes of text whose words are searched at once.
SLICE = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lyndon_lengths(word: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at every place of ``word``, whose entries are its ranks; -1 ends a stretch and must
    stand first."""
    ranks, first = np.unique(word, return_inverse=True)
    order = np.argsort(first, kind="stable")
    members = [m.tolist() for m in np.split(order, np.cumsum(np.bincount(first))[:-1])]
    group, size = first.tolist(), [1] * len(word)
    below, over = list(range(-1, len(ranks) - 1)), list(range(1, len(ranks) + 1))
    done, left = bytearray(len(word)), list(range(-1, len(word) - 1))
    at = len(ranks) - 1
    while at > 0:  # group 0 holds the ends of stretches
        held = [i for i in members[at] if group[i] == at]
        members[at] = ()
        for i in held:
            done[i] = 1
        counts: dict[int, int] = {}
        for i in held:
            j = left[i]
            if done[j]:
                path = [i]
                while done[j]:
                    path.append(j)
                    j = left[j]
                for k in path:
                    left[k] = j
            if group[j]:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            own = size[held[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in counts.items():
                size[j] += times * own
                moved.setdefault((times, group[j]), []).append(j)
            last: dict[int, int] = {}
            for times, low in sorted(moved):  # a lower group's members that more copies follow stand higher
                under, new = last.get(low, low), len(members)
                upper = over[under]
                below.append(under)
                over.append(upper)
                over[under] = below[upper] = last[low] = new
                members.append(js := moved[times, low])
                for j in js:
                    group[j] = new
        at = below[at]
    return np.array(size, np.int64)


class Extensions:
    """Longest common extensions of ``word`` to either side. Level k ranks the runs of 2 ** k words, so equal ranks are equal runs."""

    def __init__(self, word: np.ndarray, longest: int):
        self.levels = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
        while (step := 1 << len(self.levels)) <= longest and len(word) >= step:
            r = self.levels[-1]
            both = r[: len(word) - step + 1] * np.int64(len(word)) + r[step // 2 : step // 2 + len(word) - step + 1]
            ranks, r = np.unique(both, return_inverse=True)
            if len(ranks) == len(both):
                break  # no run of this length stands twice
            self.levels.append(r.astype(np.int64))

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            same = j < len(r)
            same[same] = r[i[same]] == r[j[same]]
            step = same.astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to and with i equal those up to and with j (i < j)."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r, back = self.levels[k], (1 << k) - 1
            same = i >= back
            same[same] = r[i[same] - back] == r[j[same] - back]
            step = same.astype(np.int64) << k
            i, j, total = i - step, j - step, total + step
        return total


def covered(word: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a run of ``width`` words that stands at two places of its row at least. Runs are compared by a hash, so that
    now and then more words count as covered, never fewer."""
    n = len(word) - width + 1
    mark = np.zeros(len(word) + 1, np.int64)
    if n > 0:
        x, h = _mixed(word.astype(np.uint64) + _ODD), row[:n].astype(np.uint64) * _ODD
        for k in range(width):
            h = (h ^ x[k : k + n]) * _ODD + (h >> np.uint64(29))
        at = np.flatnonzero(row[:n] == row[width - 1 :])
        order = np.argsort(h[at])
        h = h[at][order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        at = at[order[twice]]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + width, -1)
    return np.cumsum(mark[:-1]) > 0


def runs_of(word: np.ndarray, row: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """(start, length, period) of every run in ``word``, an array of word numbers; a run lies within one value of ``row``, whose
    equal values stand together. In the order of start and period."""
    inside = covered(word, row, (min_length + 1) // 2)
    place = np.flatnonzero(inside)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) > 1) | (row[place[1:]] != row[place[:-1]])
    stretch = np.cumsum(new) - 1
    # the stretches one after the other, each behind an end mark
    slot = np.arange(len(place)) + stretch + 1
    total = len(place) + int(stretch[-1]) + 1
    text, origin = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    text[slot], origin[slot] = word[place], place
    marks = np.flatnonzero(origin < 0)
    reverse = np.where(text < 0, -1, text.max() - text)
    apart = text.copy()
    apart[marks] = text.max() + 1 + np.arange(len(marks))  # no extension runs over a mark
    common = Extensions(apart, int(np.bincount(stretch).max()))
    at = np.concatenate((slot, slot))
    period = np.concatenate((lyndon_lengths(text)[slot], lyndon_lengths(reverse)[slot]))
    ok = at + period < total
    at, period = np.divmod(np.unique(at[ok] * np.int64(total) + period[ok]), total)
    start = at - common.before(at - 1, at + period - 1)
    stop = at + period + common.after(at, at + period)
    ok = stop - start >= np.maximum(min_length, 2 * period)
    key, first = np.unique(start[ok] * np.int64(total) + period[ok], return_index=True)
    return origin[key // total], (stop - start)[ok][first], key % total


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word (equal words have equal numbers) and its row; words end at a blank or one of the bytes 9 to 13."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    real = pc.not_equal(flat, "")
    return flat.filter(real).dictionary_encode().indices.to_numpy().astype(np.int64), rows[real.to_numpy(zero_copy_only=False)].astype(np.int64)


def planted(doc_id, n: int) -> np.ndarray | None:
    """Which of its ``n`` words stands at each place of a document of which one in ten repeats its last words with a period; None
    for the nine others, whose words stay. A null id counts as the empty text."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


class Found:
    """The runs of a slice of texts: for each text its words' order (None: as they stand) and its runs."""

    def __init__(self, texts: pa.Array, ids: list, min_length: int, plant: bool):
        word, row = words_of(texts)
        self.counts = np.bincount(row, minlength=len(texts))
        ends = np.cumsum(self.counts)
        self.order: list[np.ndarray | None] = [None] * len(texts)
        if plant:
            for k, (doc_id, n) in enumerate(zip(ids, self.counts.tolist(), strict=True)):
                if (order := planted(doc_id, n)) is not None:
                    self.order[k] = order
                    word[ends[k] - n : ends[k]] = word[ends[k] - n : ends[k]][order]
        start, length, period = runs_of(word, row, min_length)
        at = row[start]
        edges = np.searchsorted(at, np.arange(len(texts) + 1))
        self.start, self.length, self.period = start - (ends - self.counts)[at], length, period
        self.edges = edges.tolist()

    def runs(self, k: int) -> list[tuple[int, int, int]]:
        x = slice(self.edges[k], self.edges[k + 1])
        return list(zip(self.start[x].tolist(), self.length[x].tolist(), self.period[x].tolist(), strict=True))

    def collapsed(self, k: int, text: str | None) -> bytes:
        """The words that stay, joined by one space: all but those behind the first period of a run."""
        words = (text or "").encode().split()  # bytes are split at ASCII white space only
        if self.order[k] is not None:
            words = [words[i] for i in self.order[k].tolist()]
        if runs := self.runs(k):
            gone = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                gone[start + period] += 1
                gone[start + length] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        return b" ".join(words)


def _batches(batches: Iterator[pa.RecordBatch], min_length: int, plant: bool) -> Iterator[tuple[pa.RecordBatch, list, Found]]:
    for b in batches:
        for at, n in slices(b.column("text"), SLICE):
            part = b.slice(at, n)
            ids = part.column("doc_id").to_pylist()
            yield part, ids, Found(part.column("text"), ids, min_length, plant)
    free_memory()


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row for each run of ``docs`` (doc_id, text): doc_id, start (word number from 0), length, period. Null and empty texts have
    none; repeated rows give their runs again; an empty table gives no rows; other columns are not read."""
    base = _columns(docs)

    def find(batches):
        for part, ids, found in _batches(batches, min_length, False):
            rows = [(doc_id, *run) for k, doc_id in enumerate(ids) for run in found.runs(k)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "period"])

    return base.mapInArrow(find, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, the text with only the first period of every run, its words joined by one space, and n_runs, for every row of ``docs``.
    A text without a run is returned as it is; null stays null."""
    base = _columns(docs)

    def cut(batches):
        for part, _, found in _batches(batches, min_length, False):
            texts, n = part.column("text").to_pylist(), np.diff(found.edges)
            out = [found.collapsed(k, t).decode() if n[k] else t for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int64())], ["doc_id", "text", "n_runs"])

    return base.mapInArrow(cut, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text string, n_runs long")


def run_digests(docs: DataFrame, min_length: int = MIN_LENGTH, plant: bool = False) -> DataFrame:
    """For every row of ``docs`` doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without a run) and digests of
    all runs and of the words that stay. With ``plant`` a tenth of the documents, by their id, first get a periodic tail (``planted``).

    A null text has no words; its digests are those of empty strings. Repeated rows and ids give equal rows; an empty table gives no rows;
    other columns are not read, whatever their names."""
    base = _columns(docs)
    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def digest(batches):
        for part, _, found in _batches(batches, min_length, plant):
            rows = []
            for k, text in enumerate(part.column("text").to_pylist()):
                runs = found.runs(k)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                milli = 1000 * length // period if runs else None
                rows.append((len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(found.collapsed(k, text)).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            arrays = [pa.array(c, pa.string() if "sha" in name else pa.int64()) for name, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *names])

    return base.mapInArrow(digest, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {fields}")
