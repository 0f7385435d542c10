"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the longest prefixes in the model's compiled character map while the source byte of
every normalised character is recorded; pieces found in the normalised text are then projected to byte spans
of the original. Normalised text holds blanks where the model shows its white-space mark.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from worklens.llm.common import with_fields

MARK = "▁"
#: Chunks remembered in a worker (about 400 bytes each); later ones are encoded each time.
REMEMBERED = 250_000
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"


class CharMap:
    """The compiled character map: a double-array trie of byte strings, each with its replacement."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest entry that ``data`` has at ``at``, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None

        def children(node: int) -> int:
            unit = units[node]
            return node ^ ((unit >> 10) << ((unit & 512) >> 6))

        node = children(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if units[node] & 0x800000FF != data[i]:
                break
            has_value = units[node] >> 8 & 1
            node = children(node)
            if has_value:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Encoded(NamedTuple):
    ids: list[bytes]  # decimal ids, joined by blanks, by chunk
    count: int
    spans: np.ndarray  # source byte offsets: piece i covers spans[i] to spans[i + 1]
    decoded: bytes


class Model:
    def __init__(self, path: str):
        spec = model_pb2.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        n = spec.normalizer_spec
        self.map, self.dummy, self.trim = CharMap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces
        self.suffix, self.user = spec.trainer_spec.treat_whitespace_as_suffix, [p.piece for p in spec.pieces if p.type == 4]
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, True
        self.chunks = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.end = self.whole.eos_id()
        self.bytes, self.chars = [], []  # what a piece decodes to, and its normalised characters
        for i, p in enumerate(spec.pieces):
            byte = p.type == 6
            self.bytes.append(bytes([int(p.piece[3:5], 16)]) if byte else self.whole.decode([i]).encode() if p.type in (2, 3) else p.piece.replace(MARK, " ").encode())
            self.chars.append(0 if byte else len(p.piece))
        self.fallback = spec.trainer_spec.byte_fallback
        self.cut = self._cut([p.piece.replace(MARK, " ") for p in spec.pieces if p.type in (1, 4)])
        self.seen: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _cut(self, known: list[str]) -> re.Pattern:
        """Chunks end only where no piece has the two characters side by side: before blanks, around line ends, and
        between a letter and some marks. A model with pieces across blanks gets its texts in one chunk."""
        pairs = {(p[i], p[i + 1]) for p in known for i in range(len(p) - 1)}
        if self.suffix or any(b == " " != a or "\n" in (a, b) for a, b in pairs):
            return re.compile(r"(?s).+")
        before = {b for a, b in pairs if re.fullmatch(_LETTER, a)}
        marks = "".join(re.escape(c) for c in ".,;:!?%#*$&|()\"" if c not in before)
        word = f" *{_LETTER}+(?=[{marks}])|" if marks else ""
        return re.compile(rf"{word} *[^ \n]+| +|\n")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte where each of its characters begins, with the end after them."""
        data = text.encode()
        if not self.map.units and not self.trim and not self.user:
            raw = np.frombuffer(data, np.uint8)
            starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            if not self.dummy or not text:
                return text.replace(MARK, " "), starts
            return " " + text.replace(MARK, " "), np.concatenate(([0], starts))
        out: list[str] = []
        where: list[int] = []

        def step(at: int) -> tuple[int, str]:
            for u in self.user:
                if data.startswith(u.encode(), at):
                    return len(u.encode()), u
            if hit := self.map.longest(data, at):
                return hit[0], hit[1].decode()
            size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            return size, data[at : at + size].decode()

        at = 0
        while self.trim and at < len(data) and (s := step(at))[1] == " ":
            at += s[0]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            out, where = [" "], [at]
        blank = self.trim
        while at < len(data):
            size, part = step(at)
            if blank:
                part = part.lstrip(" ")
            out.extend(part)
            where.extend([at] * len(part))
            blank = self.trim and part.endswith(" ") if part else blank
            at += size
        while self.trim and out and out[-1] in (" ", MARK):
            out.pop()
            at = where.pop()
        if self.dummy and self.suffix:
            out.append(" ")
            where.append(at)
        return "".join(out).replace(MARK, " "), np.array([*where, at], np.int64)

    def _learn(self, chunk: str, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        chars, at, wait = np.zeros(len(ids), np.int32), 0, 0
        for k, i in enumerate(ids):
            if self.fallback and self.chars[i] == 0:  # the last byte of a character holds it
                b = self.bytes[i][0]
                wait = wait - 1 if wait else 0 if b < 128 else 1 if b < 224 else 2 if b < 240 else 3
                chars[k] = not wait
            elif i == self.chunks.unk_id():
                later = sum(self.chars[j] for j in ids[k + 1 :])
                chars[k] = max(1, len(chunk) - at - later)
            else:
                chars[k] = self.chars[i]
            at += int(chars[k])
        return b" ".join(b"%d" % i for i in ids), chars.tobytes(), b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> Encoded:
        norm, align = self.normalise(text)
        parts = self.cut.findall(norm)
        seen = self.seen
        if new := list({c for c in parts if c not in seen}):
            learned = {c: self._learn(c, i) for c, i in zip(new, self.chunks.encode(new, num_threads=1), strict=True)}
            got = [seen[c] if c in seen else learned[c] for c in parts]
            if len(seen) < REMEMBERED:
                seen.update(learned)
        else:
            got = list(map(seen.__getitem__, parts))
        chars = np.frombuffer(b"".join([g[1] for g in got]), np.int32)
        spans = align[np.concatenate(([0], np.cumsum(chars)))] if len(chars) else align[:1]
        decoded = b"".join([g[2] for g in got])
        return Encoded([g[0] for g in got], len(chars), spans, decoded.removeprefix(b" ") if self.dummy and not self.suffix else decoded)


@cache
def model(path: str) -> Model:
    return Model(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (the end id last), and for each id but the end id its source bytes: starts and ends. A null text is the
    empty text, whose only id is the end id; repeated rows repeat; other columns are not read."""

    def make(batches):
        m = model(path)
        for b in batches:
            rows = [m.encode(t.as_py() or "") for t in b.column("text")]
            ids = [[*map(int, b" ".join(r.ids).split()), m.end] for r in rows]
            arrays = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), *(pa.array([s.tolist() for s in x], pa.list_(pa.int64())) for x in ([r.spans[:-1] for r in rows], [r.spans[1:] for r in rows]))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "starts", "ends"])

    ids = _texts(docs)
    return ids.mapInArrow(make, with_fields(ids.select("doc_id"), "ids array<int>, starts array<long>, ends array<long>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give the empty text."""

    def make(batches):
        m = model(path)
        for b in batches:
            texts = [m.whole.decode(i.as_py() or []) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(make, with_fields(encoded.select("doc_id"), "text string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The digests of ``encode`` and ``decode`` without moving the ids out of the worker: doc_id, n_tokens, ids_sha256 and
    decoded_sha256, and of the spans their crc32 (little-endian 64-bit bounds) and the source bytes that they cover."""

    def make(batches):
        m = model(path)
        for b in batches:
            rows = []
            for t in b.column("text"):
                e = m.encode(t.as_py() or "")
                ids = hashlib.sha256(b" ".join([*e.ids, b"%d" % m.end])).hexdigest()
                spans = zlib.crc32(e.spans.astype("<i8").tobytes())
                rows.append((e.count + 1, ids, hashlib.sha256(e.decoded).hexdigest(), spans, int(e.spans[-1] - e.spans[0])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns, kinds)], schema.names)

    ids = _texts(docs)
    schema = with_fields(ids.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, spanned_bytes long")
    return ids.mapInArrow(make, schema)
