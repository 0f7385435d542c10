"""Token ids of whole texts by public tokenizers, with a bounded memory of the chunks already seen in a worker.

A text is cut at places that no token crosses, so a chunk has the same ids wherever it stands. The file of
a tokenizer is a parameter; it is opened once in each Python worker.
"""

from __future__ import annotations

import json
import re
from functools import cache, cached_property

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Chunks remembered in a worker (about 200 bytes each); later ones are encoded each time.
REMEMBERED = 200_000

#: Words of Latin letters before a blank, a line end, a full stop or a comma; else all up to the next blank or line end.
_CHUNK = re.compile("[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,])|[ \n]*[^ \n]+|[ \n]+")
#: Texts with other white space, which stands in runs with blanks, are encoded in one piece.
_WHOLE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The byte strings of a byte-level BPE vocabulary by id; ids stand in the order of the merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}


#: Fixed value: the split of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Byte-level BPE: the little-endian 32-bit ids of a text."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = _ranks({t: i for t, i in spec["model"]["vocab"].items() if t not in self.special})
        self.encode = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """For texts with odd white space or special strings; rarely needed."""
        return Tokenizer.from_file(self.path)

    def chunk(self, chunk: str) -> bytes:
        out = np.array(self.encode(chunk), "<u4").tobytes()
        if len(self.seen) < REMEMBERED:
            self.seen[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if _WHOLE.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        seen, chunk = self.seen.get, self.chunk
        return b"".join([seen(c) or chunk(c) for c in _CHUNK.findall(text)])


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
