"""Byte-level BPE of whole texts through the tokenizers library, a distinct chunk at a time.

The pre-tokenizer of byte-level files always begins anew at a single space or line feed between two other characters, after
such a line feed, and where ASCII letters, digits and marks meet, so a text falls there into chunks that encode on their
own (see chunktable).  New chunks go to the library many at a time, as lines of one text: a line feed between two of them is a
token by itself, at which the ids fall apart again.  A tokenizer file with another pre-tokenizer, a normalizer, or added
tokens that reach over blanks gets whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .chunktable import ChunkTable, turns
from .common import slices

#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: New chunks in one text.
LINES = 256
#: Bytes that are surely no white space, by themselves.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:] = True
#: First bytes of white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = re.compile(r" ?\S+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _solid(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to no white space: not U+0085, A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F, 3000 either."""
    solid = _SOLID[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8))
        a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        for k in range(3):
            hit = lead[two | three] + k if k < 2 else lead[three] + k
            solid[hit] = False
    return solid


def cuts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where chunks begin, in order: at texts that aren't empty, and inside of texts as said above."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    if n:
        solid, feed = _solid(data), data == 0x0A
        blank = feed | (data == 0x20)
        blank[0] = blank[-1] = False
        blank[1:-1] &= solid[:-2] & solid[2:] & ~begins[1 : n - 1] & ~begins[2:n]
        begins[:n] |= blank | turns(data, special)
        begins[1:n] |= (blank & feed)[:-1]
    return np.flatnonzero(begins[:n])


class ByteEncoder:
    """Encodes texts to ids of two bytes where the vocabulary allows it, else four."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = all(not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        self.special = [x["content"].encode() for x in added]
        self.chunked = usual and plain and not spec.get("normalizer")
        self.table = ChunkTable(self._encode, self.dtype)

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[tuple[bytes]]:
        out: list[bytes | None] = [None] * len(chunks)
        odd = list(range(len(chunks)))
        if self.chunked and len(self.feed) == 1:
            match = _PLAIN.fullmatch
            plain = [k for k, c in enumerate(chunks) if match(c)]
            odd = [k for k, c in enumerate(chunks) if not match(c)] if len(plain) < len(chunks) else []
            groups = [plain[k : k + LINES] for k in range(0, len(plain), LINES)]
            for group, got in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([chunks[k] for k in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(got.ids, self.dtype)
                ends = (np.flatnonzero(ids == self.feed[0]) * self.dtype.itemsize).tolist()
                if len(ends) != len(group) - 1:
                    odd += group
                    continue
                data, begin = ids.tobytes(), 0
                for k, end in zip(group, [*ends, len(data)]):
                    out[k] = data[begin:end]
                    begin = end + self.dtype.itemsize
        for k, got in zip(odd, self._one_by_one([chunks[k] for k in odd])):
            out[k] = got
        return [(x,) for x in out]

    def runs(self, column: pa.Array | pa.ChunkedArray, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids of these rows one after another, bounds of each row); null texts are empty.

        The ids are those of the library's encode(text, add_special_tokens=False), and end_id after each text.
        """
        for at, to, data, offsets in slices(column, SLICE):
            starts = cuts(data, offsets, self.special) if self.chunked else np.unique(offsets[:-1][np.diff(offsets) > 0])
            places = self.table.lookup(data, starts, np.append(starts[1:], len(data)))
            ids, ends = self.table.results[0].take(places)
            bounds = ends[np.searchsorted(starts, offsets)]
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            yield at, to, ids, bounds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        return [ids[a:b] for _, _, ids, bounds in self.runs(pa.array(texts, pa.large_string())) for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One for each worker process and file."""
    return ByteEncoder(path)
