"""Encoding a batch of texts by its distinct chunks, with numpy: no Python object for a chunk that was seen before.

Texts fall into chunks that encode on their own.  A worker keeps the results of the chunks it has seen in flat arrays; an
open-addressing table of 64-bit hashes finds them, and the bytes of every chunk found are compared with those of the one
that was kept, so equal hashes of different chunks do no harm.  A worker's table is bounded in chunks and in bytes: a full table
takes no more chunks, and is begun anew once it no longer holds most chunks of the texts at hand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from . import wordhash as W

#: Distinct chunks that a table keeps, their bytes and those of their results, and the longest chunk that is kept.
CHUNKS, TABLE_BYTES, LONGEST = 400_000, 32 << 20, 64
_SLOTS = 1 << 20
#: Below this share of chunks found, a full table is begun anew.
LEAST_FOUND = 0.8

#: 1 letter, 2 digit, 3 mark of ASCII; 0 for all other bytes and the apostrophe, at which contractions begin.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[39] = 2, 1, 1, 0


def turns(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where an ASCII letter, digit or mark follows one of another kind, unless inside of a special string.

    Pre-tokenizers by runs of letters, numbers and other characters begin anew there whatever stands around.
    """
    kind = _CLASS[data]
    out = np.zeros(len(data), bool)
    if len(data):
        out[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        whole = data.tobytes() if special else b""
        for x in special:
            for m in re.finditer(re.escape(x), whole) if x in whole else ():
                out[m.start() + 1 : m.end()] = False
    return out


class Ragged:
    """An array of arrays that grows at its end."""

    def __init__(self, dtype: np.dtype | type) -> None:
        self.flat, self.bounds, self.n = np.empty(1 << 12, dtype), np.zeros(1 << 10, np.int64), 0

    @property
    def nbytes(self) -> int:
        return int(self.bounds[self.n]) * self.flat.itemsize

    def extend(self, parts: list[bytes]) -> None:
        new = np.frombuffer(b"".join(parts), self.flat.dtype)
        begin = int(self.bounds[self.n])
        while begin + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(parts) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[begin : begin + len(new)] = new
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.flat.itemsize
        self.bounds[self.n + 1 : self.n + len(parts) + 1] = begin + np.cumsum(sizes)
        self.n += len(parts)

    def cut(self, n: int) -> None:
        """Forget what follows the first n parts."""
        self.n = n

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(these parts one after another, bounds of each)."""
        begins, sizes = self.bounds[which], self.bounds[which + 1] - self.bounds[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(begins - ends[:-1], sizes)
        at += np.arange(len(at))
        return self.flat[at], ends


class ChunkTable:
    """encode(chunks as str) gives a tuple of results as bytes for each; `kinds` are the numbers they consist of."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[bytes, ...]]], *kinds: np.dtype | type) -> None:
        self.encode, self.kinds = encode, kinds
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.chunks, self.results, self.kept, self.hit = Ragged(np.uint8), [Ragged(k) for k in self.kinds], 0, 1.0

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h & W.U(_SLOTS - 1)).astype(np.int64)
        while len(open_):
            there = self.keys[slot]
            hit = there == h[open_]
            out[open_[hit]] = self.places[slot[hit]]
            on = ~hit & (there != 0)
            open_, slot = open_[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def _file(self, h: np.ndarray, first: int) -> None:
        """Distinct new hashes, of the chunks from `first` on."""
        open_, slot = np.arange(len(h)), (h & W.U(_SLOTS - 1)).astype(np.int64)
        while len(open_):
            empty = self.keys[slot] == 0
            self.keys[slot[empty]] = h[open_[empty]]
            won = empty & (self.keys[slot] == h[open_])
            self.places[slot[won]] = first + open_[won]
            open_, slot = open_[~won], (slot[~won] + 1) & (_SLOTS - 1)

    def _append(self, parts: list[bytes]) -> None:
        self.chunks.extend(parts)
        for store, column in zip(self.results, zip(*self.encode([p.decode() for p in parts]))):
            store.extend(list(column))

    def _differ(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which chunks are not, byte for byte, those that were kept."""
        kept, bounds = self.chunks.take(found)
        odd = np.diff(bounds) != sizes
        if odd.any():
            same = np.flatnonzero(~odd)
            odd[same] = self._differ(data, begins[same], sizes[same], found[same])
            return odd
        if len(kept) != len(data):
            at = np.repeat(begins - bounds[:-1], sizes)
            at += np.arange(len(at))
            data = data[at]
        wrong = np.flatnonzero(kept != data)
        odd[np.searchsorted(bounds, wrong, "right") - 1] = True
        return odd

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of every chunk data[start:end]; places hold until the next call."""
        for store in (self.chunks, *self.results):
            store.cut(self.kept)  # what was kept for one call only
        full = self.kept >= CHUNKS or sum(x.nbytes for x in (self.chunks, *self.results)) > TABLE_BYTES
        if full and self.hit < LEAST_FOUND:
            self._clear()
            full = False
        sizes = ends - starts
        short = np.flatnonzero(sizes <= LONGEST)
        h = np.maximum(W.word_hashes(data, starts[short], ends[short]), W.U(1))
        found = self._find(h)
        lost = np.flatnonzero(found < 0)
        self.hit = 1 - len(lost) / max(1, len(h))
        if len(lost):
            new, at, place = np.unique(h[lost], return_index=True, return_inverse=True)
            room = 0 if full else max(0, CHUNKS - self.kept)  # beyond, new chunks are kept for this call only
            first = self.chunks.n
            some = short[lost[at]]
            self._append([data[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            self._file(new[:room], first)
            self.kept = first + min(room, len(new))
            found[lost] = first + place
        out = np.full(len(starts), -1, np.int64)
        out[short] = np.where(self._differ(data, starts[short], sizes[short], found), -1, found)
        alone = np.flatnonzero(out < 0)
        if len(alone):
            out[alone] = self.chunks.n + np.arange(len(alone))
            self._append([data[a:b].tobytes() for a, b in zip(starts[alone].tolist(), ends[alone].tolist())])
        return out
