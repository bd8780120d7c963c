"""Words of whole batches of texts, found and hashed with numpy: no Python object for a word.

A word is a run of bytes other than the space and the controls 0x09 to 0x0D.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U = np.uint64
_M1, _M2, _Q = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
#: Words of more bytes are hashed by hashlib one by one.
_LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text): words never cross texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before &= ~edge[:n]
    after &= ~edge[1:]
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, eight bytes at a step."""
    lengths = ends - starts
    h = mix(lengths.astype(U) * _M1)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1)).view(U)[:, 0] if len(data) else np.empty(0, U)
    active, at = np.flatnonzero(lengths <= _LONG), 0
    while len(active):
        rest = lengths[active] - at
        value = wide[starts[active] + at]
        short = rest < 8
        value = np.where(short, value & _TAIL[np.where(short, rest, 0)], value)
        x = (h[active] ^ value) * _M2
        h[active] = x ^ (x >> U(29))
        active, at = active[rest > 8], at + 8
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


@lru_cache(maxsize=64)
def _power(k: int) -> np.uint64:
    return U(pow(int(_Q), k, 1 << 64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, by doubling; the caller leaves out those that cross texts."""
    if len(h) < k:
        return np.empty(0, U)
    have: dict[int, np.ndarray] = {1: h}
    width = 1
    while width * 2 <= k:
        x = have[width]
        have[width * 2] = x[:-width] * _power(width) + x[width:]
        width *= 2
    total, size = have[width], width
    while size < k:
        width = max(w for w in have if w <= k - size)
        tail = have[width][size:]
        total = total[: len(tail)] * _power(width) + tail
        size += width
    return mix(total)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k consecutive values."""
    if len(x) < k:
        return np.empty(0, x.dtype)
    width, out = 1, x
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - width : len(x) - width + 1]) if width < k else out


def owners(first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of k words over n words: (index of the text, whether the window stays in it)."""
    count = max(0, n - k + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    return text, np.arange(count) + k <= first[1:][text]


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in windows of k words that begin at starts."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    steps[k:] -= np.bincount(starts, minlength=n + 1)[: n + 1 - k] if n + 1 > k else 0
    return np.cumsum(steps)[:n] > 0
