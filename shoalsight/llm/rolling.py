"""Vectorised hashing of windows over sequences of bytes or words, and content-chosen anchors.

A sequence of 64-bit values is hashed by prefix sums of value * B**i modulo 2**64, so the hash of any window is a
difference times a power, then mixed. Values of bytes come from a fixed random table; values of words are the mixed
hashes of their bytes with their length.

An anchor of a window of W values is its k-gram with the least hash (the leftmost of equal ones). It depends on the
window's content alone, so equal windows have equal anchors at equal offsets, and a sequence has about 2 / (W - k)
anchors per value: a sparse set of positions through which every repeated window can be found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pows = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Values handled at a time; a longer sequence is cut into overlapping parts.
PART = 1 << 18
_LOW = np.uint64((1 << 24) - 1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_B, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _pows[k] = np.multiply.accumulate(p)
    return _pows[0][:n], _pows[1][:n]


class Rolling:
    """Hashes of windows of ``values``."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self.inv = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64) * _C3)

    def all(self, k: int) -> np.ndarray:
        """Of every window of k values."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n] + np.full(1, k, np.uint64) * _C3)


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as bytes."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_values(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word; long texts are hashed in parts so that the work arrays stay small."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + PART, side="right")), i + 1)
        a, b = start[i], end[j - 1]
        out[i:j] = Rolling(byte_values(raw[a:b])).of(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by block-wise prefix and suffix minima."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


@dataclass
class Anchors:
    """Of one part of a sequence: a row stands for the neighbouring windows that share one anchor, ``count`` of them from
    window ``first`` on, the anchor ``offset`` values after the first one's start. Context is all that these windows cover."""

    gram: np.ndarray
    context: np.ndarray
    first: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    place: np.ndarray
    roll: Rolling

    def __iter__(self):
        return iter((self.gram, self.context, self.first, self.count, self.offset))

    def piece(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """Hashes of the values from ``start`` to ``end`` relative to the anchors."""
        return self.roll.of(self.place[rows] + start, self.place[rows] + end)


def _chosen(roll: Rolling, window: int, k: int, starts: np.ndarray, shift: int) -> Anchors:
    """The anchors of the windows at ``starts``, which rise; neighbours share a row only where their starts are neighbours."""
    grams = roll.all(k)
    keyed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keyed, window - k + 1)[starts] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    where = np.flatnonzero(new)
    first, count, q = starts[where], np.diff(np.append(where, len(at))), at[where]
    context = mix(roll.of(first, first + count - 1 + window) + (q - first).astype(np.uint64) * _C3)
    return Anchors(grams[q], context, first + shift, count, q - first, q, roll)


def anchors(values: np.ndarray, window: int, k: int, of=lambda part: part, bounds: np.ndarray | None = None):
    """``of`` turns a part of ``values`` into 64-bit values. Yields the Anchors of each part of the sequence; with
    ``bounds`` (starts and end) those of several short sequences that follow each other, none across a bound."""
    if bounds is not None and len(bounds) > 2:
        held = np.maximum(np.diff(bounds) - window + 1, 0)
        starts = np.arange(held.sum()) + np.repeat(bounds[:-1] - np.cumsum(held) + held, held)
        if len(starts):
            yield _chosen(Rolling(of(values)), window, k, starts, 0)
        return
    n = len(values)
    for a in range(0, n - window + 1, PART):
        b = min(a + PART + window - 1, n)
        yield _chosen(Rolling(of(values[a:b])), window, k, np.arange(b - a - window + 1), a)
