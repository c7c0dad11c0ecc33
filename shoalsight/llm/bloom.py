"""A set of 64-bit keys as a bitmap of bounded size.

The bitmap is built by Spark (positions of set bits are or-ed into words, so the driver receives at most
``max_bits / 64`` words whatever the number of keys) and broadcast. Members are always found; with more keys than the
bound allows for, more other keys pass, which costs work downstream and never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        found = np.ones(len(k), bool)
        for shift in (0, 18, 36):
            at = (k >> np.uint64(shift)) & self.mask
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom_of(keys: DataFrame, column: str, n: int, bits_per_key: int = 16, max_bits: int = 1 << 28) -> Bloom:
    """``n``: the number of keys; keys must be well mixed hashes."""
    bits = 1 << 12
    while bits < min(n * bits_per_key, max_bits):
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 18, 36)])).alias("at")
    words = keys.select(at).groupBy(F.shiftrightunsigned("at", 6).alias("w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Bloom(out)
