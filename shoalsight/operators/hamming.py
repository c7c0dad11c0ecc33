"""Hamming-distance similarity join of 256-bit hashes held as BIGINT words.

The join is exact without comparing all pairs: the bits are cut into bands of at least ``NARROWEST`` bits, and two hashes
at distance d differ in at most d // n bits of one of n bands. An equi-join on (band number, band bits) finds equal
bands; where one bit may differ one side probes all its neighbours, where two may differ both sides do, because two bands
at distance 2 share a neighbour. Wider distances would need bands that select nothing and are refused. Equal hashes are
collapsed before the join and expanded by groups after it, so copies do not multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def band_bits(words: list[Column], low: int, high: int) -> Column:
    """Bits low..high-1 (at most 63) of the concatenated words, bit 0 the highest of the first word."""
    out = F.lit(0).cast("long")
    for k, w in enumerate(words):
        a, b = max(low, 64 * k), min(high, 64 * k + 64)
        if a < b:
            part = F.shiftrightunsigned(w, 64 * k + 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))
            out = F.shiftleft(out, b - a).bitwiseOR(part)
    return out


def bands(words: list[Column], distance: int) -> Column:
    """Array of (band number, bits) of ``distance`` + 1 bands of nearly equal widths."""
    bits, n = 64 * len(words), distance + 1
    cuts = [bits * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("band"), band_bits(words, cuts[k], cuts[k + 1]).alias("bits")) for k in range(n)])


#: Bits of a band; with fewer, too many unlike hashes share a band.
NARROWEST = 24


def band_plan(bits: int, distance: int) -> tuple[int, int]:
    """(bands, bits that may differ in one of them)."""
    n = bits // NARROWEST
    if n < 1 or distance // n > 2:
        raise ValueError(f"no selective bands for distance {distance} over {bits} bits")
    n = min(n, max(distance + 1, -(-bits // 63)))  # a band is held in a long
    return n, distance // n


def probes(words: list[Column], distance: int) -> tuple[Column, Column]:
    """For each side of the join an array of (band, bits) to meet on."""
    total = 64 * len(words)
    n, radius = band_plan(total, distance)
    cuts = [total * k // n for k in range(n + 1)]
    exact = [F.struct(F.lit(k).alias("band"), band_bits(words, cuts[k], cuts[k + 1]).alias("bits")) for k in range(n)]

    def near(k: int) -> Column:
        flips = F.sequence(F.lit(0), F.lit(cuts[k + 1] - cuts[k] - 1))
        return F.transform(flips, lambda i: F.struct(F.lit(k).alias("band"), exact[k]["bits"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("bits")))

    plain = F.array(*exact)
    wide = F.concat(plain, *[near(k) for k in range(n)]) if radius else plain
    return wide, wide if radius == 2 else plain


def hamming_pairs(df: DataFrame, key: str, words: list[str], distance: int, also: list[str] = (), also_distance: int = 0) -> DataFrame:
    """(l, r, distance) of distinct hash values within ``distance`` by ``words`` and within ``also_distance`` by the words
    ``also``; l < r by ``key``, the least key of each value."""
    values = df.groupBy(*words, *also).agg(F.min(key).alias("k"))
    left, right = probes([F.col(w) for w in words], distance)
    l = values.select(F.col("k").alias("l"), F.explode(left).alias("b")).select("l", "b.band", "b.bits")
    r = values.select(F.col("k").alias("r"), F.explode(right).alias("b")).select("r", "b.band", "b.bits")
    met = l.join(r, ["band", "bits"]).filter(F.col("l") != F.col("r")).select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct()
    side = lambda n: values.select(F.col("k").alias(n), *[F.col(w).alias(f"{n}_{w}") for w in [*words, *also]])
    apart = lambda names: hamming([F.col(f"l_{w}") for w in names], [F.col(f"r_{w}") for w in names])
    near = met.join(side("l"), "l").join(side("r"), "r").withColumn("distance", apart(words)).filter(F.col("distance") <= distance)
    if also:
        near = near.filter(apart(also) <= also_distance)
    return near.select("l", "r", "distance")


def copies(df: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(l, r): each row with the least key that has the same hash."""
    first = df.groupBy(*words).agg(F.min(key).alias("l"))
    return df.select(F.col(key).alias("r"), *words).join(first, words).select("l", "r")
