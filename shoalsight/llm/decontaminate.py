"""Benchmark decontamination by spaced-seed hashing.

Words are compared with A-Z lower-cased and ASCII punctuation removed. A seed is a fixed mask over ``len(mask)``
consecutive words that ignores the positions marked 0, so a hit survives substitutions there. All masks are hashed at
every position of the test items and of the documents; documents' hashes are joined with the distinct test hashes
(broadcast while their count is under ``broadcast_rows``, else shuffled), the hits with the items' positions, and each
(document, item, diagonal) is verified word by word: an overlap counts when some ``window`` aligned words of the item
(the whole item where it is shorter) agree in at least ``min_share`` of their positions. With the values given here every
such overlap has a seed; a lower ``min_share`` or ``whole_under`` or a shorter ``window`` needs masks of its own. Items of
fewer than ``whole_under`` words are searched whole: all their words in a row, found by a mask of their own length.

Defined results: null and blank texts hit nothing, items without words are in no document, repeated rows are reported
once for each (doc_id, item_id), a null doc_id is reported as null; ``drop_contaminated`` judges each row by its own text,
so rows without an id or with a shared one stay if they are clean. Item ids may repeat; the best overlap counts. Texts
are searched whole, however long. Columns beside doc_id, text, item_id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keep_where, let, row_key, words, written

# The masks. Whatever words are substituted in a window of 8 to 13 words, as long as 75 % of it (rounded
# up) stay, one of these seeds is left whole within it; so no overlap that the verification accepts is missed.
MASKS = ("11101", "100111", "1101001")
#: Most words of 64 bits of the bitmap of test seeds; with more seeds all of a document's seeds are joined.
MAX_WORDS = 1 << 15
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_words(text: Column) -> Column:
    return words(F.translate(text, UPPER + PUNCTUATION, LOWER))


def seeds_of(df: DataFrame, keys: list[str], text: Column, masks: dict[str, int], bitmap: list[int] | None = None) -> DataFrame:
    """keys, h, pos (first word): every seed of the text's words; ``masks`` names each mask's number. With ``bitmap`` only
    the seeds whose bit is set."""

    def of(mask: str) -> Column:
        on = [k for k, c in enumerate(mask) if c == "1"]
        starts = F.slice("_h", 1, F.greatest(F.size("_h") - (len(mask) - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(F.lit(masks[mask]), *[F.get(F.col("_h"), i + k) for k in on]))

    # The bitmap becomes one literal of the plan: a constant expression, folded by the optimiser.
    words = F.from_json(F.lit(str(bitmap)), "array<bigint>") if bitmap else None

    def set_(h: Column) -> Column:
        if words is None:
            return F.lit(True)
        return F.getbit(F.get(words, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(len(bitmap) - 1)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    hashed = df.select(*keys, F.transform(clean_words(text), lambda w: F.xxhash64(w)).alias("_h"))
    hashed = hashed.select(*keys, *[of(mask).alias(f"_s{m}") for mask, m in masks.items()])
    found = [F.array_compact(F.transform(f"_s{m}", lambda h, i: F.when(set_(h), F.struct(h.alias("h"), i.alias("pos"))))) for m in masks.values()]
    return hashed.select(*keys, F.explode(F.concat(*found)).alias("s")).select(*keys, "s.h", "s.pos")


def seed_bitmap(known: DataFrame, n: int, max_words: int) -> list[int] | None:
    """One bit for each of ``n`` seeds, eight bits a seed or more; None where that takes more than ``max_words``."""
    size = 64
    while size * 8 < n:
        size *= 2
    if size > max_words:
        return None
    at = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(size - 1))
    rows = known.groupBy(at.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).collect()  # at most max_words
    out = [0] * size
    for r in rows:
        out[r["w"]] = r["b"]
    return out


def _leaks(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], window: int, min_share: float, whole_under: int, broadcast_rows: int) -> DataFrame:
    """_id, _th, doc_id, item_id, matched, item_words: a row for each verified diagonal."""
    tests = items.select("item_id", clean_words(F.col("text")).alias("iw")).filter(F.size("iw") > 0)
    tests = written(tests.withColumn("ik", F.xxhash64("item_id", "iw")), "items")
    short = sorted(r[0] for r in tests.filter(F.size("iw") < whole_under).select(F.size("iw")).distinct().collect())  # under whole_under rows
    numbers = {mask: m for m, mask in enumerate([*masks, *("1" * n for n in short if "1" * n not in masks)])}
    spaced = {mask: numbers[mask] for mask in masks}
    text = F.array_join("iw", " ")
    postings = seeds_of(tests.filter(F.size("iw") >= whole_under), ["ik"], text, spaced)
    for n in short:
        postings = postings.union(seeds_of(tests.filter(F.size("iw") == n), ["ik"], text, {"1" * n: numbers["1" * n]}))
    postings = written(postings.withColumnRenamed("pos", "ipos"), "seeds")
    known = postings.select("h").distinct()
    n = postings.count()
    docs = docs.select("doc_id", *row_key(), "text")
    hits = seeds_of(docs, ["_id", "_th"], F.col("text"), numbers, seed_bitmap(known, n, MAX_WORDS))
    hits = hits.join(F.broadcast(known) if n <= broadcast_rows else known, "h", "left_semi")
    found = hits.join(postings, "h").select("_id", "_th", "ik", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
    found = written(found, "seed-hits").join(tests, "ik").select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), "ik", "item_id", "iw", "diag")
    joined = docs.join(found, docs["_id"].eqNullSafe(found["_fid"]) & (docs["_th"] == found["_fth"]))
    rows = joined.select("_id", "_th", "doc_id", "item_id", "iw", "diag", "text")
    # Equal words along the diagonal, as 0/1 for each word of the item; words beyond the document's ends are 0. The
    # document's words are bound once: inside the lambda they would be split again for each word.
    same = let(
        clean_words(F.col("text")),
        lambda dw: F.transform("iw", lambda w, j: F.when(F.get(dw, (F.col("diag") + j).cast("int")) == w, 1).otherwise(0)),
    )
    span = F.least(F.lit(window), F.size("iw"))
    rows = rows.select("_id", "_th", "doc_id", "item_id", F.size("iw").alias("item_words"), span.alias("span"), same.alias("same"))
    # A running sum over the last `span` words; its maximum is the best window.
    best = F.aggregate(
        F.transform("same", lambda x, j: F.struct(x.alias("x"), F.when(j >= F.col("span"), F.get("same", (j - F.col("span")).cast("int"))).otherwise(0).alias("out"))),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("m")),
        lambda a, p: F.struct((a["s"] + p["x"] - p["out"]).alias("s"), F.greatest(a["m"], a["s"] + p["x"] - p["out"]).alias("m")),
        lambda a: a["m"],
    )
    need = F.when(F.col("item_words") < whole_under, F.col("item_words")).otherwise(F.ceil(F.col("span") * F.lit(min_share)))
    return keep_where(rows.withColumn("matched", best), F.col("matched") >= need).select("_id", "_th", "doc_id", "item_id", "matched", "item_words")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = 13,
    min_share: float = 0.75,
    whole_under: int = 8,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, matched (equal words in the best window), item_words: one row for each leak."""
    rows = _leaks(docs, items, masks, window, min_share, whole_under, broadcast_rows)
    return rows.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"))


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = 13,
    min_share: float = 0.75,
    whole_under: int = 8,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """``docs`` without the rows whose text holds a test item."""
    bad = _leaks(docs, items, masks, window, min_share, whole_under, broadcast_rows).select("_id", "_th").distinct()
    keyed = docs.withColumns(dict(zip(["_kid", "_kth"], row_key(), strict=True)))
    at = keyed["_kid"].eqNullSafe(bad["_id"]) & (keyed["_kth"] == bad["_th"])
    return keyed.join(bad, at, "left_anti").drop("_kid", "_kth")
