"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by md5(doc_id), form one stream that is cut into blocks of equal
numbers of tokens; a source needs as many slots as blocks reach its target. Slot k of the mix is the golden-ratio point
frac(k * 0.618...), in exact integer arithmetic, mapped through the cumulative shares of the needs. The points decide
which source each slot belongs to: the slots of a source are ranked, and slot r takes block r modulo the stream's blocks,
until the source has what it needs, so any prefix of the mix is close to the shares. Of N needed slots each source finds
its own among the first 2.7 N points, because N points of this sequence leave no gap over 1.9 / N. The last slot of a
source is cut where its target is reached.

Targets: sources in code-point order, null last, weigh ``weights`` in rotation and share the sum of all sizes; a
target stops at ``max_repeats`` times its source's size and the excess is shared again by weight (water filling).

Prefix sums and ranks are taken in two levels (totals of hash buckets, of ranges of sources or of slot ranges first,
then inside each), so no window holds one source's rows or all sources. Defined results: a null text has size 0; documents of size 0 are never taken; a
null doc_id is shuffled as the empty string; repeated rows are documents of their own; texts of any length are counted
whole. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered, prefix_sums
from .common import words, written

#: Points are multiples of GOLDEN modulo WHOLE; their ratio is the golden one.
WHOLE = 1 << 62
GOLDEN = 2850178704830799621


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: sid, source, source_size, weight, target. ``sizes``: source, size."""
    src = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    src = numbered(src, [F.col("source").asc_nulls_last()], "sid").withColumn("sid", (F.col("sid") - 1).cast("long"))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    order = [F.col("_ratio").asc(), F.col("sid").asc()]
    src = prefix_sums(src.withColumn("_ratio", F.col("source_size") / F.col("weight")), order, {"_less": F.col("source_size"), "_light": F.col("weight")})
    size, weight = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    src = src.withColumns({"_rest": F.lit(size).cast("long") - max_repeats * F.col("_less"), "_weights": F.lit(weight).cast("long") - F.col("_light")})
    src = src.withColumn("_capped", max_repeats * wide("source_size") * wide("_weights") <= wide("_rest") * wide("weight"))
    level = src.filter(~F.col("_capped")).agg(F.min_by(F.struct("_rest", "_weights"), F.struct("_ratio", "sid"))).first()[0]
    rest, weights_ = (F.lit(int(x)).cast("long") for x in level or (0, 1))
    target = F.when(F.col("_capped"), (max_repeats * F.col("source_size")).cast("double")).otherwise((rest * F.col("weight")).cast("double") / weights_.cast("double"))
    return src.select("sid", "source", "source_size", "weight", target.alias("target"))


def streams(docs: DataFrame, targets: DataFrame, bucket_digits: int) -> DataFrame:
    """Adds sid and the document's start in its source's shuffled stream. ``docs``: doc_id, source, size, key."""
    t = targets.select(F.col("sid"), F.col("source").alias("_source"))
    rows = docs.join(t, docs["source"].eqNullSafe(t["_source"])).drop("_source")
    rows = rows.withColumn("_bucket", F.substring("key", 1, bucket_digits))
    buckets = rows.groupBy("sid", "_bucket").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy("sid", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(buckets, ["sid", "_bucket"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_bucket", "_base", "_in")


def point(slot: Column) -> Column:
    """Golden-ratio points of 0 to 1, equal to the last digit at any slot."""
    wide = slot.cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(19,0)")
    return (wide % F.lit(WHOLE).cast("decimal(19,0)")).cast("long").cast("double") / float(WHOLE)


def schedule(targets: DataFrame, block: int, chunk: int = 65536) -> DataFrame:
    """The mix: slot, sid, rank, block_no, used (tokens). Slots are in mixing order; numbers are left out where a point falls to a source that has all it needs."""
    spark = targets.sparkSession
    goal = F.floor(F.col("target") + 0.5)
    n = F.col("source_size")
    blocks = F.ceil(n / block)
    src = targets.filter((n > 0) & (goal > 0)).select(
        "sid", n.alias("n"), goal.alias("goal"), blocks.alias("blocks"),
        (F.floor(goal / n) * blocks + F.ceil((goal % n) / block)).cast("long").alias("need"),
    )
    src = prefix_sums(src, [F.col("sid").asc()], {"before": F.col("need")})
    total, sources = src.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    src = src.withColumns({"low": F.col("before") / F.lit(max(total, 1)), "high": (F.col("before") + F.col("need")) / F.lit(max(total, 1))})
    cells = max(1024, 4 * sources)
    grid = src.select("sid", "low", "high", "need", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    points = spark.range((27 * total + 9) // 10 + 8 if total else 0).withColumnRenamed("id", "slot").withColumn("x", point(F.col("slot")))
    picked = points.withColumn("cell", F.floor(F.col("x") * cells)).join(grid, "cell").filter((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
    picked = picked.select("slot", "sid", "need", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = picked.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("c").over(ahead), F.lit(0))).drop("c")
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = picked.withColumn("r", F.row_number().over(inside) - 1).join(bases, ["sid", "chunk"]).withColumn("rank", F.col("base") + F.col("r"))
    taken = ranked.filter(F.col("rank") < F.col("need")).select("slot", "sid", "rank").join(src.select("sid", "n", "goal", "blocks"), "sid")
    no = F.col("rank") % F.col("blocks")
    before = F.floor(F.col("rank") / F.col("blocks")) * F.col("n") + no * block
    used = F.least(F.lit(block), F.col("n") - no * block, F.col("goal") - before)
    return taken.select("slot", "sid", "rank", no.alias("block_no"), used.cast("long").alias("used"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, block: int = 1024, bucket_digits: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (of the mix, null where nothing is taken): one row for
    each row of ``docs`` (doc_id, source, text)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key")), "mix-sizes")
    targets = written(source_targets(base, weights, max_repeats), "mix-targets")
    rows = written(streams(base, targets, bucket_digits), "mix-streams")
    per_block = schedule(targets, block).groupBy("sid", "block_no").agg(
        F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("slot"), F.max("used").alias("full"), F.min("used").alias("part")
    )
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = rows.filter(F.col("size") > 0).withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    a = F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0))
    b = F.least(F.col("start") + F.col("size") - F.col("block_no") * block, F.lit(block))
    # Of a block's slots at most one, the source's last, is shorter than the block.
    over = lambda used: F.greatest(F.least(b, used) - a, F.lit(0))
    got = (F.col("n_slots") - 1) * over(F.col("full")) + over(F.col("part"))
    taken = cut.join(per_block, ["sid", "block_no"]).groupBy("sid", "start", F.col("doc_id").alias("_id")).agg(F.sum(got).alias("taken"), F.min(F.when(got > 0, F.col("slot"))).alias("first_slot"))
    taken = taken.withColumnsRenamed({"sid": "_sid", "start": "_start"})
    at = (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") > 0)
    out = rows.join(taken, at, "left").select("doc_id", "sid", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    t = targets.select("sid", "source", "source_size", "target")
    return out.join(t, "sid").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` of which the mix takes words, with size, source_size, target and taken. Rows that share a doc_id and a
    source are told apart by their size, and rows equal in all three share one fate."""
    got = mix(docs, **options).filter("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size")
    got = got.agg(*[F.max(c).alias(c) for c in ("source_size", "target", "taken")])
    sized = docs.drop("size", "source_size", "target", "taken").withColumn("_size", F.size(words(F.col("text"))).cast("long"))
    at = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("size"))
    return sized.join(got, at).drop("_id", "_source", "_size")
