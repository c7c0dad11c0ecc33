"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is one aggregation and one join, so no task holds a vertex's neighbours as a list; a hub's rows are split by
Spark's skew handling. Every step's result is a written table, deleted when the next one is there. The number of rounds grows with the logarithm of the
graph; reaching ``max_rounds`` raises instead of returning labels that may be wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each vertex's larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v. Links each vertex and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): each vertex of ``edges`` (comparable ids) with the least vertex it reaches. Loops are vertices too."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    loops = pairs.filter("a = b").select(F.col("a").alias("id")).distinct()
    now = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        before, now = now, written(_small_star(_large_star(now)), "stars")
        forget(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    labels = labels.union(roots)
    alone = loops.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.union(alone)
