"""Aggregations over groups: best member, medoid, cohesion, people, modes, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nearest_rank
from .ranks import numbered
from .timeline import POSITIONS, running_count, with_neighbours


def best_of(df: DataFrame, keys: list[str], order: list[Column], name: str = "is_best") -> DataFrame:
    """Marks the first row of each group. Groups are files judged alike, so a window holds one group's rows."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def medoid(members: DataFrame, pairs: DataFrame, keys: list[str], key: str, score: str, order: str | None = None) -> DataFrame:
    """(keys, key, row_sum): per group the member with the greatest sum of scores to all, itself counted as 1; the first
    by ``order`` among equals. ``pairs``: keys, l, r, score, each unordered pair once. Sums are aggregated, never listed."""
    both = pairs.select(*keys, F.col("l").alias(key), score).unionByName(pairs.select(*keys, F.col("r").alias(key), score))
    sums = both.groupBy(*keys, key).agg(F.sum(score).alias("_s"))
    rows = members.join(sums, [*keys, key], "left").withColumn("row_sum", 1.0 + F.coalesce("_s", F.lit(0.0)))
    # Equal sums may differ in their last digits with the order of addition.
    best = F.min_by(F.struct(key, "row_sum"), F.struct(-F.round("row_sum", 9), F.col(order or key)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{key}", "b.row_sum")


def cohesion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each similarity over the pairs of a group and the linear 20th percentile of the combined score."""
    names = [c for c in ("semantic", "action", "people", "layout", "subject", "background", "composition") if c in pairs.columns]
    return pairs.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names], F.percentile("combined", 0.2).alias("lower_percentile"), F.count(F.lit(1)).alias("n_pairs"))


def people_frequency(rows: DataFrame, keys: list[str], person: str, name: str) -> DataFrame:
    """Per group the people by count, then folded name, then id, as an array of (person, name, n)."""
    counts = rows.groupBy(*keys, person, name).agg(F.count(F.lit(1)).alias("n"))
    item = F.struct((-F.col("n")).alias("o"), F.lower(name).alias("f"), F.col(person).alias("person"), F.col(name).alias("name"), "n")
    listed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("people"))
    return listed.withColumn("people", F.transform("people", lambda p: F.struct(p["person"].alias("person"), p["name"].alias("name"), p["n"].alias("n"))))


def dominant(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; among equals the one seen first by ``order``."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first"))).alias("m")).select(*keys, f"m.{value}", "m.n")


def mean_vector(rows: DataFrame, keys: list[str], vec: str, name: str = "mean") -> DataFrame:
    """Element-wise mean of the vectors of each group; nulls left out."""
    each = rows.select(*keys, F.posexplode(vec).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))


def distribution(rows: DataFrame, value: str, flags: list[str] = ()) -> DataFrame:
    """Minimum, median, half-even nearest-rank p75, p90 and p95, maximum, and counts of flags, from distributed ranks."""
    known = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ranked = numbered(known, [F.col("v").asc()], "rank").crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("n"))))
    at = lambda r: F.max(F.when(F.col("rank") == r + 1, F.col("v")))
    share = lambda f: at(F.bround((F.col("n") - 1) * F.lit(f), 0))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    out = ranked.agg(F.min("v").alias("minimum"), middle.alias("median"), share(0.75).alias("p75"), share(0.90).alias("p90"), share(0.95).alias("p95"), F.max("v").alias("maximum"))
    return out.crossJoin(rows.agg(*[F.count_if(F.col(f)).alias(f) for f in flags])) if flags else out


def small_distribution(values: Column) -> dict[str, Column]:
    """The same from one array, for groups known to be small."""
    v = F.sort_array(values)
    return {"minimum": F.array_min(v), "p75": nearest_rank(v, 0.75), "p90": nearest_rank(v, 0.90), "p95": nearest_rank(v, 0.95), "maximum": F.array_max(v)}


def contiguity(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Span, missing positions, gaps and the contiguity score of each group's positions."""
    rows = with_neighbours(rows, keys, pos, pos, F.col(pos), bucket=POSITIONS)
    out = rows.withColumn("_g", F.col(pos) - F.col("_before_1") > 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(pos) - F.min(pos) + 1).alias("span"), F.count_if("_g").alias("gaps")
    )
    missing = F.col("span") - F.col("n")
    score = 1.0 - F.least(F.lit(0.7), missing / F.col("span")) - F.least(F.lit(0.3), F.col("gaps") * 0.1)
    return out.withColumn("missing", missing).withColumn("contiguity", F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def islands(rows: DataFrame, keys: list[str], pos: str, ts: str, max_gap: int, max_seconds: float) -> DataFrame:
    """Adds ``island``: a new one after a gap of more than ``max_gap`` positions or ``max_seconds``."""
    rows = with_neighbours(rows, keys, pos, pos, F.struct(F.col(pos).alias("p"), F.col(ts).alias("t")), bucket=POSITIONS)
    new = (F.col(pos) - F.col("_before_1.p") - 1 > max_gap) | (F.abs(F.col(ts) - F.col("_before_1.t")) > max_seconds)
    return running_count(rows.withColumn("_new", F.coalesce(new, F.lit(False))), keys, pos, pos, F.col("_new"), "island", bucket=POSITIONS).drop("_new", "_before_1")
