"""Ranks and prefix sums over all rows without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import written


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Adds the 1-based rank in ``order``. Rows are dealt out by ranges of the order and written with their range; ranks
    inside a range are shifted by the counts of the ranges before it, a table of one row a range."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_i", inside).join(counts, "_range").withColumn(name, F.col("_b") + F.col("_i")).drop("_range", "_i", "_b")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums of the given longs over all rows before it in ``order`` (unique), in two levels: inside the
    ranges that rows are dealt out by, and over the ranges' totals."""
    dealt = df.withColumns({f"_v_{k}": v.cast("long") for k, v in sums.items()})
    dealt = written(dealt.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_i_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}).join(totals, "_range")
    return out.withColumns({k: F.col(f"_b_{k}") + F.col(f"_i_{k}") for k in sums}).drop("_range", *[f"{p}{k}" for k in sums for p in ("_v_", "_b_", "_i_")])
