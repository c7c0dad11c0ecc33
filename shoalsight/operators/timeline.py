"""Timelines: previous and next rows, sessions, transitions, boundary acceptance, segments, crossings.

A timeline is the rows of one ``album`` in the order of ``ts``, then ``path``. Neighbouring rows are found in two
levels (inside time buckets, then between the buckets' ends), so an album with a large share of all rows is spread over
many tasks; only bucket totals of an album meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 6 * 3600
#: Positions of a bucket, where rows are ordered by position instead of time.
POSITIONS = 4096


def seconds(ts: Column) -> Column:
    """Seconds of a TIMESTAMP_NTZ as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def _bucketed(df: DataFrame, ts: str, bucket: float) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(ts) / bucket))


def with_neighbours(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, before: int = 1, after: int = 0, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Adds ``_before_1..n`` and ``_after_1..n``: ``value`` of the rows around each row in the order (ts, tie)."""
    df = _bucketed(df, ts, bucket).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    n = max(before, after)
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col("_v").alias("v"))
    # The first and last n rows of each bucket, and from them those of the buckets before and after.
    df = df.withColumns({"_rank": F.row_number().over(inside), "_back": F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(F.desc(ts), F.desc(tie)))})
    ends = df.filter(F.col("_back") <= n).groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(F.struct("_back", at.alias("r")))).alias("_last"))
    starts = df.filter(F.col("_rank") <= n).groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(F.struct("_rank", at.alias("r")))).alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    edges = ends.join(starts, [*keys, "_bucket"])
    carry = lambda c, fn: [F.coalesce(fn(c, k).over(order), F.array().cast(edges.schema[c].dataType)) for k in range(1, n + 1)]
    edges = edges.select(
        *keys, "_bucket", F.transform(F.slice(F.concat(*carry("_last", F.lag)), 1, n), lambda e: e["r"]["v"]).alias("_prior"),
        F.transform(F.slice(F.concat(*carry("_first", F.lead)), 1, n), lambda e: e["r"]["v"]).alias("_later"),
    )
    df = df.join(edges, [*keys, "_bucket"])
    out = {}
    for k in range(1, before + 1):
        out[f"_before_{k}"] = F.coalesce(F.lag("_v", k).over(inside), F.when(F.col("_rank") <= k, F.get("_prior", F.lit(k) - F.col("_rank"))))
    for k in range(1, after + 1):
        out[f"_after_{k}"] = F.coalesce(F.lead("_v", k).over(inside), F.when(F.col("_back") <= k, F.get("_later", F.lit(k) - F.col("_back"))))
    return df.withColumns(out).drop("_bucket", "_v", "_rank", "_back", "_prior", "_later")


def running_count(df: DataFrame, keys: list[str], ts: str, tie: str, flag: Column, name: str, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Adds the number of rows with ``flag`` up to and including each row."""
    df = _bucketed(df, ts, bucket).withColumn("_f", F.when(flag, 1).otherwise(0).cast("long"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum("_f").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return df.join(totals, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.sum("_f").over(inside)).drop("_bucket", "_f", "_base")


def opens_session(before: Column, now: Column, gap_seconds: float, hard_gap_seconds: float, alike: Column | None = None) -> Column:
    """Whether a row at ``now`` opens a session after one at ``before``; see ``sessionize``."""
    gap = F.abs(now - before)
    day = F.floor(now / 86400) != F.floor(before / 86400)
    unlike = F.lit(True) if alike is None else ~F.coalesce(alike, F.lit(False))
    return (gap > hard_gap_seconds) | (day & (gap >= gap_seconds)) | ((gap > gap_seconds) & unlike)


def sessionize(df: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: float = 1800.0, hard_gap_seconds: float = 7200.0, alike: Column | None = None, value: Column | None = None, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Adds ``session`` (from 0). A row opens a session after a gap over the hard gap, after a change of UTC day with at
    least the session gap, and after a gap over the session gap unless ``alike`` (an expression over ``_before_1.v`` and
    the row) says that the two rows belong together."""
    carried = F.struct(F.col(ts).alias("ts"), (value if value is not None else F.lit(None).cast("string")).alias("v"))
    df = with_neighbours(df, keys, ts, tie, carried, before=1, bucket=bucket)
    opens = F.col("_before_1").isNotNull() & opens_session(F.col("_before_1.ts"), F.col(ts), gap_seconds, hard_gap_seconds, alike)
    return running_count(df, keys, ts, tie, opens, "session", bucket=bucket).drop("_before_1")


def crossed(df: DataFrame, pairs: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Boundaries between pairs of positions: for pairs (keys, l_pos, r_pos), whether a hard or soft transition lies in
    [l_pos, r_pos). ``df`` has a row (keys, pos, hard, soft) for the transition after each position. By prefix sums."""
    sums = df.select(*keys, F.col(pos).alias("_p"), F.coalesce("hard", F.lit(False)).alias("_fh"), F.coalesce("soft", F.lit(False)).alias("_fs"))
    for name, flag in (("_hard", "_fh"), ("_soft", "_fs")):
        sums = running_count(sums, keys, "_p", "_p", F.col(flag), name, bucket=POSITIONS).withColumn(name, F.col(name) - F.col(flag).cast("int"))
    sums = sums.drop("_fh", "_fs")
    l = sums.withColumnsRenamed({"_p": "l_pos", "_hard": "_lh", "_soft": "_ls"})
    r = sums.withColumnsRenamed({"_p": "r_pos", "_hard": "_rh", "_soft": "_rs"})
    both = pairs.join(l, [*keys, "l_pos"]).join(r, [*keys, "r_pos"])
    hard, soft = F.col("_rh") > F.col("_lh"), F.col("_rs") > F.col("_ls")
    return both.withColumns({"crossed_hard": hard, "crossed_soft": hard | soft}).drop("_lh", "_ls", "_rh", "_rs")


def support(left: Column, right: list[Column], cross: Column) -> Column:
    """How much better the neighbouring pairs hold together than the pair across the boundary."""
    present = F.filter(F.array(*right), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present)
    alone = F.greatest(F.lit(0.0), 0.5 - cross)
    return F.when(left.isNull() | (F.size(present) == 0), alone).otherwise(F.greatest(F.lit(0.0), (left + mean) / 2.0 - cross))
