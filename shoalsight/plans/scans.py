"""Whole scans: blur and scenes over cached features, cancellation, diagnostics and summaries."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faces
from ..functions.images import over_pixels
from ..functions.scalars import extension
from ..operators.incremental import cache_hits, cache_misses
from ..operators.ranks import numbered
from ..scene_config import SceneConfig
from ..sources.decode import dropped, grey_pixels
from ..sources.files import supported_extensions
from .materialize import written


def refresh(files: DataFrame, cache: DataFrame, version: int, compute) -> DataFrame:
    """Rows for all ``files``: cached ones where file state and version agree, ``compute(misses)`` for the rest. The
    result is the next cache; a failing write is an error, not a shrug."""
    return cache_hits(files, cache, version).unionByName(compute(cache_misses(files, cache, version)).withColumn("version", F.lit(version)), allowMissingColumns=True)


def blurry(measures: DataFrame) -> DataFrame:
    """path and score of blurry photos, worst first, from laplacian, sobel and local_contrast."""
    score = faces.blur_score(F.col("laplacian"), F.col("sobel"), F.col("local_contrast"))
    rows = measures.withColumn("score", score).withColumn("status", faces.blur_status(F.col("score")))
    return rows.filter("status = 'Blurry'").orderBy("score", "path")


def folder_key(paths: DataFrame, config: SceneConfig, *fingerprints: str) -> str:
    """Key of a folder's result: file states, configuration and fingerprints. Files are hashed by Spark and summed, so the
    driver sees one row whatever their number."""
    state = paths.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("path", "file_size", "mtime_ns", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]).first()
    return hashlib.sha256("|".join([*map(str, state), config.signature(), *fingerprints]).encode()).hexdigest()


def fingerprint(path: str, chunk: int = 1 << 20) -> str:
    """SHA-256 of a file's content, read in chunks; for models and prototype tables."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def blur_scan(spark: SparkSession, folder: str, most: int = 1000, ignore_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, score of blurry photos, worst first; path, error of files that cannot be read) of the files in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(extension(F.col("path")).isin(*supported_extensions()))
    read = written(grey_pixels(files, most, ignore_errors), "grey-photos")
    return blurry(over_pixels(dropped(read), "path")).select("path", "score"), read.filter("error is not null").select("path", "error")


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside can be stopped from elsewhere with ``cancel``."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return list(spark.interruptTag(tag))


def memberships(grouped: DataFrame) -> DataFrame:
    """Photos with the number of their group (by time, untimed last, then path) and of their segment; null if ungrouped."""
    heads = grouped.filter("grp is not null").groupBy("album", "session", "grp").agg(F.min_by(F.struct("ts", "path"), F.struct(F.col("ts").isNull(), "ts", "path")).alias("h"))
    heads = numbered(heads, [F.col("album").asc(), F.col("h.ts").asc_nulls_last(), F.col("h.path").asc(), F.col("session").asc(), F.col("grp").asc()], "_n")
    first = heads.groupBy(F.col("album").alias("_album")).agg(F.min("_n").alias("_first"))
    heads = heads.join(first, F.col("album").eqNullSafe(F.col("_album")))
    heads = heads.select(F.col("album").alias("_a"), F.col("session").alias("_s"), F.col("grp").alias("_g"), (F.col("_n") - F.col("_first") + 1).cast("int").alias("group_index"))
    same = (F.col("album") == F.col("_a")) & F.col("session").eqNullSafe(F.col("_s")) & (F.col("grp") == F.col("_g"))
    return grouped.join(heads, same, "left").drop("_a", "_s", "_g")


def session_sections(grouped: DataFrame, judged: DataFrame) -> DataFrame:
    """A row for each session: photos, segments, transitions and boundaries by kind."""
    a = grouped.filter("session is not null").groupBy("album", "session").agg(F.count(F.lit(1)).alias("image_count"), F.countDistinct("segment").alias("segment_count"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    kind = lambda k, extra=True: F.count_if((F.col("reliability") == k) & extra)
    b = judged.groupBy("album", "session").agg(
        F.count("reliability").alias("transition_count"), kind("hard").alias("hard_boundary_count"), kind("supported").alias("soft_boundary_count"),
        kind("hard", F.col("accepted")).alias("accepted_hard_boundary_count"), kind("supported", F.col("accepted")).alias("accepted_soft_boundary_count"),
    )
    return a.join(b, ["album", "session"], "left")


def summary(grouped: DataFrame) -> DataFrame:
    """One row: groups, their mean, least and greatest size, mean cohesion, grouped and ungrouped photos."""
    sizes = grouped.filter("grp is not null").groupBy("album", "session", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("cohesion").alias("c"))
    parts = sizes.agg(F.count(F.lit(1)).alias("groups"), F.avg("n").alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("c").alias("mean_cohesion"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped"))
    return parts.crossJoin(grouped.agg(F.count_if(F.col("grp").isNull()).alias("ungrouped")))


def canonical(l: Column, r: Column) -> dict[str, Column]:
    """Ends of an undirected edge in order."""
    return {"l": F.least(l, r), "r": F.greatest(l, r)}
