"""The duplicates pipeline: hashes -> banded Hamming join -> verification -> components -> best copy and what may go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_name
from ..operators.components import connected_components
from ..operators.groups import best_of
from ..operators.hamming import copies, hamming_pairs
from ..scene_config import DuplicateConfig


def candidate_pairs(photos: DataFrame, key: str, p: list[str], d: list[str], config: DuplicateConfig = DuplicateConfig()) -> DataFrame:
    """(l, r, distance): photos whose p-words and d-words are both near. Photos equal in all words are linked to one photo
    each, and only that one is paired with others."""
    near = hamming_pairs(photos, key, p, config.maximum_phash_distance, d, config.maximum_dhash_distance)
    return near.union(copies(photos, key, [*p, *d]).filter("l <> r").select("l", "r", F.lit(0).cast("int")))


def duplicate_groups(photos: DataFrame, key: str, pairs: DataFrame, verify: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """``photos`` in groups of two or more, with component, group_size, is_best (most pixels, then name) and
    recommended_delete. ``verify`` may turn candidate pairs down by a condition over them."""
    if verify is not None:
        pairs = pairs.filter(verify(pairs))
    found = connected_components(pairs, "l", "r").withColumnRenamed("id", key)
    rows = photos.join(found, key)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    rows = rows.join(sizes, "component")
    order = [F.desc(F.col("width") * F.col("height")), F.desc(file_name(F.col("path"))), F.asc("path")]
    return best_of(rows, ["component"], order).withColumn("recommended_delete", ~F.col("is_best"))
