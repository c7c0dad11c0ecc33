"""Caches keyed by file state and version, upserts, and guards. Every write makes a new table; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["path", "file_size", "mtime_ns"]


def cache_hits(files: DataFrame, cache: DataFrame, version: int, null_safe: dict[str, Column] | None = None) -> DataFrame:
    """Cache rows that are valid for the files as they are now. ``null_safe``: columns that must equal a value, null
    standing for the empty string."""
    valid = cache.filter(F.col("version") == version)
    for name, value in (null_safe or {}).items():
        valid = valid.filter(F.coalesce(F.col(name), F.lit("")) == F.coalesce(value, F.lit("")))
    return files.select(*STATE).join(valid, STATE)


def cache_misses(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    return files.join(cache.filter(F.col("version") == version).select(*STATE), STATE, "left_anti")


def coalesce_upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming values win, but null never overwrites; keys of either side stay. Incoming keys are distinct."""
    names = [c for c in existing.columns if c != key]
    e = existing.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_e_{c}") for c in names])
    both = e.join(incoming.withColumn("_in", F.lit(True)), F.col("_k") == incoming[key], "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_e_{c}")) if c in incoming.columns else F.col(f"_e_{c}")
    return both.select(F.coalesce(F.col(key), F.col("_k")).alias(key), *[pick(c).alias(c) for c in names])


def insert_missing(table: DataFrame, rows: DataFrame, fold: str) -> DataFrame:
    """Adds rows whose trimmed name is not empty and not there yet, letters A-Z compared without case; ids continue."""
    clean = rows.withColumn(fold, F.btrim(fold)).filter(F.col(fold) != "")
    folded = lambda df: df.withColumn("_f", F.translate(fold, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    new = folded(clean).groupBy("_f").agg(F.min(fold).alias(fold)).join(folded(table).select("_f"), "_f", "left_anti").select(fold)
    return table.select(fold).union(new)


def no_downgrade(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows without those that would replace full coverage by partial coverage of the same file state."""
    full = existing.filter(F.col("coverage") == "all_faces").select(*STATE)
    partial = incoming.filter(F.col("coverage") != "all_faces")
    return incoming.filter(F.col("coverage") == "all_faces").unionByName(partial.join(full, STATE, "left_anti"))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All rows of the incoming parents are replaced."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def usable(rows: DataFrame, keys: list[str], need_unknown: bool, need_analysis: bool) -> DataFrame:
    """Parents whose cached rows answer the question: full coverage if unknown faces count, all analysed if need be."""
    covered = F.bool_and(F.col("coverage") == "all_faces") if need_unknown else F.lit(True)
    analysed = F.bool_and(F.col("analysis").isNotNull()) if need_analysis else F.lit(True)
    return rows.groupBy(*keys).agg(covered.alias("c"), analysed.alias("a"), F.count(F.lit(1)).alias("n")).filter("c and a").select(*keys, "n")


def signature(people: DataFrame, refs: DataFrame) -> DataFrame:
    """One text: count and greatest id of people, and of reference embeddings."""
    of = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}n"), F.coalesce(F.max("id"), F.lit(0)).alias(f"{p}m"))
    return of(people, "p").crossJoin(of(refs, "r")).select(F.concat_ws(":", "pn", "pm", "rn", "rm").alias("signature"))


def group_id(paths: Column, versions: dict[str, str]) -> Column:
    """First 12 hex digits of the SHA-1 of a JSON text with sorted keys, paths and versions."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(paths), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", "), F.lit("]"))
    parts = sorted([*((k, F.lit(f'"{v}"')) for k, v in versions.items()), ("paths", quoted)], key=lambda kv: kv[0])
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts])
    return F.substring(F.sha1(F.concat(F.lit("{"), body, F.lit("}"))), 1, 12)
