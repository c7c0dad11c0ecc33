"""Result shaping: ordering, pages, selections, search, export plans."""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import extension, file_name, stem
from .ranks import numbered


def page(items: DataFrame, group: str, order: list[Column], number: int, size: int = 48) -> DataFrame:
    """Items of one page (from 0) across groups, with the group's title; a part of a group says which part it is.
    ``items`` has group (its rank), title and the columns of ``order``."""
    ranked = numbered(items, [F.col(group).asc(), *order], "n")
    inside = Window.partitionBy(group)
    ranked = ranked.withColumns({"_first": F.min("n").over(inside), "_count": F.count(F.lit(1)).over(inside)})
    a, b = number * size + 1, (number + 1) * size
    lo = F.greatest(F.lit(a), F.col("_first")) - F.col("_first") + 1
    hi = F.least(F.lit(b), F.col("_first") + F.col("_count") - 1) - F.col("_first") + 1
    whole = (lo == 1) & (hi == F.col("_count"))
    label = F.when(whole, F.col("title")).otherwise(F.format_string("%s (%d-%d of %d)", "title", lo, hi, "_count"))
    return ranked.filter(F.col("n").between(a, b)).withColumn("title", label).drop("_first", "_count")


def page_label(total: int, number: int, size: int = 48) -> str:
    pages = -(-total // size)
    if pages <= 1:
        return ""
    number = max(0, min(number, pages - 1))
    return f"Showing {number * size + 1}-{min((number + 1) * size, total)} of {total} photos (page {number + 1}/{pages})"


def suggest(names: DataFrame, name: str, prefix: str, limit: int = 20) -> DataFrame:
    """Names that start with the prefix, without case, in order."""
    low = F.lower(name)
    return names.filter(low.startswith(prefix.lower())).orderBy(low, name).limit(limit)


def moved_first(names: DataFrame, name: str, preferred: str | None) -> DataFrame:
    """All names in order, letters compared without case, the preferred one (that of the nearest match) before the rest."""
    first = F.lit(False) if preferred is None else F.col(name) == preferred
    return names.orderBy(first.desc(), F.lower(name), name)


def initial_selection(items: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """path, selected: kept choices first, else everything in face groups and what is recommended for deletion. Choices
    for paths that are gone fall away."""
    chosen = items.groupBy("path").agg(F.bool_or((F.col("group_type") == "face") | F.col("recommended_delete")).alias("preset"))
    if state is None:
        return chosen.select("path", F.col("preset").alias("selected"))
    return chosen.join(state, "path", "left").select("path", F.coalesce("selected", "preset").alias("selected"))


def export_names(items: DataFrame, path: str = "path") -> DataFrame:
    """Adds target: the file name, with _1, _2, ... before the suffix for later files of one name (in path order)."""
    ranked = items.withColumn("_name", file_name(F.col(path)))
    n = F.row_number().over(Window.partitionBy("_name").orderBy(path)) - 1
    suffix = F.regexp_extract("_name", r"^.+(\.[^.]+)$", 1)
    target = F.when(n == 0, F.col("_name")).otherwise(F.concat(stem(F.col(path)), F.lit("_"), n.cast("string"), suffix))
    return ranked.withColumn("target", target).drop("_name")


def copy_files(plan: DataFrame, folder: str, link: bool = False) -> DataFrame:
    """Copies (or links, where the file system can) the files ``path`` of an export plan to ``target`` in a folder that all
    workers share; one row a file with ``error`` null where it went well. Existing files are not overwritten."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            why = []
            for path, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = os.path.join(folder, os.path.basename(target))
                try:
                    if os.path.lexists(to):
                        raise FileExistsError(f"{to} exists")
                    os.link(path, to) if link else shutil.copy2(path, to)
                    why.append(None)
                except OSError as e:
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(why, pa.string())], ["path", "target", "error"])

    return plan.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "target").mapInArrow(run, "path string, target string, error string")


def write_groups(items: DataFrame, folder: str, group: str) -> None:
    """One sub-folder a group with its rows as JSON lines."""
    items.write.mode("error").partitionBy(group).json(folder)


def kind_label(path: Column) -> Column:
    """Upper-case suffix without its dot, or "Image"."""
    e = F.upper(F.ltrim(F.regexp_replace(extension(path), r"^\.", "")))
    return F.when(e == "", F.lit("Image")).otherwise(e)


def progress(mode: str, phase: str, done: int, total: int) -> int:
    """Percent of a scan; phases of a mode share 0..100."""
    # Fixed values.
    scenes = dict(loading_visual_features=(0, 44), analyzing_actions_and_scenes=(44, 58), detecting_scene_changes=(58, 70), building_scene_groups=(70, 86), checking_group_coherence=(86, 92), choosing_previews=(92, 97), finalizing_results=(97, 100))
    shares = {"scenes": scenes, "duplicates": {"indexing": (0, 50), "matching": (50, 100)}}.get(mode, {})
    a, b = shares.get(phase, (0, 100))
    part = min(max(done, 0), total) / total if total else 1.0
    return a + int(part * max(b - a, 1))
