"""What the corpus operators share: word splitting, keys and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import new_path, written

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "documents", "keep_where", "let", "new_path", "row_key", "text_or_empty", "words", "written"]

#: The separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value`` once, for expressions used many times inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_where(df: DataFrame, flag: Column) -> DataFrame:
    """``df.filter(flag)`` evaluated above the projections that compute its columns. A plain filter would be pushed
    below them with their expressions copied into it, and those inside lambdas evaluated anew for each element. Relies on
    the optimiser leaving filters over nondeterministic columns where they are (a test looks at the plan); where it did
    not, the result would be the same and slower."""
    return df.withColumn("_above", F.rand(0)).filter(flag & (F.col("_above") >= 0)).drop("_above")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart even where ``doc_id`` is null or repeated; identical rows share them."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
