"""Prototype scoring: vectors against concept embeddings of one dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def guard(table: DataFrame, embedding: str, dimension: int, fingerprint: str, expected: str) -> DataFrame | None:
    """The concept table, or None where it was made for another model or dimension."""
    wrong = table.filter(F.size(embedding) != dimension).limit(1).count()
    return None if fingerprint != expected or wrong else table


def prototype_scores(df: DataFrame, key: str, vec: str, prototypes: np.ndarray) -> DataFrame:
    """(key, scores): dot products with each prototype, negatives cut to 0, scaled to unit length (zero rows stay).
    ``prototypes`` is a fixed concept table, tens of rows, shipped with the task."""
    kind = df.schema[key].dataType.simpleString()

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
            s = np.maximum(x @ prototypes.T, 0.0)
            s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(s), pa.list_(pa.float64()))], [key, "scores"])

    return df.filter(F.col(vec).isNotNull()).select(key, vec).mapInArrow(score, f"{key} {kind}, scores array<double>")


def top_k(scores: DataFrame, key: str, concepts: DataFrame, k: int) -> DataFrame:
    """(key, rank, ord, name, score): the k best concepts, ties by order; scores of 0 and less dropped after the cut.
    ``concepts``: ord, name."""
    long = scores.select(key, F.posexplode("scores").alias("ord", "score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))
    return long.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("score") > 0)).join(concepts, "ord").select(key, "rank", "ord", "name", "score")


def margins(top: DataFrame, key: str, least: float, strong: float) -> DataFrame:
    """(key, name, margin, confident, strongly_confident) from the two best concepts."""
    best = top.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("name"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    m = F.greatest(F.lit(0.0), F.col("a") - F.coalesce("b", F.lit(0.0)))
    return best.select(key, "name", m.alias("margin"), (m >= least).alias("confident"), (m >= strong).alias("strongly_confident"))
