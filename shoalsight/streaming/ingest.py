"""Structured Streaming: incremental ingest of file entries, and watermarked event counts.

``ingest`` keeps a table of processed files: each micro-batch is reduced to the last state of each path, rows whose
state is stored already are dropped by an anti-join, the rest is computed once and appended. A batch writes into a folder
named by its id, which is overwritten if the batch runs again, so a restart after a failure neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import STATE


def ingest(files: DataFrame, store: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], once: bool = True):
    """Starts the stream of (path, file_size, mtime_ns, ...) into ``store``; returns the query. With ``once`` it ends when
    everything available has been read."""

    def put(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "mtime_ns").alias("r")).select("r.*")
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(store).filter(F.col("batch") != number).select(*STATE)
            latest = latest.join(seen, STATE, "left_anti")
        except Exception as e:  # the store does not exist before its first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        compute(latest).write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts by window and key of a stream, late rows accepted up to ``lateness``."""
    timed = events.withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
