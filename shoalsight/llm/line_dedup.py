"""Line dedup: levelled sorted runs of line hashes.

``LineRuns`` is a log-structured store of line keys in the shared folder. ``add`` reduces a batch of documents to its
distinct keys (128-bit hashes) with the number of documents and the largest doc_id that hold them, and merge-joins them
with the live runs. The anti-join decides: keys that no run holds become a new sorted run, so each key lies in one run
only; keys that a run holds already become a sorted run of additions, which add to their counts. When a level holds
``fanout`` runs of a kind they are merged into one run of the next level, so n batches leave O(log n) runs and each row
is rewritten O(log n) times. The totals are the runs of keys joined with the summed additions: keys that never came back
are not aggregated again.

``dedup_lines`` feeds the documents to a store in batches, compacts it and removes, from each document, the lines
whose key is held by ``min_docs`` documents or more, but for the document with the largest doc_id among them.

A key is the line with separators stripped at both ends and A-Z lower-cased; keys under ``min_chars`` code points are
never touched. Defined results: a null or empty text is one empty line. Rows that share a doc_id are one document in
the counts and share the right to keep; a row whose doc_id is null counts as a document of its own and is never the one
that keeps a line. Texts and lines of any length are taken whole. Other columns pass through. A batch holds all rows of
a doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, new_path, row_key, text_or_empty, written

RUN = "h1 long, h2 long, n_docs long, max_doc long"


def line_keys(text: Column, min_chars: int) -> Column:
    """For each line a struct (h1, h2), or null where the key is too short."""
    stripped = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(
        stripped,
        lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))),
    )


class LineRuns:
    """Append-only store; ``levels[i]`` (runs of keys) and ``additions[i]`` list the paths of the live runs of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 20):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.levels: list[list[str]] = [[]]
        self.additions: list[list[str]] = [[]]

    def _read(self, levels: list[list[str]]) -> DataFrame:
        live = [p for level in levels for p in level]
        return self.spark.read.schema(RUN).parquet(*live) if live else self.spark.createDataFrame([], RUN)

    def _put(self, run: DataFrame, levels: list[list[str]], level: int) -> None:
        path = new_path(self.spark, f"lines-{level}")
        run.select("h1", "h2", "n_docs", "max_doc").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(levels) <= level:
            levels.append([])
        levels[level].append(path)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def keys_of(self, batch: DataFrame) -> DataFrame:
        keys = F.array_distinct(F.array_compact(line_keys(text_or_empty("text"), self.min_chars)))
        rows = batch.select(F.col("doc_id").cast("long").alias("max_doc"), F.explode(keys).alias("k")).groupBy("k.h1", "k.h2", "max_doc")
        rows = rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("n_docs", F.when(F.col("max_doc").isNull(), F.col("rows")).otherwise(F.lit(1).cast("long")))
        return self._summed(rows)

    def _marked(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch, merge-joined with the runs of keys; ``fresh``: no run holds the key."""
        held = self._read(self.levels).select("h1", "h2", F.lit(True).alias("_held")).hint("merge")
        return self.keys_of(batch).join(held, ["h1", "h2"], "left").withColumn("fresh", F.col("_held").isNull()).drop("_held")

    def fresh_keys(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch that no run holds yet."""
        return self._marked(batch).filter("fresh").drop("fresh")

    def add(self, batch: DataFrame) -> None:
        """One merge join splits the batch: what is left without a match is a run of keys, the rest one of additions."""
        if not any(self.levels):
            self._put(self.keys_of(batch), self.levels, 0)
        else:
            path = new_path(self.spark, "lines-0")
            self._marked(batch).sortWithinPartitions("fresh", "h1", "h2").write.partitionBy("fresh").parquet(path)
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for fresh, levels in (("true", self.levels), ("false", self.additions)):
                part = f"{path}/fresh={fresh}"
                if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)):
                    levels[0].append(part)
        for levels, merged in ((self.levels, lambda runs: runs.repartition("h1", "h2")), (self.additions, self._summed)):
            for level in range(len(levels)):
                if len(levels[level]) >= self.fanout:
                    runs = self._read([levels[level]])
                    levels[level] = []
                    self._put(merged(runs), levels, level + 1)

    def totals(self, least: int = 1) -> DataFrame:
        """One row for each key over all live runs that at least ``least`` documents hold."""
        more = self._summed(self._read(self.additions)).select("h1", "h2", F.col("n_docs").alias("_n"), F.col("max_doc").alias("_m"))
        rows = self._read(self.levels).join(more, ["h1", "h2"], "left")
        n = F.col("n_docs") + F.coalesce("_n", F.lit(0))
        return rows.select("h1", "h2", n.alias("n_docs"), F.greatest("max_doc", "_m").alias("max_doc")).filter(F.col("n_docs") >= least)


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """Contiguous doc_id ranges, so that readers with statistics skip the rest; null ids go with the first."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or n <= 1:
        return [docs]
    step = max(1, -(-(high - low + 1) // n))
    out = []
    for k in range(n):
        at = F.col("doc_id") >= low + k * step
        if k == 0:
            at = F.col("doc_id").isNull() | at
        if k < n - 1:
            at = at & (F.col("doc_id").isNull() | (F.col("doc_id") < low + (k + 1) * step) if k == 0 else F.col("doc_id") < low + (k + 1) * step)
        if low + k * step <= high:
            out.append(docs.filter(at))
    return out


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``text`` replaced, and ``_n_lines``, ``_n_dropped`` (long) added."""
    store = LineRuns(docs.sparkSession, fanout, min_chars)
    for batch in _batches(docs, n_batches):
        store.add(batch)
    common = written(store.totals(min_docs).select("h1", "h2", "max_doc"), "common-lines")
    at = docs.select(*row_key(), "doc_id", F.posexplode(line_keys(text_or_empty("text"), min_chars)).alias("pos", "k")).filter(F.col("k").isNotNull())
    at = at.select("_id", "_th", "doc_id", "pos", "k.h1", "k.h2")
    drops = (
        at.join(common, ["h1", "h2"])
        .filter(~F.coalesce(F.col("doc_id") == F.col("max_doc"), F.lit(False)))
        .groupBy("_id", "_th")
        .agg(F.collect_set("pos").alias("_gone"))
    )
    keyed = docs.withColumns(dict(zip(["_kid", "_kth"], row_key(), strict=True)))
    joined = keyed.join(drops, keyed["_kid"].eqNullSafe(drops["_id"]) & (keyed["_kth"] == drops["_th"]), "left")
    lines = joined.withColumn("_lines", F.split(text_or_empty("text"), "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda p: F.get("_lines", p))
    return lines.withColumns(
        {
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
            "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("_lines", "_gone", "_id", "_th", "_kid", "_kth")
