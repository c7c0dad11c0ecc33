"""How the operators' inputs map to the driver's tables; one place, shared by all queries.

Photos are rows of ``events`` (album = user_id, time = ts, quality = value, tag = event_type), vectors those of
``embeddings`` (people = label), files and hashes those of ``documents`` (path built from source, id and lang).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_words
from ..operators.timeline import seconds

COSINE = 0.40
#: Vectors of so many values in all are broadcast.
BROADCAST_VALUES = 2**22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame, number: Callable[[int], Column]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows that have a vector, with its vec_id (``number`` of the count of vectors), and what adds the vectors to them as
    semantic. They are added late, so that rows are dealt out without them; up to ``BROADCAST_VALUES`` are broadcast."""
    known = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("semantic"))
    n, ids, values = known.agg(F.count(F.lit(1)), F.count_distinct("vec_id"), F.sum(F.size("semantic"))).first()
    rows = rows.withColumn("vec_id", number(n))
    if ids < n:  # a row for each vector of its number
        return rows.join(known, "vec_id"), lambda df: df
    near = F.broadcast if (values or 0) <= BROADCAST_VALUES else lambda df: df
    return rows.join(near(known.select("vec_id")), "vec_id", "left_semi"), lambda df: df.join(near(known), "vec_id")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("album"), F.col("event_id").alias("photo"), seconds(F.col("ts")).alias("ts"), "event_type", "value", "props")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, doc_id, file_size, width, height, mtime_ns; p0, p1 (64-bit words of an md5); h0..h3 (256 bits of the text, one of
    them flipped by the id, so that copies are near and not equal); d0, d1 (of the text and the id's parity)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/lib/"), "source", F.lit("/IMG_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".JPG").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".Txt"))
    md5 = F.md5("text")
    p0, p1 = hash_words(md5, 2)
    h2, h3 = hash_words(F.md5(F.concat("text", F.lit("#"))), 2)
    d0, d1 = hash_words(F.md5(F.concat("text", (F.col("doc_id") % 2).cast("string"))), 2)
    h0 = p0.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("doc_id") % 61).cast("int")))
    return d.select(
        path.alias("path"), "doc_id", F.col("n_chars").alias("file_size"), (F.col("n_chars") % 640 + 1).alias("width"), (F.length("text") * 7 % 480 + 1).cast("long").alias("height"),
        (F.col("doc_id") * 1000).alias("mtime_ns"), md5.alias("md5"), p0.alias("p0"), p1.alias("p1"),
        h0.alias("h0"), p1.alias("h1"), h2.alias("h2"), h3.alias("h3"), d0.alias("d0"), d1.alias("d1"),
    )


# The same in SQL.
PATH_SQL = "'/lib/' || source || '/IMG_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.Txt' END"
FILES_SQL = f"""f AS (SELECT {PATH_SQL} AS path, doc_id, n_chars AS file_size, n_chars % 640 + 1 AS width, length(text) * 7 % 480 + 1 AS height, doc_id * 1000 AS mtime_ns, md5(text) AS md5 FROM documents)"""
_WORD = lambda text, k: f"('0x' || md5({text})[{16 * k + 1}:{16 * k + 16}])::UBIGINT"
HASHES_SQL = f"""h AS (SELECT doc_id, {_WORD("text", 0)} AS p0, {_WORD("text", 1)} AS p1, xor({_WORD("text", 0)}, 1::UBIGINT << (doc_id % 61)::UBIGINT) AS h0, {_WORD("text", 1)} AS h1,
  {_WORD("text || '#'", 0)} AS h2, {_WORD("text || '#'", 1)} AS h3, {_WORD("text || (doc_id % 2)", 0)} AS d0, {_WORD("text || (doc_id % 2)", 1)} AS d1 FROM documents)"""
TIMELINE_SQL = "t AS (SELECT user_id AS album, event_id AS photo, epoch_us(ts) / 1e6 AS ts, event_type, value, props FROM events)"
VEC_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
