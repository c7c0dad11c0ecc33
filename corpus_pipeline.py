"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined results: null and empty texts fail the quality rules; rows without a doc_id, or with a shared one, are judged by
their own texts: they go as copies only where they share a doc_id and a component, and as contaminated only where their
own text is. Rows equal in doc_id and text leave one. Empty tables give empty results; columns beside those of
``documents`` pass up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalsight.llm.common import documents, written
from shoalsight.llm.decontaminate import drop_contaminated
from shoalsight.llm.jaccard_join import Join, keep_one
from shoalsight.llm.line_dedup import dedup_lines
from shoalsight.llm.mixing import mix_documents
from shoalsight.llm.quality_rules import filter_by_rules
from shoalsight.plans.materialize import forget, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return filter_by_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go, but for one document each; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return keep_one(docs, Join(k=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    return mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Near duplicates have no practical SQL form; tests compare the run with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What the stages write on their way, and each stage's table but the last, is deleted."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as held:
            docs = written(stage(spark, docs, sf_dir), name)
            held.remove(docs._written_path)
        if before is not None:
            forget(before)
        before = docs
    return docs
