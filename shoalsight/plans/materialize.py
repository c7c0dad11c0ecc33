"""Written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own by application, on local masters.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where the setting is missing and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="shoalsight-")
        found = _own[app]
    return found


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/shoalsight/{name}-{uuid.uuid4().hex}"
    for held in _scopes:
        held.append(path)
    return path


#: Paths handed out inside each open ``scratch``.
_scopes: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Deletes the table that ``written`` returned as ``df``; nothing may read it any more."""
    delete(df.sparkSession, df._written_path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those taken out of the list that it gives."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.remove(held)
        for path in held:
            delete(spark, path)


#: Rows of an Arrow batch while a table is written: long texts in batches of the default 10,000 need much memory.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(usual) if int(usual) > 0 else BATCH_ROWS, BATCH_ROWS)))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out
