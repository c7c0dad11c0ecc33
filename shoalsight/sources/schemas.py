"""Schemas of the stored tables, their evolution, and codecs between flat, nested and JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = "path string, file_size long, mtime_ns long, width int, height int, is_raw boolean, extension string, updated_at timestamp"
BOX = "struct<x:int,y:int,w:int,h:int>"
ANALYSIS = "struct<selection:double,utility:double,pose:double,eyes:double,exposure:double,contrast:double,sharpness:double,warnings:array<string>>"
FACES = f"path string, file_size long, mtime_ns long, version int, coverage string, face int, bbox {BOX}, confidence double, landmarks array<array<float>>, embedding array<float>, analysis {ANALYSIS}"
PEOPLE = "id long, name string"
REFERENCES = "id long, person_id long, embedding array<float>"
BLUR = "path string, file_size long, mtime_ns long, version int, laplacian double, sobel double, local_contrast double, score double, status string"
HASHES = "path string, file_size long, mtime_ns long, version int, width int, height int, p0 long, p1 long, p2 long, p3 long, d0 long, d1 long, d2 long, d3 long"
FOLDERS = "folder string, key string, result string"


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """Rows in ``schema``: columns it adds are null, columns it lacks are kept at the end."""
    want = T._parse_datatype_string(schema)
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*known, *[c for c in df.columns if c not in want.names])


def people_in_order(people: DataFrame) -> DataFrame:
    """By name, letters A-Z compared without case, then id."""
    return people.orderBy(F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "id")


def flatten(df: DataFrame, nested: str, prefix: str) -> DataFrame:
    """Fields of a struct as columns ``prefix_field``; a null struct is told from one of nulls by ``prefix_present``."""
    names = df.schema[nested].dataType.names
    rest = [c for c in df.columns if c != nested]
    return df.select(*rest, F.col(nested).isNotNull().alias(f"{prefix}_present"), *[F.col(f"{nested}.{n}").alias(f"{prefix}_{n}") for n in names])


def nest(df: DataFrame, prefix: str, name: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The inverse of ``flatten``; missing values may fall back on ``defaults``."""
    fields = [c.removeprefix(f"{prefix}_") for c in df.columns if c.startswith(f"{prefix}_") and c != f"{prefix}_present"]
    value = lambda n: F.coalesce(F.col(f"{prefix}_{n}"), (defaults or {}).get(n, F.lit(None)))
    rest = [c for c in df.columns if not c.startswith(f"{prefix}_")]
    return df.select(*rest, F.when(F.col(f"{prefix}_present"), F.struct(*[value(n).alias(n) for n in fields])).alias(name))


def migrate_json(df: DataFrame, column: str, schema: str, old_names: dict[str, str]) -> DataFrame:
    """JSON text to typed columns; a field that is missing is looked for under its old name."""
    want = T._parse_datatype_string(schema)
    extra = ", ".join(f"{old} {want[new].dataType.simpleString()}" for new, old in old_names.items())
    parsed = F.from_json(column, f"{schema}, {extra}" if extra else schema)
    rows = df.withColumn("_j", parsed)
    pick = lambda n: F.coalesce(F.col(f"_j.{n}"), F.col(f"_j.{old_names[n]}")) if n in old_names else F.col(f"_j.{n}")
    return rows.select(*[c for c in df.columns if c != column], *[pick(n).alias(n) for n in want.names])
