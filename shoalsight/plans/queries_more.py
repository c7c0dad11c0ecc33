"""Queries over labels, codecs, migrations and whole scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faces
from ..functions.concepts import CONCEPTS
from ..operators.labels import group_label
from ..sources.schemas import evolve, flatten, migrate_json, nest, people_in_order
from .scans import blurry, canonical, refresh, summary
from .tables import FILES_SQL, TIMELINE_SQL, files, table, timeline


def v17_group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of album days; their best concepts are picked by number."""
    t = timeline(spark, sf_dir)
    g = t.groupBy("album").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.when(F.col("value") > 140, F.col("event_type")))).alias("people"))
    every = {c: F.array(*[F.struct(F.lit(x.label).alias("label"), F.array(*map(F.lit, x.tags)).alias("tags")) for x in xs]) for c, xs in CONCEPTS.items()}
    pick = lambda c, k: F.get(every[c], (F.col("album") * k % len(CONCEPTS[c])).cast("int"))
    none = lambda c: F.filter(every[c], lambda x: F.lit(False))
    actions = F.when(F.col("album") % 4 != 0, F.array(pick("action", 1), pick("action", 7))).otherwise(none("action"))
    scenes = F.when(F.col("album") % 3 != 0, F.array(pick("scene", 1))).otherwise(none("scene"))
    shots = F.when(F.col("album") % 5 != 0, F.array(pick("shot", 1))).otherwise(none("shot"))
    mode = F.element_at(F.array(*map(F.lit, ("solo", "couple", "crowd", "none"))), (F.col("album") % 4 + 1).cast("int"))
    return g.select("album", group_label(actions, scenes, shots, F.col("people"), mode, F.col("n") % 2 == 0).alias("label"))


def c6_migrate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("photo", F.when(F.col("photo") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"old_k"'))).alias("props"))
    return migrate_json(t, "props", "k int, added double", {"k": "old_k"})


def x13_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested to flat and back; null structs stay null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.struct("o_custkey", "o_orderstatus")).alias("analysis"))
    back = nest(flatten(o, "analysis", "a"), "a", "analysis", {"o_orderstatus": F.lit("?")})
    return back.select("o_orderkey", F.col("analysis").isNull().alias("empty"), "analysis.o_custkey", "analysis.o_orderstatus")


def x15_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("extra"))
    return evolve(n, "id long, name string, active boolean")


def x16_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as JSON documents and read back."""
    g = files(spark, sf_dir).groupBy((F.col("doc_id") % 50).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    doc = g.select("grp", F.to_json(F.struct("n", "bytes")).alias("doc"))
    return doc.select("grp", F.from_json("doc", "n long, bytes long").alias("d")).select("grp", "d.n", "d.bytes")


def x17_people_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people_in_order(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name")))


def x9_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    e = canonical(F.col("l_suppkey"), F.col("l_partkey") % 100)
    return l.select(e["l"].alias("l"), e["r"].alias("r")).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


def x3_blur_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blur scan over a cache that lacks some files and is stale for others."""
    f = files(spark, sf_dir)
    measure = lambda df: df.join(f.select("path", "doc_id"), "path").select("path", "file_size", "mtime_ns", (F.col("doc_id") % 401).cast("double").alias("laplacian"), (F.col("doc_id") % 61).cast("double").alias("sobel"), (F.col("doc_id") % 51).cast("double").alias("local_contrast"))
    state = f.select("path", "file_size", "mtime_ns")
    old = measure(state).filter("laplacian % 3 > 0").withColumn("file_size", F.col("file_size") + F.when(F.col("sobel") % 2 == 0, 1).otherwise(0)).withColumn("version", F.lit(2))
    return blurry(refresh(state, old, 2, measure)).select("path", F.round("score", 10).alias("score"))


def a20_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select(F.col("album"), F.lit(0).alias("session"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 20)).alias("grp"), (F.col("album") / 256).alias("cohesion"))
    return summary(t).withColumns({"mean_size": F.round("mean_size", 8), "mean_cohesion": F.round("mean_cohesion", 10)})


def f16_eye_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    yaw = F.when(F.col("photo") % 6 != 0, F.col("value") % 90 - 45)
    return t.select("photo", F.round(faces.eye_weight(yaw), 11).alias("eye_weight"))


QUERIES = {f.__name__: f for f in (v17_group_label, c6_migrate_json, x13_codec, x15_schema_evolution, x16_json_documents, x17_people_in_order, x9_canonical_edges, x3_blur_scan, a20_summary, f16_eye_weight)}


def _concepts(c: str) -> str:
    return "[" + ", ".join(f"{{'label': '{x.label}', 'tags': {list(x.tags)}}}" for x in CONCEPTS[c]) + "]"


_PICK = lambda c, k: f"({_concepts(c)})[album * {k} % {len(CONCEPTS[c])} + 1]"
_SCORE = "0.45 * least((doc_id % 401) / 400, 1) + 0.35 * least((doc_id % 61) / 60, 1) + 0.20 * least((doc_id % 51) / 50, 1)"

SQL = {
    "v17_group_label": f"""
WITH g AS (SELECT user_id AS album, count(*) AS n, coalesce(list_sort(list(DISTINCT event_type) FILTER (value > 140)), []) AS p FROM events GROUP BY user_id),
l AS (SELECT *, CASE len(p) WHEN 0 THEN NULL WHEN 1 THEN p[1] WHEN 2 THEN p[1] || ' & ' || p[2] ELSE p[1] || ' & ' || p[2] || ' +' || (len(p) - 2) END AS who,
  CASE WHEN album % 4 <> 0 THEN {_PICK('action', 1)} END AS a, CASE WHEN album % 4 <> 0 THEN {_PICK('action', 7)} END AS b, CASE WHEN album % 3 <> 0 THEN ({_PICK('scene', 1)}).label END AS s, CASE WHEN album % 5 <> 0 THEN ({_PICK('shot', 1)}).label END AS h,
  CASE album % 4 WHEN 0 THEN 'Portrait' WHEN 1 THEN 'Couple Portrait' WHEN 2 THEN 'Group Portrait' ELSE CASE WHEN n % 2 = 0 THEN 'Portrait Sequence' ELSE 'Untitled scene' END END AS d FROM g),
r AS (SELECT *, a IS NOT NULL AND (list_contains(a.tags, 'audience') OR list_contains(a.tags, 'reaction')) AS react FROM l)
SELECT album, CASE WHEN react AND list_contains(b.tags, 'speech') THEN b.label || ' · Audience Reaction' WHEN react AND a.label = 'Audience Listening' THEN 'Audience Reaction' WHEN react THEN a.label
  WHEN a IS NOT NULL AND list_contains(a.tags, 'portrait') AND who IS NOT NULL AND a.label NOT IN ('Portrait', 'Solo Portrait') THEN who || ' · ' || a.label WHEN a IS NOT NULL THEN a.label
  WHEN s IS NOT NULL AND h IS NOT NULL THEN s || ' · ' || h WHEN s IS NOT NULL THEN s WHEN h IS NOT NULL THEN h WHEN who IS NOT NULL THEN who || ' · Scene' ELSE d END AS label FROM r""",
    "c6_migrate_json": f"WITH {TIMELINE_SQL} SELECT photo, json_extract(props, '$.k')::INT AS k, NULL::DOUBLE AS added FROM t",
    "x13_codec": "SELECT o_orderkey, o_orderkey % 5 = 0 AS empty, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(o_orderstatus, '?') END AS o_orderstatus FROM orders",
    "x15_schema_evolution": "SELECT n_nationkey::BIGINT AS id, NULL::VARCHAR AS name, NULL::BOOLEAN AS active, n_regionkey AS extra FROM nation",
    "x16_json_documents": f"WITH {FILES_SQL} SELECT doc_id % 50 AS grp, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM f GROUP BY doc_id % 50",
    "x17_people_in_order": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation ORDER BY lower(n_name), id",
    "x9_canonical_edges": "SELECT least(l_suppkey, l_partkey % 100) AS l, greatest(l_suppkey, l_partkey % 100) AS r, count(*) AS n FROM lineitem GROUP BY ALL",
    "x3_blur_scan": f"WITH {FILES_SQL} SELECT path, round({_SCORE}, 10) AS score FROM f WHERE {_SCORE} < 0.45 ORDER BY {_SCORE}, path",
    "a20_summary": """
WITH t AS (SELECT user_id AS album, CASE WHEN event_type <> 'error' THEN floor(value / 20) END AS grp FROM events), s AS (SELECT album, grp, count(*) AS n FROM t WHERE grp IS NOT NULL GROUP BY ALL)
SELECT count(*) AS groups, round(avg(n), 8) AS mean_size, min(n) AS least, max(n) AS most, round(avg(album / 256), 10) AS mean_cohesion, sum(n)::BIGINT AS grouped, (SELECT count(*) FROM t WHERE grp IS NULL) AS ungrouped FROM s""",
    "f16_eye_weight": """
WITH a AS (SELECT event_id AS photo, coalesce(abs(CASE WHEN event_id % 6 <> 0 THEN value % 90 - 45 END), 0) AS y FROM events), g AS (SELECT *, greatest(0, least(1, (y - 25) / 40)) AS x FROM a)
SELECT photo, round(0.18 * CASE WHEN y <= 25 THEN 1 WHEN y >= 65 THEN 0.15 ELSE 1 - 0.85 * (x * x * (3 - 2 * x)) END, 11) AS eye_weight FROM g""",
}
