"""Queries over results, caches and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import people_label
from ..functions.vectors import set_similarity
from ..operators import incremental, results
from .tables import FILES_SQL, files, table, timeline


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result items: orders in groups by customer nation key of 25."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 97).alias("grp"), F.concat(F.lit("Group "), (F.col("o_custkey") % 97).cast("string")).alias("title"), F.col("o_orderkey").alias("item"))


def o6_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(_items(spark, sf_dir), "grp", [F.col("item").asc()], number=5).select("n", "grp", "title", "item")


def o7_prefix_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.suggest(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name", "CUSTOMER#00000001", 20)


def o1_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of files inside their format by pixels, then name, both falling."""
    f = files(spark, sf_dir).withColumn("kind", results.kind_label(F.col("path")))
    from pyspark.sql import Window

    order = Window.partitionBy("kind").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("path"))
    return f.select("kind", "doc_id", F.row_number().over(order).alias("place"))


def a22_selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    items = f.select("path", F.when(F.col("doc_id") % 7 == 0, "face").otherwise("duplicate").alias("group_type"), (F.col("doc_id") % 3 == 0).alias("recommended_delete"))
    kept = f.filter("doc_id % 5 = 0").select("path", (F.col("doc_id") % 2 == 0).alias("selected"))
    gone = kept.limit(1).select(F.lit("/lib/gone.jpg").alias("path"), F.lit(True).alias("selected"))
    s = results.initial_selection(items, kept.unionByName(gone))
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if("selected").alias("selected"))


def e1_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard likeness of the tag sets of two albums that follow each other."""
    sets = timeline(spark, sf_dir).groupBy("album").agg(F.collect_set(F.when(F.col("value") > 150, F.col("event_type"))).alias("tags"))
    nxt = sets.select((F.col("album") - 1).alias("album"), F.col("tags").alias("other"))
    empty = F.array().cast("array<string>")
    return sets.join(nxt, "album", "full").select("album", F.round(set_similarity(F.coalesce("tags", empty), F.coalesce("other", empty)), 8).alias("similarity"))


def e3_union_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.lower("p_type").alias("ext")).union(p.select(F.lower(F.split("p_name", " ")[1]))).distinct()


def e4_groups_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    grouped = t.filter("event_type <> 'error'").select("photo", F.concat(F.lit("album "), F.col("album").cast("string")).alias("title"))
    return grouped.unionByName(t.filter("event_type = 'error'").select("photo", F.lit("Ungrouped").alias("title")))


def e5_stale_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("path").join(f.filter("doc_id % 4 <> 0").select("path"), "path", "left_anti")


def r2_people_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).groupBy("album").agg(F.sort_array(F.collect_set(F.when(F.col("photo") % 9 == 0, F.col("event_type")))).alias("names"))
    return t.select("album", people_label(F.col("names")).alias("label"), F.array_join(F.slice("names", 1, 3), ", ").alias("first_three"))


def k1_export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select(F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit("/IMG_"), (F.col("doc_id") % 50).cast("string"), F.lit(".jpg")).alias("path"))
    return results.export_names(f)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the files as they were: a third has changed since, a tenth is of an older version."""
    f = files(spark, sf_dir)
    return f.filter("doc_id % 6 <> 5").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "mtime_ns", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(2).alias("version"), F.when(F.col("doc_id") % 4 == 0, "s").alias("people"), F.col("doc_id").alias("payload"))


def j12_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_hits(files(spark, sf_dir), _cache(spark, sf_dir), 2).select("path", "payload")


def j13_null_safe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_hits(files(spark, sf_dir), _cache(spark, sf_dir), 2, {"people": F.lit(None).cast("string")}).select("path", "payload")


def j12_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.cache_misses(files(spark, sf_dir), _cache(spark, sf_dir), 2).select("path")


def c1_coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    old = f.filter("doc_id % 3 <> 0").select("path", F.col("width"), F.col("height"))
    new = f.filter("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 4 == 0, F.col("width") + 1000).alias("width"), (F.col("height") + 1000).alias("height"))
    return incremental.coalesce_upsert(old, new, "path")


def _face_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").cast("string").alias("path"), F.lit(1).cast("long").alias("file_size"), F.lit(1).cast("long").alias("mtime_ns"), F.when(F.col("l_orderkey") % 3 == 0, "recognized_only").otherwise("all_faces").alias("coverage"),
        F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("analysis"), "l_linenumber",
    )


def c3_usable_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.usable(_face_cache(spark, sf_dir), ["path"], need_unknown=True, need_analysis=True)


def c4_no_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _face_cache(spark, sf_dir)
    new = old.withColumn("coverage", F.when(F.col("path").cast("int") % 2 == 0, "all_faces").otherwise("recognized_only")).filter("l_linenumber < 3")
    kept = incremental.no_downgrade(old.select(*incremental.STATE, "coverage").distinct(), new)
    return incremental.replace_children(old, kept, "path").groupBy("path").agg(F.count(F.lit(1)).alias("faces"), F.max("coverage").alias("coverage"))


def c9_group_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = files(spark, sf_dir).groupBy((F.col("doc_id") % 40).alias("grp")).agg(F.collect_list("path").alias("paths"))
    return g.select("grp", incremental.group_id(F.col("paths"), {"algorithm_version": "7", "model_fingerprint": "m"}).alias("group_id"))


def c10_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" nation_"), (F.col("c_custkey") % 40).cast("string"))).otherwise(F.lit("  ")).alias("name"))
    return incremental.insert_missing(n, new, "name")


def a12_image_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _face_cache(spark, sf_dir)
    return f.groupBy("path").agg(F.count(F.lit(1)).alias("faces"), F.count("analysis").alias("analysed"), F.max("analysis").alias("best"))


def a19_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and share of each stage of a scan, and the largest stage: tags as stages, values as seconds."""
    s = timeline(spark, sf_dir).groupBy("album", "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("s"))
    a = s.groupBy("album").agg(F.sum("s").alias("total"), F.max_by("event_type", F.struct("s", "event_type")).alias("largest"), F.max("s").alias("most"))
    return a.select("album", F.round(F.col("total").cast("double"), 2).alias("total"), "largest", F.round(F.col("most").cast("double") / F.col("total").cast("double") * 100, 6).alias("percent"))


def x14_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows to an ordered array and back."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return l.select("l_orderkey", F.posexplode("c").alias("i", "x")).select("l_orderkey", "i", "x.l_linenumber", "x.l_partkey")


QUERIES = {f.__name__: f for f in (o6_pagination, o7_prefix_suggest, o1_group_order, a22_selection_counts, e1_set_similarity, e3_union_extensions, e4_groups_and_rest, e5_stale_selection, r2_people_summary, k1_export_names, j12_cache_hits, j13_null_safe_hits, j12_cache_misses, c1_coalesce_upsert, c3_usable_faces, c4_no_downgrade, c9_group_id, c10_insert_missing, a12_image_rollup, a19_stage_timings, x14_ordered_children)}

_CACHE = f"{FILES_SQL}, k AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN file_size + 1 ELSE file_size END AS file_size, mtime_ns, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN doc_id % 4 = 0 THEN 's' END AS people, doc_id AS payload FROM f WHERE doc_id % 6 <> 5)"
_FACES = "c AS (SELECT l_orderkey::VARCHAR AS path, CASE WHEN l_orderkey % 3 = 0 THEN 'recognized_only' ELSE 'all_faces' END AS coverage, CASE WHEN l_linenumber < 6 THEN l_quantity END AS analysis, l_linenumber FROM lineitem)"

SQL = {
    "o6_pagination": """
WITH i AS (SELECT o_custkey % 97 AS grp, o_orderkey AS item FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY grp, item) AS n, row_number() OVER (PARTITION BY grp ORDER BY item) AS k, count(*) OVER (PARTITION BY grp) AS c FROM i),
p AS (SELECT *, min(k) OVER (PARTITION BY grp) AS a, max(k) OVER (PARTITION BY grp) AS b FROM r WHERE n BETWEEN 241 AND 288)
SELECT n, grp, CASE WHEN a = 1 AND b = c THEN 'Group ' || grp ELSE printf('Group %d (%d-%d of %d)', grp, a, b, c) END AS title, item FROM p""",
    "o7_prefix_suggest": "SELECT c_name AS name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%' ORDER BY lower(c_name), c_name LIMIT 20",
    "o1_group_order": f"WITH {FILES_SQL} SELECT upper(regexp_extract(path, '[^.]+$')) AS kind, doc_id, (row_number() OVER (PARTITION BY upper(regexp_extract(path, '[^.]+$')) ORDER BY width * height DESC, path DESC))::INT AS place FROM f",
    "a22_selection_counts": "SELECT count(*) AS total, count(*) FILTER (CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 ELSE doc_id % 7 = 0 OR doc_id % 3 = 0 END) AS selected FROM documents",
    "e1_set_similarity": """
WITH s AS (SELECT user_id AS album, coalesce(list(DISTINCT event_type) FILTER (value > 150), []) AS t FROM events GROUP BY user_id), n AS (SELECT album - 1 AS album, t AS o FROM s)
SELECT coalesce(s.album, n.album) AS album, round(CASE WHEN coalesce(len(t), 0) = 0 AND coalesce(len(o), 0) = 0 THEN 0.5 WHEN coalesce(len(t), 0) = 0 OR coalesce(len(o), 0) = 0 THEN 0.35 ELSE len(list_intersect(t, o)) / len(list_distinct(list_concat(t, o))) END, 8) AS similarity FROM s FULL JOIN n ON s.album = n.album""",
    "e3_union_extensions": "SELECT lower(p_type) AS ext FROM part UNION SELECT lower(split_part(p_name, ' ', 2)) FROM part",
    "e4_groups_and_rest": "SELECT event_id AS photo, 'album ' || user_id AS title FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'Ungrouped' FROM events WHERE event_type = 'error'",
    "e5_stale_selection": f"WITH {FILES_SQL} SELECT path FROM f WHERE doc_id % 4 = 0",
    "r2_people_summary": """
WITH s AS (SELECT user_id AS album, coalesce(list_sort(list(DISTINCT event_type) FILTER (event_id % 9 = 0)), []) AS n FROM events GROUP BY user_id)
SELECT album, CASE len(n) WHEN 0 THEN NULL WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' & ' || n[2] ELSE n[1] || ' & ' || n[2] || ' +' || (len(n) - 2) END AS label, array_to_string(n[1:3], ', ') AS first_three FROM s""",
    "k1_export_names": """
WITH p AS (SELECT '/a/' || doc_id || '/IMG_' || doc_id % 50 || '.jpg' AS path, doc_id % 50 AS m FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY path) - 1 AS n FROM p)
SELECT path, 'IMG_' || m || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.jpg' AS target FROM r""",
    "j12_cache_hits": f"WITH {_CACHE} SELECT f.path, payload FROM f JOIN k ON f.path = k.path AND f.file_size = k.file_size AND f.mtime_ns = k.mtime_ns WHERE version = 2",
    "j13_null_safe_hits": f"WITH {_CACHE} SELECT f.path, payload FROM f JOIN k ON f.path = k.path AND f.file_size = k.file_size AND f.mtime_ns = k.mtime_ns WHERE version = 2 AND coalesce(people, '') = ''",
    "j12_cache_misses": f"WITH {_CACHE} SELECT f.path FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE f.path = k.path AND f.file_size = k.file_size AND f.mtime_ns = k.mtime_ns AND version = 2)",
    "c1_coalesce_upsert": f"""WITH {FILES_SQL}, o AS (SELECT path, width, height FROM f WHERE doc_id % 3 <> 0), n AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN width + 1000 END AS width, height + 1000 AS height FROM f WHERE doc_id % 2 = 0)
SELECT coalesce(n.path, o.path) AS path, coalesce(n.width, o.width) AS width, coalesce(n.height, o.height) AS height FROM o FULL JOIN n ON o.path = n.path""",
    "c3_usable_faces": f"WITH {_FACES} SELECT path, count(*) AS n FROM c GROUP BY path HAVING bool_and(coverage = 'all_faces') AND bool_and(analysis IS NOT NULL)",
    "c4_no_downgrade": f"""WITH {_FACES}, n AS (SELECT path, CASE WHEN path::INT % 2 = 0 THEN 'all_faces' ELSE 'recognized_only' END AS coverage FROM c WHERE l_linenumber < 3),
k AS (SELECT * FROM n WHERE coverage = 'all_faces' OR path::INT % 3 = 0 OR path NOT IN (SELECT path FROM c WHERE coverage = 'all_faces')), a AS (SELECT path, coverage FROM c WHERE path NOT IN (SELECT path FROM k) UNION ALL SELECT path, coverage FROM k)
SELECT path, count(*) AS faces, max(coverage) AS coverage FROM a GROUP BY path""",
    "c9_group_id": f"""WITH {FILES_SQL}, g AS (SELECT doc_id % 40 AS grp, string_agg('"' || path || '"', ', ' ORDER BY path) AS p FROM f GROUP BY doc_id % 40)
SELECT grp, sha1('{{"algorithm_version": "7", "model_fingerprint": "m", "paths": [' || p || ']}}')[1:12] AS group_id FROM g""",
    "c10_insert_missing": "SELECT n_name AS name FROM nation UNION ALL SELECT DISTINCT 'nation_' || c_custkey % 40 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 40 >= 25",
    "a12_image_rollup": f"WITH {_FACES} SELECT path, count(*) AS faces, count(analysis) AS analysed, max(analysis) AS best FROM c GROUP BY path",
    "a19_stage_timings": """
WITH s AS (SELECT user_id AS album, event_type, sum(value::DECIMAL(18, 2)) AS s FROM events GROUP BY ALL)
SELECT album, round(sum(s)::DOUBLE, 2) AS total, arg_max(event_type, (s, event_type)) AS largest, round(max(s)::DOUBLE / sum(s)::DOUBLE * 100, 6) AS percent FROM s GROUP BY album""",
    "x14_ordered_children": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS i, l_linenumber, l_partkey FROM d",
}
