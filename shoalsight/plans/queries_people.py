"""Queries over hashes, duplicates, faces and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import faces
from ..functions.vectors import cosine_distance, dot, l2_normalize, norm
from ..operators.groups import people_frequency
from ..operators.hamming import bands, hamming, hamming_pairs
from ..operators.incremental import signature
from ..operators.vector_join import nearest, split_known, threshold_pairs
from ..scene_config import DuplicateConfig, FaceConfig
from .duplicates import candidate_pairs, duplicate_groups
from .people import face_clusters, photos_of_people, recognise
from .tables import COSINE, FILES_SQL, HASHES_SQL, VEC_SQL, files, table, timeline, vectors

DISTANCE = 18
WORDS = ["h0", "h1", "h2", "h3"]
NEAR = DuplicateConfig(maximum_phash_distance=DISTANCE)


def j1_dup_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256-bit hashes within 18 bits; equal hashes collapsed to their least id."""
    return hamming_pairs(files(spark, sf_dir), "doc_id", WORDS, DISTANCE)


def j2_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    nxt = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    return f.join(nxt, "doc_id").select("doc_id", hamming([F.col("p0"), F.col("p1")], [F.col("q0"), F.col("q1")]).cast("long").alias("distance"))


def j1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of the hashes: how many values each band has, and its widest group."""
    b = files(spark, sf_dir).select(F.explode(bands([F.col("p0"), F.col("p1")], 15)).alias("b")).select("b.band", "b.bits")
    return b.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("values"), F.max("n").alias("most"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return duplicate_groups(f, "doc_id", candidate_pairs(f, "doc_id", WORDS, ["d0", "d1"], NEAR))


def a1_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "component")


def a5_dup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).filter("is_best").select("component", "doc_id", "path")


def r1_dup_recommend_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir)
    detail = F.format_string("%dx%d • %d KB", "width", "height", F.floor(F.col("file_size") / 1024))
    return g.select("component", "doc_id", detail.alias("detail"), "recommended_delete")


def j3_face_strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_pairs(vectors(spark, sf_dir), "vec_id", "v", COSINE).select("l", "r", F.round("score", 6).alias("score"))


def a2_face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = face_clusters(vectors(spark, sf_dir), "vec_id", "v", COSINE)
    return c.groupBy("component").agg(F.max("cluster_size").alias("members"), F.max("representative").alias("representative"), F.sum("vec_id").alias("id_sum")).orderBy(F.desc("members"), "component")


def a7_face_cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return face_clusters(vectors(spark, sf_dir), "vec_id", "v", COSINE).filter("cluster_size > 1").select("vec_id", "component", "representative")


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the references: of each label the vector with the least id."""
    v = vectors(spark, sf_dir)
    return v, v.groupBy("label").agg(F.min("vec_id").alias("ref_id"), F.min_by("v", "vec_id").alias("ref_v"))


def j4_face_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, refs = _known(spark, sf_dir)
    return nearest(rows, "vec_id", "v", refs, "ref_id", "ref_v").select("vec_id", "ref", F.round("score", 6).alias("score"))


def j5_face_recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, refs = _known(spark, sf_dir)
    known, _ = recognise(rows, "vec_id", "v", refs, "ref_id", "ref_v", "label", FaceConfig(recognition_threshold=0.3))
    return known.select("vec_id", "ref", "person")


def j5_face_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, refs = _known(spark, sf_dir)
    return split_known(rows, nearest(rows, "vec_id", "v", refs, "ref_id", "ref_v"), "vec_id", 0.3)[1].select("vec_id")


def a9_known_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, refs = _known(spark, sf_dir)
    known, _ = recognise(rows, "vec_id", "v", refs, "ref_id", "ref_v", "label", FaceConfig(recognition_threshold=0.3))
    named = known.withColumn("path", F.col("vec_id") % 97)
    return photos_of_people(named, "person", "path").select("person", "photos", F.round("best", 6).alias("best"))


def j6_person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return vectors(spark, sf_dir).join(people, "label").select("vec_id", "name")


def a10_people_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir).withColumn("person", F.substring("event_type", 1, 2))
    p = people_frequency(e, ["album"], "person", "event_type")
    return p.select("album", F.array_join(F.transform("people", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias("people"))


def a11_db_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return signature(people, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


def v1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x * 3 + 0.1).alias("v"))
    n = v.withColumn("u", l2_normalize("v"))
    return n.select("vec_id", F.round(norm("v"), 8).alias("length"), F.round(norm("u"), 8).alias("unit"), F.round(dot("u", "v"), 8).alias("same"), F.round(cosine_distance("u", "u"), 8).alias("zero"))


def f5_face_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    g = faces.geometry(k % 37 - 9, k % 53 - 20, k % 61, k % 41 + 1, F.lit(64), F.lit(48))
    return p.select("p_partkey", g["area"].alias("area"), F.round(g["relative_area"], 8).alias("relative_area"), F.round(g["visible_ratio"], 8).alias("visible_ratio"), g["minimum_dimension"].alias("minimum_dimension"))


def f9_pose_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    pitch = F.when(F.col("photo") % 11 != 0, F.col("value") % 60)
    s = faces.pose_scores(F.col("value") % 80 - 5, pitch, F.col("album") % 50 - F.lit(20.0))
    return e.select("photo", *[F.round(v, 11).alias(k) for k, v in s.items()])


def f10_selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity calibration and our own weights; see ``functions.faces``."""
    v = vectors(spark, sf_dir)
    x = lambda i: F.least(F.lit(1.0), F.abs(F.get("v", F.lit(i))) * 4)
    names = list(faces.SELECTION)
    metrics = {n: (F.when(F.col("vec_id") % 7 != i, x(i)), x(i + 20)) for i, n in enumerate(names)}
    eye = faces.eye_weight(F.get("v", F.lit(40)) * 300)
    parts = {k: x(i + 30) for i, k in enumerate(faces.RELIABILITY)}
    use = {k: F.when(F.col("vec_id") % 5 != i, x(i + 10)) for i, k in enumerate(faces.EMBEDDING)}
    return v.select("vec_id", F.round(faces.selection_score(metrics, eye), 8).alias("selection"), F.round(faces.weighted_sum(parts, faces.RELIABILITY), 8).alias("reliability"), F.round(faces.weighted_sum(use, faces.EMBEDDING), 8).alias("utility"))


def f12_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    v = F.col("value")
    c = {
        "visible_ratio": v % 10 / 10, "minimum_dimension": F.col("album"), "sharpness_confidence": v % 7 / 7, "sharpness": v % 3 / 3, "exposure_confidence": v % 5 / 5, "exposure": v % 2 / 2,
        "yaw_score": F.when(F.col("photo") % 3 != 0, v % 9 / 9), "pitch_score": F.when(F.col("photo") % 4 != 0, v % 8 / 8), "closed_eye": F.col("photo") % 6 == 0,
    }
    return e.select("photo", F.array_join(faces.warnings(c), ",").alias("warnings"))


def f14_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timeline(spark, sf_dir)
    left, right = F.when(F.col("photo") % 3 != 0, F.col("album") / 160), F.when(F.col("photo") % 4 != 0, F.col("photo") % 100 / 128)
    return e.select("photo", faces.eye_label(left).alias("left_eye"), faces.eye_label(right).alias("right_eye"), F.round(faces.eyes_score(left, right, 4), 6).alias("eyes"))


def g8_photo_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition, layout and subject box of photos whose faces are the line items of an order."""
    l = table(spark, sf_dir, "lineitem").withColumn("f", F.struct(F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") % 300).cast("double").alias("y"), (F.col("l_quantity") * 3).alias("w"), (F.col("l_quantity") * 4 + F.col("l_linenumber")).alias("h")))
    o = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("f")).alias("boxes"))
    c = faces.composition(F.col("boxes"), F.lit(640), F.lit(480), F.lit(0.5))
    layout = faces.face_layout(F.col("boxes"), F.lit(640), F.lit(480), F.size("boxes") - 1)
    o = o.select("l_orderkey", "boxes", c["values"].alias("values"), layout.alias("layout"), c["shot_scale"].alias("shot_scale"), c["face_bucket"].alias("face_bucket"), c["cx"].alias("cx"), c["hspread"].alias("hspread"), c["face_area_ratio"].alias("area"))
    box = faces.subject_box(F.col("boxes"), F.lit(640), F.lit(480))
    return o.select(
        "l_orderkey", "shot_scale", "face_bucket", F.round("cx", 13).alias("cx"), F.round("hspread", 9).alias("hspread"), F.round("area", 13).alias("area"), F.round(norm("values"), 6).alias("unit"), F.size("layout").alias("layout_size"),
        F.round(norm(faces.scale_summary(F.col("layout"))), 6).alias("summary_unit"), F.floor(F.get(box, 0) * 100).alias("box_left"),
    )


QUERIES = {f.__name__: f for f in (j1_dup_hash_pairs, j1_bands, j2_hamming, a1_dup_groups, a5_dup_best, r1_dup_recommend_delete, j3_face_strong_edges, a2_face_clusters, a7_face_cluster_representative, j4_face_nearest, j5_face_recognized, j5_face_unknown, a9_known_people, j6_person_lookup, a10_people_frequency, a11_db_signature, v1_normalize, f5_face_geometry, f9_pose_quality, f10_selection_score, f12_warnings, f14_eyes, g8_photo_descriptors)}

_H = f"WITH RECURSIVE {FILES_SQL}, {HASHES_SQL}"
_APART = lambda names: " + ".join(f"bit_count(xor(a.{w}, b.{w}))::INT" for w in names)
_DUP = f"""{_H}, e AS (
  SELECT a.doc_id AS l, b.doc_id AS r FROM h a JOIN h b ON a.doc_id < b.doc_id AND {_APART(WORDS)} <= {DISTANCE} AND {_APART(("d0", "d1"))} <= {NEAR.maximum_dhash_distance}
), s AS (SELECT l AS a, r AS b FROM e UNION ALL SELECT r, l FROM e), c(id, root) AS (
  SELECT DISTINCT a, a FROM s UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.id
), g AS (SELECT id AS doc_id, min(root) AS component FROM c GROUP BY id), o AS (
  SELECT g.component, f.*, row_number() OVER (PARTITION BY component ORDER BY width * height DESC, regexp_extract(path, '[^/]+$') DESC, path) = 1 AS is_best FROM g JOIN f ON f.doc_id = g.doc_id
)"""
_EDGE = f"e AS (SELECT a.vec_id AS l, b.vec_id AS r, list_inner_product(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= {COSINE})"
_CLUSTERS = f"""WITH RECURSIVE {VEC_SQL}, {_EDGE}, s AS (SELECT l AS a, r AS b FROM e UNION ALL SELECT r, l FROM e), c(id, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.id
), g AS (SELECT id AS vec_id, min(root) AS component FROM c GROUP BY id), q AS (
  SELECT x.component, x.vec_id, round(sum(list_inner_product(a.v, b.v)), 9) AS s FROM g x JOIN g y ON x.component = y.component JOIN v a ON a.vec_id = x.vec_id JOIN v b ON b.vec_id = y.vec_id GROUP BY ALL
), m AS (SELECT component, arg_min(vec_id, (-s, vec_id)) AS representative, count(*) AS members, sum(vec_id)::BIGINT AS id_sum FROM q GROUP BY component)"""
_NEAREST = f"""WITH {VEC_SQL}, k AS (SELECT label, min(vec_id) AS ref, arg_min(v, vec_id) AS kv FROM v GROUP BY label),
p AS (SELECT a.vec_id, k.ref, k.label, list_inner_product(a.v, k.kv) AS score FROM v a, k),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ref) = 1)"""
_SS = lambda a, b, x: f"pow(greatest(0, least(1, ({x} - {a}) / ({b} - {a}))), 2) * (3 - 2 * greatest(0, least(1, ({x} - {a}) / ({b} - {a}))))"
_X = lambda i: f"least(1, abs(v[{i + 1}]) * 4)"
_EYE = "abs(v[41] * 300)"


def _selection_sql() -> str:
    weights = {n: w for n, (w, _) in faces.SELECTION.items()}
    eye = f"0.18 * CASE WHEN {_EYE} <= 25 THEN 1 WHEN {_EYE} >= 65 THEN 0.15 ELSE 1 - 0.85 * ({_SS(25, 65, _EYE)}) END"
    total, used = [], []
    for i, n in enumerate(weights):
        w = f"({eye})" if n == "eyes" else str(weights[n])
        total.append(f"{w} * CASE WHEN vec_id % 7 = {i} THEN 0.5 ELSE {_X(i + 20)} * {_X(i)} + (1 - {_X(i + 20)}) * 0.5 END")
        used.append(w)
    rel = " + ".join(f"{w} * {_X(i + 30)}" for i, w in enumerate(faces.RELIABILITY.values()))
    use = " + ".join(f"CASE WHEN vec_id % 5 <> {i} THEN {w} * {_X(i + 10)} ELSE 0 END" for i, w in enumerate(faces.EMBEDDING.values()))
    used2 = " + ".join(f"CASE WHEN vec_id % 5 <> {i} THEN {w} ELSE 0 END" for i, w in enumerate(faces.EMBEDDING.values()))
    return f"WITH {VEC_SQL} SELECT vec_id, round(({' + '.join(total)}) / ({' + '.join(used)}), 8) AS selection, round({rel}, 8) AS reliability, round(({use}) / ({used2}), 8) AS utility FROM v"


SQL = {
    "j1_dup_hash_pairs": f"""{_H}, u AS (SELECT h0, h1, h2, h3, min(doc_id) AS k FROM h GROUP BY ALL)
SELECT a.k AS l, b.k AS r, ({_APART(WORDS)})::INT AS distance FROM u a JOIN u b ON a.k < b.k AND {_APART(WORDS)} <= {DISTANCE}""",
    "j1_bands": f"""WITH {FILES_SQL}, d AS (SELECT md5, unnest(range(0, 16)) AS band FROM f), n AS (SELECT band, md5[band * 2 + 1:band * 2 + 2] AS bits, count(*) AS n FROM d GROUP BY ALL)
SELECT band::INT AS band, count(*) AS values, max(n) AS most FROM n GROUP BY band""",
    "j2_hamming": f"{_H} SELECT a.doc_id, (bit_count(xor(a.p0, b.p0)) + bit_count(xor(a.p1, b.p1)))::BIGINT AS distance FROM h a JOIN h b ON b.doc_id = a.doc_id + 1",
    "a1_dup_groups": f"{_DUP} SELECT component, count(*) AS members FROM o GROUP BY component HAVING count(*) > 1 ORDER BY members DESC, component",
    "a5_dup_best": f"{_DUP} SELECT component, doc_id, path FROM o WHERE is_best",
    "r1_dup_recommend_delete": f"{_DUP} SELECT component, doc_id, printf('%dx%d • %d KB', width, height, file_size // 1024) AS detail, NOT is_best AS recommended_delete FROM o",
    "j3_face_strong_edges": f"WITH {VEC_SQL}, {_EDGE} SELECT l, r, round(score, 6) AS score FROM e",
    "a2_face_clusters": f"{_CLUSTERS} SELECT component, members, representative, id_sum FROM m ORDER BY members DESC, component",
    "a7_face_cluster_representative": f"{_CLUSTERS} SELECT g.vec_id, g.component, m.representative FROM g JOIN m ON g.component = m.component WHERE m.members > 1",
    "j4_face_nearest": f"{_NEAREST} SELECT vec_id, ref, round(score, 6) AS score FROM n",
    "j5_face_recognized": f"{_NEAREST} SELECT vec_id, ref, label AS person FROM n WHERE score >= 0.3",
    "j5_face_unknown": f"{_NEAREST} SELECT vec_id FROM n WHERE score < 0.3",
    "a9_known_people": f"{_NEAREST} SELECT label AS person, count(DISTINCT vec_id % 97) AS photos, round(max(score), 6) AS best FROM n WHERE score >= 0.3 GROUP BY label ORDER BY photos DESC, person",
    "j6_person_lookup": "SELECT vec_id, n_name AS name FROM embeddings JOIN nation ON label = n_nationkey",
    "a10_people_frequency": """
WITH c AS (SELECT user_id AS album, event_type AS name, count(*) AS n FROM events GROUP BY ALL)
SELECT album, string_agg(name || ':' || n, ',' ORDER BY n DESC, lower(name)) AS people FROM c GROUP BY album""",
    "a11_db_signature": "SELECT concat_ws(':', (SELECT count(*) FROM nation), (SELECT max(n_nationkey) FROM nation), (SELECT count(*) FROM embeddings), (SELECT max(vec_id) FROM embeddings)) AS signature",
    "v1_normalize": f"WITH {VEC_SQL}, x AS (SELECT vec_id, list_transform(v, lambda y: y * 3 + 0.1) AS v FROM v), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM x) SELECT vec_id, round(n, 8) AS length, 1.0::DOUBLE AS unit, round(n, 8) AS same, 0.0::DOUBLE AS zero FROM n",
    "f5_face_geometry": """
WITH b AS (SELECT p_partkey, p_partkey % 37 - 9 AS x, p_partkey % 53 - 20 AS y, p_partkey % 61 AS w, p_partkey % 41 + 1 AS h FROM part),
v AS (SELECT *, greatest(0, greatest(0, least(x + w, 64)) - greatest(0, least(x, 64))) * greatest(0, greatest(0, least(y + h, 48)) - greatest(0, least(y, 48))) AS seen FROM b)
SELECT p_partkey, w * h AS area, round(w * h / 3072, 8) AS relative_area, round(CASE WHEN w * h > 0 THEN seen / (w * h) ELSE 0 END, 8) AS visible_ratio, least(w, h) AS minimum_dimension FROM v""",
    "f9_pose_quality": f"""
WITH a AS (SELECT event_id AS photo, abs(value % 80 - 5) AS y, abs(CASE WHEN event_id % 11 <> 0 THEN value % 60 END) AS p, abs(user_id % 50 - 20.0::DOUBLE) AS r FROM events),
s AS (SELECT photo, p IS NOT NULL AS k, 1 - 0.70 * ({_SS(18, 68, 'y')}) AS y, 1 - 0.65 * ({_SS(14, 50, 'p')}) AS p, 1 - 0.45 * ({_SS(12, 45, 'r')}) AS r FROM a)
SELECT photo, CASE WHEN k THEN round(y, 11) END AS yaw_score, CASE WHEN k THEN round(p, 11) END AS pitch_score, CASE WHEN k THEN round(r, 11) END AS roll_score, CASE WHEN k THEN round(0.5 * y + 0.3 * p + 0.2 * r, 11) END AS pose_quality FROM s""",
    "f10_selection_score": _selection_sql(),
    "f12_warnings": """
SELECT event_id AS photo, array_to_string(list_filter([
  CASE WHEN value % 10 / 10 < 0.82 THEN 'face_partially_outside_image' END, CASE WHEN user_id < 48 THEN 'face_too_small_for_reliable_analysis' END,
  CASE WHEN value % 7 / 7 >= 0.45 AND value % 3 / 3 < 0.24 THEN 'face_soft_or_blurred' END, CASE WHEN value % 5 / 5 >= 0.45 AND value % 2 / 2 < 0.27 THEN 'face_exposure_problem' END,
  CASE WHEN (event_id % 3 <> 0 AND value % 9 / 9 < 0.40) OR (event_id % 4 <> 0 AND value % 8 / 8 < 0.45) THEN 'extreme_head_pose' END, CASE WHEN event_id % 6 = 0 THEN 'closed_eye_detected' END
], lambda x: x IS NOT NULL), ',') AS warnings FROM events""",
    "f14_eyes": """
WITH e AS (SELECT event_id AS photo, CASE WHEN event_id % 3 <> 0 THEN user_id / 160 END AS l, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 / 128 END AS r FROM events),
x AS (SELECT *, round_even(l, 4) AS a, round_even(r, 4) AS b FROM e)
SELECT photo, CASE WHEN l IS NULL THEN 'unassessed' WHEN l >= 0.88 THEN 'open' WHEN 1 - l >= 0.88 THEN 'closed' WHEN l >= 0.70 THEN 'likely_open' WHEN 1 - l >= 0.70 THEN 'likely_closed' ELSE 'uncertain' END AS left_eye,
  CASE WHEN r IS NULL THEN 'unassessed' WHEN r >= 0.88 THEN 'open' WHEN 1 - r >= 0.88 THEN 'closed' WHEN r >= 0.70 THEN 'likely_open' WHEN 1 - r >= 0.70 THEN 'likely_closed' ELSE 'uncertain' END AS right_eye,
  CASE WHEN coalesce(a, b) IS NOT NULL THEN round(least(1, 0.70 * least(coalesce(a, b), coalesce(b, a)) + 0.30 * (coalesce(a, b) + coalesce(b, a)) / 2), 6) END AS eyes FROM x""",
    "g8_photo_descriptors": """
WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, (l_partkey % 500)::DOUBLE AS x, (l_suppkey % 300)::DOUBLE AS y, l_quantity * 3 AS w, l_quantity * 4 + l_linenumber AS h FROM lineitem),
a AS (SELECT *, greatest(0, least(1, w * h / (640 * 480))) AS area, (x + w / 2) / 640 AS c FROM b),
g AS (SELECT l_orderkey, count(*) AS n, max(area) AS top, sum(area) AS area, avg(c) AS cx, coalesce(CASE WHEN count(*) > 1 THEN stddev_pop(c) END, 0) AS s, min(x) AS l, max(x + w) AS r FROM a GROUP BY l_orderkey),
k AS (SELECT *, greatest(0, (l - (r - l) * 0.35) / 640) AS a, least(1, (r + (r - l) * 0.35) / 640) AS b FROM g)
SELECT l_orderkey, CASE WHEN top >= 0.18 THEN 'close' WHEN top >= 0.08 THEN 'medium' WHEN top >= 0.03 THEN 'full_body' ELSE 'wide' END AS shot_scale,
  CASE WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'couple' WHEN n <= 4 THEN 'small_group' ELSE 'crowd' END AS face_bucket, round(cx, 13) AS cx, round(s, 9) AS hspread, round(area, 13) AS area, 1.0::DOUBLE AS unit, 24 AS layout_size,
  1.0::DOUBLE AS summary_unit, floor(round_even(CASE WHEN b - a < 0.1 THEN greatest(0, (a + b) / 2 - 0.15) ELSE a END, 4) * 100)::BIGINT AS box_left FROM k""",
}
