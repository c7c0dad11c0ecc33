"""Queries over the photo timeline: sessions, transitions, boundaries, segments, graph edges, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_number
from ..functions.scene import time_similarity
from ..functions.vectors import clip01, dot, set_similarity
from ..operators import groups, prototypes
from ..operators.scenes import scene_groups
from ..operators.timeline import crossed, running_count, sessionize, support, with_neighbours
from ..operators.vector_join import knn
from ..scene_config import SceneConfig
from .tables import TIMELINE_SQL, VEC_SQL, timeline, vectors, with_vectors

SOFT, HARD = 0.55, 0.80


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(timeline(spark, sf_dir), ["album"], "ts", "photo")


def w1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("album", "photo", "session")


def w1_sessions_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of one tag stay together over the session gap."""
    t = timeline(spark, sf_dir)
    s = sessionize(t, ["album"], "ts", "photo", alike=F.col("_before_1.v") == F.col("event_type"), value=F.col("event_type"))
    return s.select("album", "photo", "session")


def a18_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    return s.groupBy("album", "session").agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min_by("photo", F.struct("ts", "photo")).alias("first"), F.max_by("photo", F.struct("ts", "photo")).alias("last"),
        F.round(F.max("ts") - F.min("ts"), 3).alias("duration"),
    )


def w2_day_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_neighbours(timeline(spark, sf_dir), ["album"], "ts", "photo", F.col("ts"))
    return t.filter(day_number(F.col("ts")) != day_number(F.col("_before_1"))).select("album", "photo")


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change: mean of a value change and a time change between neighbours; hard, soft by thresholds; pos in the album."""
    t = running_count(timeline(spark, sf_dir), ["album"], "ts", "photo", F.lit(True), "pos").withColumn("pos", F.col("pos") - 1)
    t = with_neighbours(t, ["album"], "ts", "photo", F.struct("ts", "value", "photo"), before=0, after=1)
    value = F.abs(F.col("value") - F.col("_after_1.value")) / 250
    change = clip01((F.least(value, F.lit(1.0)) + 1.0 - time_similarity(F.col("_after_1.ts") - F.col("ts"), 43200.0)) / 2.0)
    t = t.withColumn("next_photo", F.col("_after_1.photo")).withColumn("change", change).drop("_after_1")
    return t.withColumns({"hard": F.coalesce(F.col("change") >= HARD, F.lit(False)), "soft": F.coalesce((F.col("change") >= SOFT) & (F.col("change") < HARD), F.lit(False))})


def w3_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir).filter("next_photo is not null").select("album", "photo", "next_photo", F.round("change", 8).alias("change"), "hard", "soft")


def w4_boundary_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir).filter("next_photo is not null").withColumn("likeness", 1.0 - F.col("change"))
    t = with_neighbours(t, ["album"], "ts", "photo", F.col("likeness"), before=1, after=2)
    s = support(F.col("_before_1"), [F.col("_after_1"), F.col("_after_2")], F.col("likeness"))
    return t.select("album", "photo", F.round(s, 8).alias("support"))


def w7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_neighbours(_transitions(spark, sf_dir), ["album"], "ts", "photo", F.col("hard") | F.col("soft"))
    t = running_count(t, ["album"], "ts", "photo", F.coalesce("_before_1", F.lit(False)), "segment")
    return t.groupBy("album", "segment").agg(F.count(F.lit(1)).alias("photos"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def j11_boundary_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir)
    pairs = t.select("album", F.col("pos").alias("l_pos"), (F.col("pos") + 5).alias("r_pos"))
    return crossed(t, pairs, ["album"]).select("album", "l_pos", "r_pos", "crossed_hard", "crossed_soft")


def j8_timeline_band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours up to three photos later whose values are alike, threshold lowered by 0.03."""
    t = with_neighbours(timeline(spark, sf_dir), ["album"], "ts", "photo", F.struct("photo", "value"), before=0, after=3)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"_after_{k}").alias("o")) for k in (1, 2, 3)])).alias("s")
    e = t.select("album", F.col("photo").alias("l"), "value", steps).filter("s.o is not null")
    score = F.exp(-F.abs(F.col("value") - F.col("s.o.value")) / 100)
    return e.withColumn("score", score).filter(F.col("score") >= 0.74 - 0.03).select("album", "l", F.col("s.o.photo").alias("r"), "s.step", F.round("score", 8).alias("score"))


def a14_transition_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir).filter("next_photo is not null").withColumn("change", F.round("change", 8))
    d = groups.distribution(t, "change", ["hard", "soft"])
    return d.withColumn("median", F.round("median", 7))


def a14_small_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    d = groups.small_distribution(F.col("v"))
    return v.select("vec_id", *[F.round(x, 7).alias(k) for k, x in d.items()])


def w11_gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of the photos that are no errors: over two missing positions or 12 hours start a new one."""
    t = _transitions(spark, sf_dir).filter("event_type <> 'error'")
    i = groups.islands(t, ["album"], "pos", "ts", 2, 43200.0)
    return i.groupBy("album", "island").agg(F.count(F.lit(1)).alias("photos"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def a16_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir).filter("event_type = 'view'").withColumn("part", F.floor(F.col("pos") / 10))
    return groups.contiguity(t, ["album", "part"], "pos").select("album", "part", "n", "span", "missing", "gaps", F.round("contiguity", 8).alias("contiguity"))


def a17_mode_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.dominant(timeline(spark, sf_dir), ["album"], "event_type", "photo")


def a15_group_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).withColumn("ts", F.when(F.col("photo") % 13 != 0, F.col("ts")))
    return t.groupBy("album").agg(F.round(F.min("ts"), 3).alias("start"), F.round(F.max("ts"), 3).alias("end"), F.bool_or(F.col("ts").isNull()).alias("any_untimed"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of about 25 vectors of one label."""
    return vectors(spark, sf_dir).withColumn("grp", F.col("label") * 100 + F.floor(F.col("vec_id") / 250))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    l, r = m.select("grp", F.col("vec_id").alias("l"), F.col("v").alias("lv")), m.select("grp", F.col("vec_id").alias("r"), F.col("v").alias("rv"))
    return l.join(r, "grp").filter("l < r").select("grp", "l", "r", clip01(dot("lv", "rv")).alias("combined"))


def j7_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(_members(spark, sf_dir), ["grp"], "vec_id", "v", 6).select("grp", "l", "r", "rank", F.round("score", 6).alias("score"))


def j9_edge_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason why a neighbour edge is turned down, or admitted; each undirected edge once, the best score kept."""
    return _edges(spark, sf_dir).filter("reason = 'admitted'").groupBy("grp", "a", "b").agg(F.round(F.max("adjusted"), 6).alias("score"))


def j10_rejected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("reason <> 'admitted'").groupBy("grp", "a", "b").agg(F.min_by("reason", F.struct("rank", "l")).alias("reason"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = knn(_members(spark, sf_dir), ["grp"], "vec_id", "v", 6).withColumns({"a": F.least("l", "r"), "b": F.greatest("l", "r")})
    soft = F.floor(F.col("a") / 40) != F.floor(F.col("b") / 40)
    adjusted = F.when(soft, F.greatest(F.lit(0.0), F.col("score") - 0.05)).otherwise(F.col("score"))
    reason = (
        F.when(F.floor(F.col("a") / 120) != F.floor(F.col("b") / 120), "crossed_hard_boundary").when((F.col("b") - F.col("a") > 100) & (F.col("score") < 0.3), "timeline_distance")
        .when(soft & (adjusted < 0.15), "crossed_soft_boundary_below_threshold").when(adjusted < 0.2, "low_similarity").otherwise("admitted")
    )
    return e.withColumns({"adjusted": adjusted, "reason": reason})


def a6_group_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.medoid(_members(spark, sf_dir).select("grp", "vec_id"), _pairs(spark, sf_dir), ["grp"], "vec_id", "combined").select("grp", "vec_id", F.round("row_sum", 6).alias("row_sum"))


def a8_group_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = groups.cohesion(_pairs(spark, sf_dir).withColumn("semantic", F.col("combined")), ["grp"])
    return c.select("grp", "n_pairs", F.round("semantic", 7).alias("semantic"), F.round("lower_percentile", 7).alias("lower_percentile"))


def w15_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value (null as -1), nearness to the upper median time, then id, in each album and tag."""
    t = timeline(spark, sf_dir).withColumn("value", F.when(F.col("photo") % 5 != 0, F.floor(F.col("value") / 100)))
    keys = ["album", "event_type"]
    counts = Window.partitionBy(*keys)
    rank = F.row_number().over(counts.orderBy("ts", "photo"))
    t = t.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(counts)})
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("ts"))).over(counts)
    t = t.withColumn("away", F.abs(F.col("ts") - middle))
    return groups.best_of(t, keys, [F.coalesce("value", F.lit(-1)).desc(), F.round("away", 6).asc(), F.col("photo").asc()]).filter("is_best").select(*keys, "photo")


def _prototypes(spark: SparkSession, sf_dir: str):
    """One prototype for each label: its vector with the least id (ten rows)."""
    import numpy as np

    rows = vectors(spark, sf_dir).groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).orderBy("label").collect()
    names = spark.createDataFrame([(i, f"label_{r['label']}") for i, r in enumerate(rows)], "ord int, name string")
    return np.array([r["v"] for r in rows]), names


def v5_prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _prototypes(spark, sf_dir)
    s = prototypes.prototype_scores(vectors(spark, sf_dir), "vec_id", "v", p)
    return s.select("vec_id", F.posexplode("scores").alias("ord", "score")).select("vec_id", "ord", F.round("score", 6).alias("score"))


def o4_prototype_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, names = _prototypes(spark, sf_dir)
    s = prototypes.prototype_scores(vectors(spark, sf_dir), "vec_id", "v", p)
    return prototypes.top_k(s, "vec_id", names, 3).select("vec_id", "rank", "name", F.round("score", 4).alias("score"))


def v6_action_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, names = _prototypes(spark, sf_dir)
    s = prototypes.top_k(prototypes.prototype_scores(vectors(spark, sf_dir), "vec_id", "v", p), "vec_id", names, 3)
    return prototypes.margins(s, "vec_id", 0.012, 0.025).select("vec_id", "name", F.round("margin", 6).alias("margin"), "confident", "strongly_confident")


def a13_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = groups.mean_vector(vectors(spark, sf_dir), ["label"], "v")
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 7).alias("x"))


def v10_pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, people and value likeness of neighbours, renormalised over what is available."""
    t = timeline(spark, sf_dir).withColumns({"people": F.filter(F.array(F.when(F.col("photo") % 4 != 0, F.col("event_type")), F.when(F.col("photo") % 3 == 0, F.lit("view"))), lambda x: x.isNotNull())})
    t = with_neighbours(t, ["album"], "ts", "photo", F.struct("ts", "people", "value"), before=0, after=1).filter("_after_1 is not null")
    time = time_similarity(F.col("_after_1.ts") - F.col("ts"), 1200.0)
    people = set_similarity(F.array_distinct("people"), F.array_distinct("_after_1.people"))
    layout = F.when((F.col("photo") % 2 == 0), F.exp(-F.abs(F.col("value") - F.col("_after_1.value")) / 50))
    weight = 0.04 + 0.08 + F.when(layout.isNotNull(), 0.13).otherwise(0.0)
    combined = clip01((0.04 * time + 0.08 * people + F.coalesce(0.13 * layout, F.lit(0.0))) / weight)
    return t.select("album", "photo", F.round(time, 8).alias("time"), F.round(people, 8).alias("people"), F.round(combined, 8).alias("combined"))


def w17_scene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scene pipeline over the events, each with the vector of its number; not expressible in SQL."""
    t, add = with_vectors(spark, sf_dir, timeline(spark, sf_dir).drop("props"), lambda n: F.floor(F.col("photo") / 5) % n)
    null = F.lit(None).cast("array<double>")
    meta = F.struct(F.lit("landscape").alias("orientation"), F.lit("wide").alias("shot_scale"), F.lit("one").alias("face_bucket"), F.lit("solo").alias("participant_mode"), *[F.lit(0.5).alias(k) for k in ("cx", "cy", "hspread", "vspread", "scale")])
    photos = t.select(F.col("album").cast("string").alias("album"), F.lpad(F.col("photo").cast("string"), 10, "0").alias("path"), "ts", "vec_id", *[k for k in ("semantic",) if k in t.columns], "event_type", F.col("value").alias("quality"))

    def complete(df: DataFrame) -> DataFrame:
        f = {"people": F.array("event_type"), "subject": F.col("semantic"), "face_count": F.lit(1), "face_area": F.lit(0.1), "meta": meta}
        return add(df).withColumns(f | dict.fromkeys(("layout", "background", "composition", "color", "action_scores", "shot_scores"), null))

    loose = SceneConfig(maximum_adjacent_gap_within_scene_seconds=43200, maximum_scene_span_seconds=172800, session_gap_seconds=43200, maximum_hard_time_gap_seconds=86400, maximum_soft_time_gap_seconds=43200)
    return scene_groups(photos, loose, complete=complete)


QUERIES = {f.__name__: f for f in (w1_sessions, w1_sessions_alike, a18_session_rollup, w2_day_boundaries, w3_transitions, w4_boundary_support, w7_segments, j11_boundary_crossings, j8_timeline_band_edges, a14_transition_distribution, a14_small_distribution, w11_gaps_islands, a16_contiguity, a17_mode_participant, a15_group_time_range, j7_knn_graph, j9_edge_admission, j10_rejected_edges, a6_group_medoid, a8_group_cohesion, w15_representative, v5_prototype_scores, o4_prototype_topk, v6_action_margin, a13_mean_scores, v10_pair_components, w17_scene_groups)}

_BY = "PARTITION BY album ORDER BY ts, photo"


def _session_sql(alike: str = "false") -> str:
    return f"""WITH {TIMELINE_SQL}, p AS (SELECT *, lag(ts) OVER ({_BY}) AS pt, lag(event_type) OVER ({_BY}) AS pe FROM t),
o AS (SELECT *, CASE WHEN pt IS NOT NULL AND (ts - pt > 7200 OR (floor(ts / 86400) <> floor(pt / 86400) AND ts - pt >= 1800) OR (ts - pt > 1800 AND NOT ({alike}))) THEN 1 ELSE 0 END AS n FROM p),
s AS (SELECT *, (sum(n) OVER ({_BY} ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM o)"""


_TR = f"""WITH {TIMELINE_SQL}, p AS (SELECT *, row_number() OVER ({_BY}) - 1 AS pos, lead(ts) OVER ({_BY}) AS nt, lead(value) OVER ({_BY}) AS nv, lead(photo) OVER ({_BY}) AS next_photo FROM t),
q AS (SELECT *, greatest(0, least(1, (least(abs(value - nv) / 250, 1) + 1 - exp(-greatest(nt - ts, 0) / 43200)) / 2)) AS c FROM p),
x AS (SELECT *, CASE WHEN nt IS NOT NULL THEN c END AS change, nt IS NOT NULL AND c >= {HARD} AS hard, nt IS NOT NULL AND c >= {SOFT} AND c < {HARD} AS soft FROM q)"""
_MEM = f"{VEC_SQL}, m AS (SELECT *, label * 100 + vec_id // 250 AS grp FROM v)"
_PAIRS = f"WITH {_MEM}, p AS (SELECT a.grp, a.vec_id AS l, b.vec_id AS r, greatest(0, least(1, list_inner_product(a.v, b.v))) AS combined FROM m a JOIN m b ON a.grp = b.grp AND a.vec_id < b.vec_id)"
_KNN = f"WITH {_MEM}, k AS (SELECT a.grp, a.vec_id AS l, b.vec_id AS r, list_inner_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.grp, a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS rank FROM m a JOIN m b ON a.grp = b.grp AND a.vec_id <> b.vec_id QUALIFY rank <= 6)"
_ADM = f"""{_KNN}, e AS (SELECT *, least(l, r) AS a, greatest(l, r) AS b, least(l, r) // 40 <> greatest(l, r) // 40 AS soft FROM k),
d AS (SELECT *, CASE WHEN soft THEN greatest(0, score - 0.05) ELSE score END AS adjusted FROM e),
j AS (SELECT *, CASE WHEN a // 120 <> b // 120 THEN 'crossed_hard_boundary' WHEN b - a > 100 AND score < 0.3 THEN 'timeline_distance' WHEN soft AND adjusted < 0.15 THEN 'crossed_soft_boundary_below_threshold' WHEN adjusted < 0.2 THEN 'low_similarity' ELSE 'admitted' END AS reason FROM d)"""
_PROTO = f"""WITH {VEC_SQL}, p AS (SELECT label, arg_min(v, vec_id) AS pv, (row_number() OVER (ORDER BY label) - 1)::INT AS ord FROM v GROUP BY label),
s AS (SELECT v.vec_id, p.ord, 'label_' || p.label AS name, greatest(0, list_inner_product(v.v, p.pv)) AS s FROM v, p),
n AS (SELECT *, s / greatest(sqrt(sum(s * s) OVER (PARTITION BY vec_id)), 1e-12) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS rank FROM n)"""

SQL = {
    "w1_sessions": f"{_session_sql()} SELECT album, photo, session FROM s",
    "w1_sessions_alike": f"{_session_sql('pe = event_type')} SELECT album, photo, session FROM s",
    "a18_session_rollup": f"{_session_sql()} SELECT album, session, count(*) AS photos, count(*) FILTER (event_type = 'error') AS errors, arg_min(photo, (ts, photo)) AS first, arg_max(photo, (ts, photo)) AS last, round(max(ts) - min(ts), 3) AS duration FROM s GROUP BY album, session",
    "w2_day_boundaries": f"{_session_sql()} SELECT album, photo FROM s WHERE floor(ts / 86400) <> floor(pt / 86400)",
    "w3_transitions": f"{_TR} SELECT album, photo, next_photo, round(change, 8) AS change, hard, soft FROM x WHERE next_photo IS NOT NULL",
    "w4_boundary_support": f"""{_TR}, y AS (SELECT *, 1 - change AS k FROM x WHERE next_photo IS NOT NULL), z AS (SELECT *, lag(k) OVER ({_BY}) AS l, avg(k) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM y)
SELECT album, photo, round(CASE WHEN l IS NULL OR r IS NULL THEN greatest(0, 0.5 - k) ELSE greatest(0, (l + r) / 2 - k) END, 8) AS support FROM z""",
    "w7_segments": f"""{_TR}, y AS (SELECT *, coalesce(lag(hard OR soft) OVER ({_BY}), false)::INT AS o FROM x), z AS (SELECT *, (sum(o) OVER ({_BY} ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM y)
SELECT album, segment, count(*) AS photos, min(pos) AS first_pos, max(pos) AS last_pos FROM z GROUP BY album, segment""",
    "j11_boundary_crossings": f"{_TR} SELECT a.album, a.pos AS l_pos, a.pos + 5 AS r_pos, bool_or(b.hard) AS crossed_hard, bool_or(b.hard OR b.soft) AS crossed_soft FROM x a JOIN x e ON e.album = a.album AND e.pos = a.pos + 5 JOIN x b ON b.album = a.album AND b.pos >= a.pos AND b.pos < a.pos + 5 GROUP BY ALL",
    "j8_timeline_band_edges": f"""WITH {TIMELINE_SQL}, p AS (SELECT *, row_number() OVER ({_BY}) AS pos FROM t), e AS (SELECT a.album, a.photo AS l, b.photo AS r, (b.pos - a.pos)::INT AS step, exp(-abs(a.value - b.value) / 100) AS s FROM p a JOIN p b ON a.album = b.album AND b.pos BETWEEN a.pos + 1 AND a.pos + 3)
SELECT album, l, r, step, round(s, 8) AS score FROM e WHERE s >= 0.74 - 0.03""",
    "a14_transition_distribution": f"""{_TR}, y AS (SELECT round(change, 8) AS c, hard, soft FROM x WHERE next_photo IS NOT NULL), l AS (SELECT list(c ORDER BY c) AS v, count(*) AS n, count(*) FILTER (hard) AS hard, count(*) FILTER (soft) AS soft FROM y)
SELECT v[1] AS minimum, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 7) AS median, v[round_even((n - 1) * 0.75, 0)::BIGINT + 1] AS p75, v[round_even((n - 1) * 0.90, 0)::BIGINT + 1] AS p90, v[round_even((n - 1) * 0.95, 0)::BIGINT + 1] AS p95, v[n] AS maximum, hard, soft FROM l""",
    "a14_small_distribution": f"WITH {VEC_SQL}, s AS (SELECT vec_id, list_sort(v) AS v FROM v) SELECT vec_id, round(v[1], 7) AS minimum, round(v[48], 7) AS p75, round(v[58], 7) AS p90, round(v[61], 7) AS p95, round(v[64], 7) AS maximum FROM s",
    "w11_gaps_islands": f"""{_TR}, y AS (SELECT *, lag(pos) OVER (PARTITION BY album ORDER BY pos) AS lp, lag(ts) OVER (PARTITION BY album ORDER BY pos) AS lt FROM x WHERE event_type <> 'error'),
z AS (SELECT *, (sum(coalesce(pos - lp - 1 > 2 OR abs(ts - lt) > 43200, false)::INT) OVER (PARTITION BY album ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM y)
SELECT album, island, count(*) AS photos, min(pos) AS first_pos, max(pos) AS last_pos FROM z GROUP BY album, island""",
    "a16_contiguity": f"""{_TR}, y AS (SELECT *, pos // 10 AS part FROM x WHERE event_type = 'view'), z AS (SELECT *, pos - lag(pos) OVER (PARTITION BY album, part ORDER BY pos) > 1 AS g FROM y),
a AS (SELECT album, part, count(*) AS n, max(pos) - min(pos) + 1 AS span, count(*) FILTER (g) AS gaps FROM z GROUP BY album, part)
SELECT album, part, n, span, span - n AS missing, gaps, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0, least(1, 1 - least(0.7, (span - n) / span) - least(0.3, gaps * 0.1))) END, 8) AS contiguity FROM a""",
    "a17_mode_participant": "WITH c AS (SELECT user_id AS album, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT album, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY album ORDER BY n DESC, f) = 1",
    "a15_group_time_range": f"WITH {TIMELINE_SQL}, x AS (SELECT album, CASE WHEN photo % 13 <> 0 THEN ts END AS ts FROM t) SELECT album, round(min(ts), 3) AS start, round(max(ts), 3) AS end, bool_or(ts IS NULL) AS any_untimed FROM x GROUP BY album",
    "j7_knn_graph": f"{_KNN} SELECT grp, l, r, rank::INT AS rank, round(score, 6) AS score FROM k",
    "j9_edge_admission": f"{_ADM} SELECT grp, a, b, round(max(adjusted), 6) AS score FROM j WHERE reason = 'admitted' GROUP BY grp, a, b",
    "j10_rejected_edges": f"{_ADM} SELECT grp, a, b, arg_min(reason, (rank, l)) AS reason FROM j WHERE reason <> 'admitted' GROUP BY grp, a, b",
    "a6_group_medoid": f"""{_PAIRS}, s AS (SELECT grp, l AS vec_id, combined FROM p UNION ALL SELECT grp, r, combined FROM p), y AS (SELECT m.grp, m.vec_id, 1 + coalesce(sum(s.combined), 0) AS row_sum FROM m LEFT JOIN s ON s.grp = m.grp AND s.vec_id = m.vec_id GROUP BY ALL)
SELECT grp, vec_id, round(row_sum, 6) AS row_sum FROM y QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(row_sum, 9) DESC, vec_id) = 1""",
    "a8_group_cohesion": f"{_PAIRS} SELECT grp, count(*) AS n_pairs, round(avg(combined), 7) AS semantic, round(quantile_cont(combined, 0.2), 7) AS lower_percentile FROM p GROUP BY grp",
    "w15_representative": f"""WITH {TIMELINE_SQL}, x AS (SELECT *, CASE WHEN photo % 5 <> 0 THEN floor(value / 100) END AS v, row_number() OVER (PARTITION BY album, event_type ORDER BY ts, photo) AS r, count(*) OVER (PARTITION BY album, event_type) AS n FROM t),
m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN ts END) OVER (PARTITION BY album, event_type) AS mid FROM x)
SELECT album, event_type, photo FROM m QUALIFY row_number() OVER (PARTITION BY album, event_type ORDER BY coalesce(v, -1) DESC, round(abs(ts - mid), 6), photo) = 1""",
    "v5_prototype_scores": f"{_PROTO} SELECT vec_id, ord, round(score, 6) AS score FROM n",
    "o4_prototype_topk": f"{_PROTO} SELECT vec_id, rank::INT AS rank, name, round(score, 4) AS score FROM k WHERE rank <= 3 AND score > 0",
    "v6_action_margin": f"""{_PROTO}, t AS (SELECT vec_id, max(CASE WHEN rank = 1 THEN name END) AS name, max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS m FROM k WHERE rank <= 3 AND score > 0 GROUP BY vec_id)
SELECT vec_id, name, round(greatest(0, m), 6) AS margin, m >= 0.012 AS confident, m >= 0.025 AS strongly_confident FROM t""",
    "a13_mean_scores": f"WITH {VEC_SQL}, u AS (SELECT label, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS i FROM v) SELECT label, i, round(avg(x), 7) AS x FROM u GROUP BY label, i",
    "v10_pair_components": f"""WITH {TIMELINE_SQL}, a AS (SELECT *, list_distinct(list_filter([CASE WHEN photo % 4 <> 0 THEN event_type END, CASE WHEN photo % 3 = 0 THEN 'view' END], lambda x: x IS NOT NULL)) AS people FROM t),
b AS (SELECT *, lead(ts) OVER ({_BY}) AS nt, lead(people) OVER ({_BY}) AS np, lead(value) OVER ({_BY}) AS nv FROM a),
c AS (SELECT album, photo, exp(-greatest(nt - ts, 0) / 1200) AS tm, CASE WHEN len(people) = 0 AND len(np) = 0 THEN 0.5 WHEN len(people) = 0 OR len(np) = 0 THEN 0.35 ELSE len(list_intersect(people, np)) / len(list_distinct(list_concat(people, np))) END AS pp, CASE WHEN photo % 2 = 0 THEN exp(-abs(value - nv) / 50) END AS lay FROM b WHERE nt IS NOT NULL)
SELECT album, photo, round(tm, 8) AS time, round(pp, 8) AS people, round(greatest(0, least(1, (0.04 * tm + 0.08 * pp + coalesce(0.13 * lay, 0)) / (0.12 + CASE WHEN lay IS NOT NULL THEN 0.13 ELSE 0 END))), 8) AS combined FROM c""",
}
