"""Queries over the pair rules of scene grouping, and the same rules in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scene as rules
from ..functions.concepts import CONCEPTS
from ..operators.scenes import transitions
from ..operators.timeline import with_neighbours
from ..scene_config import SceneConfig
from .tables import TIMELINE_SQL, VEC_SQL, timeline, with_vectors

#: Events are hours apart where photos are seconds apart.
CONFIG = SceneConfig(
    session_gap_seconds=43200, maximum_soft_time_gap_seconds=43200, maximum_hard_time_gap_seconds=86400, maximum_adjacent_gap_within_scene_seconds=172800, maximum_scene_span_seconds=345600,
)
ORIENTATIONS, SHOT_SCALES = ("landscape", "portrait", "square"), ("close", "medium", "full_body", "wide")
MODES = ("none", "solo", "couple", "family_group", "small_group", "crowd")
_FEATURES = "photo ts semantic people layout subject background composition color action_scores face_count face_area meta action shot mode".split()


def _photos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The events with a vector, and what makes their features."""
    t, add = with_vectors(spark, sf_dir, timeline(spark, sf_dir).drop("props"), lambda n: (F.col("album") + F.floor(F.col("photo") % 5 / 4)) % n)
    return t, lambda df: _made(add(df))


def _made(t: DataFrame) -> DataFrame:
    """Adds the features of events with their vectors: everything but the vector is made of number and value."""
    k, v = F.col("photo"), F.col("value")
    when, null = (lambda at, x: F.when(at, x)), (lambda kind: F.lit(None).cast(kind))
    circle = lambda s: F.array(F.cos(v / s), F.sin(v / s))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    scores = lambda kind, a, m: F.transform(F.sequence(F.lit(0), F.lit(len(CONCEPTS[kind]) - 1)), lambda i: (k * (i + a)) % m / float(m))
    meta = F.struct(
        pick(ORIENTATIONS).alias("orientation"), pick(SHOT_SCALES).alias("shot_scale"), pick(rules.BUCKETS).alias("face_bucket"), pick(MODES).alias("participant_mode"),
        (k % 10 / 10).alias("cx"), (k % 7 / 7).alias("cy"), (k % 5 / 20).alias("hspread"), (k % 3 / 15).alias("vspread"), (k % 4 / 10).alias("scale"),
    )
    people = F.array_distinct(F.array_compact(F.array(when(k % 4 != 0, F.col("event_type")), when(k % 3 == 0, F.lit("view")))))
    return t.withColumns(
        {
            "people": people, "layout": when(k % 2 == 0, circle(100)), "subject": when(k % 5 != 0, circle(150)), "background": when(k % 7 != 0, circle(300)), "composition": when(k % 3 != 1, circle(200)), "color": null("array<double>"),
            "action_scores": when(k % 6 != 0, scores("action", 3, 101)), "shot_scores": when(k % 4 != 1, scores("shot", 5, 37)), "face_count": (k % 7).cast("int"), "face_area": when(k % 11 != 0, v / 2500), "meta": when(k % 9 != 0, meta),
        }
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature row for each event, with profiles."""
    t, complete = _photos(spark, sf_dir)
    return rules.with_profiles(complete(t), CONFIG)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo with the next of its album, with all pair components."""
    rows = _features(spark, sf_dir).withColumn("f", F.struct(*_FEATURES)).select("album", "photo", "ts", "f")
    rows = with_neighbours(rows, ["album"], "ts", "photo", F.col("f"), before=0, after=1).filter("_after_1 is not null")
    return rules.pair_components(rows, CONFIG, F.col("f"), F.col("_after_1"))


_SIMILARITIES = ("semantic", "action", "people", "layout", "subject", "background", "composition", "time")
_FLAGS = ("action_reliable", "action_soft_conflict", "action_hard_conflict", "participant_conflict", "shot_conflict", "main_vs_reaction")


def v9_photo_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a photo shows: best action and shot with their margins, and who takes part."""
    f = _features(spark, sf_dir)
    return f.select(
        "photo", F.col("action.key").alias("action"), F.col("action.family").alias("family"), F.round("action.margin", 8).alias("action_margin"), F.col("action.confident").alias("action_confident"), F.col("action.strong").alias("action_strong"),
        F.array_join("action.keys", ",").alias("action_keys"), F.col("shot.mode").alias("shot"), F.round("shot.margin", 8).alias("shot_margin"), F.col("shot.confident").alias("shot_confident"), "mode",
    )


def v12_pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities, conflicts and the combined score of neighbours."""
    p = _pairs(spark, sf_dir)
    return p.select("album", "photo", *[F.round(k, 7).alias(k) for k in _SIMILARITIES], *_FLAGS, F.round("combined", 7).alias("combined"))


def v14_transition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far neighbours are apart: change, reliability and its reasons, continuity and its reasons, override."""
    t = rules.transition(_pairs(spark, sf_dir), CONFIG, F.col("f"), F.col("_after_1"))
    join = lambda k: F.array_join(k, ",").alias(k)
    return t.select("album", "photo", F.round("change", 7).alias("change"), "reliability", join("reasons"), join("continuity_reasons"), F.round("continuity", 7).alias("continuity"), F.round("visual_support", 7).alias("visual_support"), "override")


def w3_scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, positions, transitions, their support by the photos around, and which boundaries are accepted."""
    photos, complete = _photos(spark, sf_dir)
    photos = photos.withColumn("path", F.lpad(F.col("photo").cast("string"), 12, "0"))
    t = transitions(photos, CONFIG, complete=complete, keep=["change", "reliability", "support", "accepted"])
    return t.select("album", F.col("path").cast("long").alias("photo"), "session", "pos", F.round("change", 7).alias("change"), "reliability", F.round("support", 7).alias("support"), "accepted")


QUERIES = {f.__name__: f for f in (v9_photo_profiles, v12_pair_rules, v14_transition_rules, w3_scene_boundaries)}


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END"


def _in(a: str, b: str, pairs) -> str:
    return f"coalesce(list_contains({_list('-'.join(sorted(p.split('-'))) for p in pairs)}, least({a}, {b}) || '-' || greatest({a}, {b})), false)"


def _cosine(k: str) -> str:
    return f"CASE WHEN l.{k} IS NULL OR r.{k} IS NULL THEN 0.5 ELSE {_clip(f'list_inner_product(l.{k}, r.{k})')} END"


def _sets(a: str, b: str, none: float, one: float) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {none} WHEN len({a}) = 0 OR len({b}) = 0 THEN {one} ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _steps(a: str, b: str, order, scores) -> str:
    at = lambda x: f"CASE WHEN list_contains({_list(order)}, {x}) THEN list_position({_list(order)}, {x}) ELSE {len(order)} END"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE [{scores[2]}, {scores[0]}, {scores[1]}, {scores[2]}, {scores[2]}][abs({at(a)} - {at(b)}) + 1] END"


def _scores(kind: str, a: int, m: int) -> str:
    return f"list_transform(range({len(CONCEPTS[kind])}), lambda i: (photo * (i + {a}) % {m}) / {m}.0::DOUBLE)"


def _top(column: str) -> str:
    ranked = f"list_sort(list_transform(range(len({column})), lambda i: {{'n': -{column}[i + 1], 'ord': i}}))[1:3]"
    return f"coalesce(list_filter({ranked}, lambda x: x.n < 0), [])"


_circle = lambda s: f"[cos(value / {s}), sin(value / {s})]"
_pick = lambda names: f"({_list(names)})[photo % {len(names)} + 1]"
_of = lambda kind, get: _list(get(c) for c in CONCEPTS[kind])
_detail = lambda kind: _of(kind, lambda c: "y" if "detail" in (*c.tags, c.key) else "n")

_PROFILES = f"""WITH {TIMELINE_SQL}, {VEC_SQL}, p AS (
  SELECT t.album, photo, ts, v.v AS semantic, list_distinct(list_filter([CASE WHEN photo % 4 <> 0 THEN event_type END, CASE WHEN photo % 3 = 0 THEN 'view' END], lambda x: x IS NOT NULL)) AS people,
    CASE WHEN photo % 2 = 0 THEN {_circle(100)} END AS layout, CASE WHEN photo % 5 <> 0 THEN {_circle(150)} END AS subject, CASE WHEN photo % 7 <> 0 THEN {_circle(300)} END AS background,
    CASE WHEN photo % 3 <> 1 THEN {_circle(200)} END AS composition, CASE WHEN photo % 6 <> 0 THEN {_scores("action", 3, 101)} END AS asc_, CASE WHEN photo % 4 <> 1 THEN {_scores("shot", 5, 37)} END AS ssc,
    (photo % 7)::INT AS faces, CASE WHEN photo % 11 <> 0 THEN value / 2500 END AS area, photo % 9 <> 0 AS has_meta,
    CASE WHEN photo % 9 <> 0 THEN {_pick(ORIENTATIONS)} END AS orientation, CASE WHEN photo % 9 <> 0 THEN {_pick(SHOT_SCALES)} END AS shot_scale, CASE WHEN photo % 9 <> 0 THEN {_pick(rules.BUCKETS)} END AS bucket,
    CASE WHEN photo % 9 <> 0 THEN {_pick(MODES)} END AS said, CASE WHEN photo % 9 <> 0 THEN photo % 10 / 10 ELSE 0.5 END AS cx, CASE WHEN photo % 9 <> 0 THEN photo % 7 / 7 ELSE 0.5 END AS cy,
    CASE WHEN photo % 9 <> 0 THEN photo % 5 / 20 ELSE 0 END AS hs, CASE WHEN photo % 9 <> 0 THEN photo % 3 / 15 ELSE 0 END AS vs, CASE WHEN photo % 9 <> 0 THEN photo % 4 / 10 ELSE 0 END AS sc
  FROM t JOIN v ON v.vec_id = (t.album + photo % 5 // 4) % (SELECT count(*) FROM embeddings)
), q AS (SELECT *, {_top("asc_")} AS at_, {_top("ssc")} AS st FROM p
), m AS (
  SELECT *, greatest(0, coalesce(-at_[1].n, 0) - coalesce(-at_[2].n, 0)) AS am, greatest(0, coalesce(-st[1].n, 0) - coalesce(-st[2].n, 0)) AS sm,
    ({_of("action", lambda c: c.key)})[at_[1].ord + 1] AS akey, ({_of("action", lambda c: c.family)})[at_[1].ord + 1] AS fam, list_transform(at_, lambda x: ({_of("action", lambda c: c.key)})[x.ord + 1]) AS akeys,
    coalesce(({_detail("action")})[at_[1].ord + 1] = 'y', false) OR coalesce(({_detail("shot")})[st[1].ord + 1] = 'y', false) AS det, coalesce(({_of("shot", lambda c: c.shot_mode)})[st[1].ord + 1], 'main_action') AS smode0 FROM q
), n AS (
  SELECT *, len(at_) > 0 AND am >= {CONFIG.minimum_action_margin} AS ac, len(at_) > 0 AND am >= {CONFIG.strong_action_margin} AS ast, len(st) > 0 AND sm >= {CONFIG.minimum_shot_margin} AS scf, len(st) > 0 AND sm >= {CONFIG.strong_shot_margin} AS sst,
    CASE said WHEN 'crowd' THEN 'large_group' WHEN 'family_group' THEN 'small_group' ELSE said END AS who FROM m
), o AS (SELECT *, CASE WHEN ssc IS NOT NULL AND NOT scf AND coalesce(shot_scale, 'wide') = 'close' THEN 'portrait' ELSE smode0 END AS smode FROM n
), w AS (
  SELECT *, CASE WHEN smode = 'audience' AND scf THEN 'audience' WHEN fam IN ('speech', 'toast') AND faces <= 2 THEN 'speaker' WHEN who IS NOT NULL THEN who WHEN faces <= 0 THEN 'none' WHEN faces = 1 THEN 'solo' WHEN faces = 2 THEN 'couple'
    WHEN faces <= 4 THEN 'small_group' ELSE 'large_group' END AS mode, list_transform(asc_, lambda x: x - list_avg(asc_)) AS cen FROM o
)"""

_C = CONFIG
_SCALE = lambda f: f"CASE WHEN {f}.has_meta AND coalesce({f}.shot_scale, 'wide') = 'wide' AND {f}.faces <= 0 AND {f}.orientation = 'portrait' THEN 'detail' ELSE coalesce({f}.shot_scale, 'wide') END"
_NEAR = lambda k, s: f"exp(-{s} * abs(l.{k} - r.{k}))"
_LIKE = " ".join(f"WHEN {_in('l.smode', 'r.smode', [k])} THEN {v}" for k, v in rules.SHOT_LIKENESS.items())
_FAMILY = f"CASE WHEN l.fam IS NULL OR r.fam IS NULL THEN 0.5 WHEN l.fam = r.fam THEN 1.0 WHEN {_in('l.fam', 'r.fam', rules.COMPATIBLE)} THEN 0.65 WHEN {_in('l.fam', 'r.fam', rules.CONFLICTING)} THEN 0.15 ELSE 0.35 END"
_CENTRED = f"""CASE WHEN sqrt(list_inner_product(l.cen, l.cen)) <= 1e-12 OR sqrt(list_inner_product(r.cen, r.cen)) <= 1e-12 THEN 0.5
  ELSE {_clip("(list_inner_product(l.cen, r.cen) / (sqrt(list_inner_product(l.cen, l.cen)) * sqrt(list_inner_product(r.cen, r.cen))) + 1) / 2")} END"""
_WEIGHT = {k: v for k, v in _C.weights().items() if k != "color"}
_THERE = {"layout": "l.layout IS NOT NULL AND r.layout IS NOT NULL", "subject": "l.subject IS NOT NULL AND r.subject IS NOT NULL", "background": "l.background IS NOT NULL AND r.background IS NOT NULL", "action": "action_reliable"}
_USED = lambda k, x: f"CASE WHEN {_THERE.get(k, 'true')} THEN {_WEIGHT[k]}{x} ELSE 0 END"

_PAIR_SQL = f"""{_PROFILES}, x AS (
  SELECT l, r, step FROM (SELECT w AS l, unnest([1, 2]) AS step, unnest([lead(w, 1) OVER h, lead(w, 2) OVER h]) AS r FROM w WINDOW h AS (PARTITION BY w.album ORDER BY w.ts, w.photo)) WHERE r IS NOT NULL
), y AS (
  SELECT l, r, step, l.album AS album, l.photo AS photo, {_clip("list_inner_product(l.semantic, r.semantic)")} AS semantic, {_sets("l.people", "r.people", 0.5, 0.35)} AS people, {_cosine("layout")} AS layout, {_cosine("subject")} AS subject,
    {_cosine("background")} AS background, abs(l.ts - r.ts) AS delta, exp(-greatest(abs(l.ts - r.ts), 0) / {_C.maximum_soft_time_gap_seconds}) AS time,
    l.asc_ IS NOT NULL AND r.asc_ IS NOT NULL AND l.ac AND r.ac AS action_reliable, l.scf AND r.scf AS shots,
    {_clip(f'''0.14 * {_cosine("composition")} + 0.08 * CASE WHEN coalesce(l.orientation, 'square') = coalesce(r.orientation, 'square') THEN 1.0 WHEN coalesce(l.orientation, 'square') = 'square' OR coalesce(r.orientation, 'square') = 'square' THEN 0.55 ELSE 0.35 END
      + 0.14 * {_steps(_SCALE("l"), _SCALE("r"), rules.SCALES, (0.78, 0.52, 0.22))} + 0.14 * {_steps("coalesce(l.bucket, 'zero')", "coalesce(r.bucket, 'zero')", rules.BUCKETS, (0.72, 0.38, 0.12))}
      + 0.18 * CASE WHEN l.mode = r.mode THEN 1.0 WHEN {_in("l.mode", "r.mode", rules.NEAR_MODES)} THEN 0.48 WHEN {_in("l.mode", "r.mode", rules.FAR_MODES)} THEN 0.12 ELSE 0.30 END
      + 0.10 * exp(-3 * (abs(l.cx - r.cx) + abs(l.cy - r.cy))) + 0.08 * ({_NEAR("hs", 6)} + {_NEAR("vs", 6)}) / 2 + 0.08 * {_NEAR("sc", 8)}
      + 0.06 * CASE WHEN NOT l.scf OR NOT r.scf THEN 0.5 WHEN l.smode = r.smode THEN 1.0 {_LIKE} ELSE 0.20 END''')} AS composition FROM x
), z AS (
  SELECT *, CASE WHEN action_reliable THEN {_clip(f"0.45 * {_CENTRED} + 0.30 * {_sets('l.akeys', 'r.akeys', 0.5, 0.5)} + 0.25 * {_FAMILY}")} ELSE 0.5 END AS action,
    action_reliable AND coalesce(l.akey <> r.akey, false) AND coalesce(l.fam <> r.fam, false) AND {_in("l.fam", "r.fam", rules.CONFLICTING)} AS action_soft_conflict,
    CASE WHEN l.mode = r.mode THEN 'none' WHEN {_in("l.mode", "r.mode", rules.STRONG_MODES)} AND NOT (abs(l.faces - r.faces) <= 1 OR (layout >= 0.88 AND subject >= 0.88) OR greatest(coalesce(l.area, 0), coalesce(r.area, 0)) < 0.05) THEN 'strong' ELSE 'weak' END AS participant_conflict,
    {_in("l.smode", "r.smode", rules.SHOT_CONFLICTS)} AS shot_conflict, shots AND ({_in("l.smode", "r.smode", rules.REACTIONS)} OR {_in("l.mode", "r.mode", ["speaker-audience"])}) AS main_vs_reaction FROM y
), u AS (
  SELECT *, action_soft_conflict AND l.ast AND r.ast AS action_hard_conflict, ({" + ".join(_USED(k, f" * {k}") for k in _WEIGHT)}) / ({" + ".join(_USED(k, "") for k in _WEIGHT)}) AS base,
    delta > {_C.maximum_soft_time_gap_seconds} AND semantic < {_C.strong_pair_similarity} AND action < 0.78 AND subject < {_C.cross_soft_boundary_similarity} AS bridge,
    delta > {_C.maximum_hard_time_gap_seconds} AND semantic < {_C.strong_pair_similarity} AND subject < {_C.long_range_subject_scene_threshold} AND people < 0.75 AS apart FROM z
), k AS (
  SELECT *, CASE WHEN apart THEN 0.0 ELSE greatest(0, least(1, base - CASE WHEN action_hard_conflict THEN {_C.strong_action_conflict_penalty} WHEN action_soft_conflict THEN {_C.action_conflict_penalty} ELSE 0 END
    - CASE participant_conflict WHEN 'strong' THEN {_C.participant_mode_strong_penalty} WHEN 'weak' THEN {_C.participant_mode_weak_penalty} ELSE 0 END - CASE WHEN shot_conflict AND shots THEN {_C.shot_mode_conflict_penalty} ELSE 0 END
    - CASE WHEN main_vs_reaction AND l.sst AND r.sst THEN {_C.main_vs_reaction_strong_penalty} WHEN main_vs_reaction THEN {_C.main_vs_reaction_supported_penalty} ELSE 0 END - CASE WHEN bridge THEN {_C.temporal_bridge_penalty} ELSE 0 END)) END AS combined FROM u
)"""

_TW = {("time" if k == "temporal" else k): v for k, v in _C.transition_weights().items()}
_REST = sum(v for k, v in _TW.items() if k != "action")
_UP = lambda k: f"(1 - {k})"
_ANY = f"{_UP('semantic')} >= {_C.conflict_visual_support_threshold} OR {_UP('subject')} >= {_C.conflict_subject_scene_support_threshold} OR {_UP('composition')} >= {_C.conflict_composition_support_threshold} OR {_UP('layout')} >= {_C.conflict_layout_support_threshold}"
_MUCH = f"{_UP('semantic')} >= {_C.conflict_strong_visual_support_threshold} OR {_UP('subject')} >= {_C.conflict_subject_scene_strong_support_threshold} OR ({_UP('composition')} >= {_C.conflict_composition_strong_support_threshold} AND {_UP('layout')} >= {_C.conflict_layout_strong_support_threshold})"
_names = lambda cases: "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w in cases) + "], lambda x: x IS NOT NULL)"
_CONTINUITY = _names(
    [
        ("all_signal_continuity", f"semantic >= {max(_C.continuity_semantic_similarity, 0.92)} AND subject >= {max(_C.continuity_subject_scene_similarity, 0.92)} AND composition >= {max(_C.continuity_composition_similarity, 0.90)} AND layout >= {max(_C.continuity_layout_similarity, 0.88)}"),
        ("background_composition_layout", f"background >= {_C.continuity_background_similarity} AND composition >= {_C.continuity_composition_similarity} AND layout >= {_C.continuity_layout_similarity}"),
        ("semantic_subject_scene", f"semantic >= {_C.continuity_semantic_similarity} AND subject >= {_C.continuity_subject_scene_similarity}"),
    ]
)
_HARD = _names(
    [
        ("composition_threshold", f"NOT det AND {_UP('composition')} >= {_C.composition_hard_boundary_threshold}"),
        ("semantic_background_layout", f"NOT det AND {_UP('semantic')} >= {_C.semantic_soft_boundary_threshold + 0.05} AND {_UP('background')} >= {_C.background_hard_support_threshold} AND {_UP('layout')} >= {_C.layout_hard_support_threshold}"),
        ("semantic_plus_composition", f"NOT det AND {_UP('semantic')} >= {_C.semantic_hard_boundary_threshold} AND {_UP('composition')} >= {_C.composition_soft_boundary_threshold}"),
        ("semantic_subject_scene_layout", f"NOT det AND {_UP('semantic')} >= 0.38 AND {_UP('subject')} >= {_C.conflict_subject_scene_strong_support_threshold} AND {_UP('layout')} >= {_C.layout_hard_support_threshold}"),
        ("time_gap_with_visual_change", f"delta > {_C.maximum_adjacent_gap_within_scene_seconds} AND some_"),
    ]
)
_WEAK = _names([("main_vs_reaction", "main_vs_reaction"), ("participant_mode_conflict", "participant_conflict <> 'none'"), ("shot_mode_conflict", "shot_conflict AND NOT main_vs_reaction")])
_STRONG = "participant_conflict = 'strong'"
# Condition, reliability, reasons; the first that holds decides.
_CASES = [
    ("len(hard) > 0", "hard", "hard"), ("override", "none", "[]"), ("action_hard_conflict AND much AND NOT det", "hard", "['action_conflict']"), ("action_soft_conflict AND action_reliable AND some_ AND NOT det", "supported", "['action_conflict']"),
    (f"{_STRONG} AND much AND shots AND NOT det", "hard", "['participant_mode_conflict']"), (f"{_STRONG} AND (much OR some_) AND NOT det", "supported", "['participant_mode_conflict']"), (_STRONG, "weak", "['participant_mode_conflict']"),
    ("main_vs_reaction AND (much OR some_) AND NOT det", "supported", "['main_vs_reaction']"), ("main_vs_reaction", "weak", "['main_vs_reaction']"),
    (f"change >= {_C.hard_boundary_threshold} AND (NOT det OR change >= {_C.hard_boundary_threshold + 0.10})", "hard", "['combined_threshold']"), (f"change >= {_C.soft_boundary_threshold}", "supported", "['combined_threshold']"), ("len(weak) > 0", "weak", "weak"),
]
_TRANSITION_SQL = f"""{_PAIR_SQL}, a AS (
  SELECT * EXCLUDE (det), l_det OR r_det AS det FROM (SELECT *, l.det AS l_det, r.det AS r_det, false AS det, {_ANY} AS some_, {_MUCH} AS much, {_CONTINUITY} AS cont, greatest(0, least(1, greatest((semantic + subject) / 2, (background + composition + layout) / 3, (semantic + subject + composition + layout) / 4))) AS continuity,
    greatest(0, least(1, greatest({", ".join(_UP(k) for k in ("semantic", "subject", "composition", "layout"))}))) AS visual_support,
    greatest(0, least(1, CASE WHEN action_reliable THEN {" + ".join(f"{v / sum(_TW.values())} * {_UP(k)}" for k, v in _TW.items())} ELSE {" + ".join(f"{v / _REST} * {_UP(k)}" for k, v in _TW.items() if k != "action")} END)) AS change FROM k)
), b AS (SELECT *, {_HARD} AS hard, {_WEAK} AS weak FROM a
), c AS (SELECT *, len(cont) > 0 AND len(weak) > 0 AND NOT {_STRONG} AND NOT main_vs_reaction AND (NOT some_ OR (participant_conflict = 'weak' AND visual_support < 0.35)) AS override FROM b
)"""

SQL = {
    "v9_photo_profiles": f"""{_PROFILES} SELECT photo, akey AS action, fam AS family, round(am, 8) AS action_margin, ac AS action_confident, ast AS action_strong, array_to_string(akeys, ',') AS action_keys, smode AS shot, round(sm, 8) AS shot_margin, scf AS shot_confident, mode FROM w""",
    "v12_pair_rules": f"{_PAIR_SQL} SELECT album, photo, {', '.join(f'round({k}, 7) AS {k}' for k in _SIMILARITIES)}, {', '.join(_FLAGS)}, round(combined, 7) AS combined FROM k WHERE step = 1",
    "v14_transition_rules": f"""{_TRANSITION_SQL} SELECT album, photo, round(change, 7) AS change, CASE {' '.join(f"WHEN {w} THEN '{k}'" for w, k, _ in _CASES)} ELSE 'none' END AS reliability,
  array_to_string(CASE {' '.join(f"WHEN {w} THEN {x}" for w, _, x in _CASES)} ELSE [] END, ',') AS reasons, array_to_string(cont, ',') AS continuity_reasons, round(continuity, 7) AS continuity, round(visual_support, 7) AS visual_support,
  len(hard) = 0 AND override AS override FROM c WHERE step = 1""",
    "w3_scene_boundaries": f"""{_TRANSITION_SQL}, d AS (
  SELECT *, CASE {' '.join(f"WHEN {w} THEN '{k}'" for w, k, _ in _CASES)} ELSE 'none' END AS reliability,
    delta > {_C.maximum_hard_time_gap_seconds} OR (floor(l.ts / 86400) <> floor(r.ts / 86400) AND delta >= {_C.session_gap_seconds}) OR (delta > {_C.session_gap_seconds} AND NOT (semantic >= {_C.strong_pair_similarity} OR action >= 0.72 OR people >= 0.60)) AS opens FROM c
), e AS (
  SELECT w.album, w.photo, w.ts, (sum(coalesce(d.opens, false)::INT) OVER (PARTITION BY w.album ORDER BY w.ts, w.photo ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM w LEFT JOIN d ON d.step = 1 AND d.r.photo = w.photo AND d.r.album = w.album
), f AS (
  SELECT e.*, row_number() OVER g - 1 AS pos, lag(photo) OVER g AS before, lead(photo) OVER g AS next FROM e WINDOW g AS (PARTITION BY album, session ORDER BY ts, photo)
), s2 AS (SELECT l.album AS album, l.photo AS a, r.photo AS b, combined FROM d WHERE step = 2
), j AS (
  SELECT f.album, f.photo, f.session, f.pos, f.ts, d.change, d.reliability, d.combined AS score, d.semantic, d.composition,
    coalesce(d.r.smode = 'detail' AND o.combined >= {_C.strong_pair_similarity}, false) OR coalesce(d.l.smode = 'detail' AND i.combined >= {_C.strong_pair_similarity}, false) AS detail
  FROM f JOIN d ON d.step = 1 AND d.l.photo = f.photo AND d.album = f.album AND d.r.photo = f.next LEFT JOIN f AS f2 ON f2.photo = f.next AND f2.album = f.album
  LEFT JOIN s2 AS o ON o.album = f.album AND o.a = f.photo AND o.b = f2.next LEFT JOIN s2 AS i ON i.album = f.album AND i.a = f.before AND i.b = f.next
), v2 AS (
  SELECT *, lag(score) OVER g AS lf, avg(score) OVER (PARTITION BY album, session ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS rt FROM j WINDOW g AS (PARTITION BY album, session ORDER BY pos)
), v3 AS (SELECT *, CASE WHEN lf IS NULL OR rt IS NULL THEN greatest(0, 0.5 - score) ELSE greatest(0, (lf + rt) / 2 - score) END AS support FROM v2
), v4 AS (
  SELECT *, reliability = 'hard' OR (reliability = 'supported' AND NOT detail AND (support >= {_C.boundary_support_margin} OR change >= {_C.soft_boundary_threshold + 0.08}
    OR (1 - semantic >= {_C.semantic_hard_boundary_threshold - 0.02} AND 1 - composition >= {_C.composition_soft_boundary_threshold}) OR 1 - composition >= {_C.composition_hard_boundary_threshold - 0.04})) AS accepted FROM v3
)
SELECT f.album, f.photo, f.session, f.pos, round(change, 7) AS change, reliability, round(support, 7) AS support, accepted FROM f LEFT JOIN v4 ON v4.album = f.album AND v4.photo = f.photo""",
}
