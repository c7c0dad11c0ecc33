"""Pair rules of scene grouping as expressions over two feature structs.

A feature struct has: path, ts, semantic, people, layout, subject, background, composition, color, action_scores,
shot_scores, face_count, face_area and meta (orientation, shot_scale, face_bucket, participant_mode, cx, cy, hspread,
vspread, scale); ``with_profiles`` adds action, shot and mode. Anything but path, semantic and face_count may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scene_config import SceneConfig
from .concepts import CONCEPTS, Concept
from .vectors import centered_similarity, clip01, dot, optional_cosine, set_similarity, time_similarity

# Unordered pairs.
CONFLICTING = "speech-audience speech-applause rings-kiss walking-rings walking-kiss portrait-walking cake-eating makeup-dressing dressing-portrait makeup-portrait".split()
COMPATIBLE = "speech-toast portrait-flowers portrait-hug walking-procession".split()
STRONG_MODES = "couple-audience solo-large_group solo-audience speaker-audience speaker-large_group none-large_group none-audience".split()
NEAR_MODES = "solo-couple small_group-large_group speaker-solo".split()
FAR_MODES = "couple-small_group speaker-audience solo-large_group couple-large_group".split()
SHOT_CONFLICTS = "main_action-reaction main_action-audience portrait-detail".split()
REACTIONS = "main_action-reaction main_action-audience".split()
SHOT_LIKENESS = {"main_action-portrait": 0.75, "detail-main_action": 0.65, "audience-reaction": 0.60, "portrait-detail": 0.45}
SCALES = ("detail", "close", "medium", "full_body", "wide")
BUCKETS = ("zero", "one", "couple", "small_group", "crowd")


def unordered(pairs: list[str]) -> list[str]:
    return sorted({"-".join(sorted(p.split("-"))) for p in pairs})


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def in_pairs(a: Column, b: Column, pairs: list[str]) -> Column:
    return F.coalesce(pair_key(a, b).isin(unordered(pairs)), F.lit(False))


def top_concepts(scores: Column, concepts: tuple[Concept, ...], limit: int) -> Column:
    """Best ``limit`` (ord, key, score), ties by order; scores of 0 and less are dropped after the limit."""
    keys = F.array(*[F.lit(c.key) for c in concepts])
    ranked = F.sort_array(F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("ord"))))
    best = F.filter(F.slice(ranked, 1, limit), lambda r: r["n"] < 0)
    out = F.transform(best, lambda r: F.struct(r["ord"].alias("ord"), F.get(keys, r["ord"]).alias("key"), (-r["n"]).alias("score")))
    return F.when(scores.isNotNull(), out)


def _named(ord_: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), ord_)


def _profile(top: Column, least: float, strong: float) -> dict[str, Column]:
    first, second = (F.coalesce(F.get(top, k)["score"], F.lit(0.0)) for k in (0, 1))
    margin = F.greatest(F.lit(0.0), first - second)
    found = F.coalesce(F.size(top), F.lit(0)) > 0
    return {
        "key": F.get(top, 0)["key"], "score": first, "margin": margin, "confident": found & (margin >= least), "strong": found & (margin >= strong),
        "keys": F.coalesce(F.transform(top, lambda t: t["key"]), F.array().cast("array<string>")),
    }


def with_profiles(df: DataFrame, config: SceneConfig, concepts: dict[str, tuple[Concept, ...]] | None = None) -> DataFrame:
    """Adds action (key, family, score, margin, confident, strong, keys), shot (the same with mode) and mode."""
    concepts = concepts or CONCEPTS
    df = df.withColumns({"_a": top_concepts(F.col("action_scores"), concepts["action"], 3), "_s": top_concepts(F.col("shot_scores"), concepts["shot"], 3)})
    a, s = _profile(F.col("_a"), config.minimum_action_margin, config.strong_action_margin), _profile(F.col("_s"), config.minimum_shot_margin, config.strong_shot_margin)
    a["family"] = _named(F.get("_a", 0)["ord"], [c.family for c in concepts["action"]])
    a["detail"] = F.coalesce(_named(F.get("_a", 0)["ord"], ["y" if "detail" in (*c.tags, c.key) else "n" for c in concepts["action"]]) == "y", F.lit(False))
    s["detail"] = F.coalesce(_named(F.get("_s", 0)["ord"], ["y" if "detail" in (*c.tags, c.key) else "n" for c in concepts["shot"]]) == "y", F.lit(False))
    shot = F.coalesce(_named(F.get("_s", 0)["ord"], [c.shot_mode for c in concepts["shot"]]), F.lit("main_action"))
    close = F.coalesce(F.col("meta.shot_scale"), F.lit("wide")) == "close"
    s["mode"] = F.when(F.col("_s").isNotNull() & ~s["confident"] & close, "portrait").otherwise(shot)
    df = df.withColumns({"action": F.struct(*[c.alias(k) for k, c in a.items()]), "shot": F.struct(*[c.alias(k) for k, c in s.items()])}).drop("_a", "_s")
    said = F.col("meta.participant_mode")
    said = F.when(said == "crowd", "large_group").when(said == "family_group", "small_group").otherwise(said)
    n = F.col("face_count")
    mode = (
        F.when((F.col("shot.mode") == "audience") & F.col("shot.confident"), "audience")
        .when(F.col("action.family").isin("speech", "toast") & (n <= 2), "speaker")
        .when(said.isNotNull() & (said != ""), said)
        .when(n <= 0, "none").when(n == 1, "solo").when(n == 2, "couple").when(n <= 4, "small_group").otherwise("large_group")
    )
    return df.withColumn("mode", mode)


def action_similarity(l: Column, r: Column) -> Column:
    a, b = l["action"], r["action"]
    family = (
        F.when(a["family"].isNull() | b["family"].isNull(), 0.5).when(a["family"] == b["family"], 1.0)
        .when(in_pairs(a["family"], b["family"], COMPATIBLE), 0.65).when(in_pairs(a["family"], b["family"], CONFLICTING), 0.15).otherwise(0.35)
    )
    overlap = set_similarity(a["keys"], b["keys"], 0.5, 0.5)
    score = 0.45 * centered_similarity(l["action_scores"], r["action_scores"]) + 0.30 * overlap + 0.25 * family
    return F.when(~a["confident"] | ~b["confident"] | l["action_scores"].isNull() | r["action_scores"].isNull(), 0.5).otherwise(clip01(score))


def _steps(a: Column, b: Column, order: tuple[str, ...], scores: tuple[float, float, float]) -> Column:
    place = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)).cast("int")
    at = lambda x: F.when(place(x) == 0, len(order)).otherwise(place(x))
    d = F.abs(at(a) - at(b))
    return F.when(a == b, 1.0).when(d == 1, scores[0]).when(d == 2, scores[1]).otherwise(scores[2])


def composition_similarity(l: Column, r: Column) -> Column:
    text = lambda f, k, d: F.coalesce(f["meta"][k], F.lit(d))
    number = lambda f, k, d=0.0: F.coalesce(f["meta"][k], F.lit(d))
    lo, ro = text(l, "orientation", "square"), text(r, "orientation", "square")
    turned = F.when(lo == ro, 1.0).when((lo == "square") | (ro == "square"), 0.55).otherwise(0.35)

    def scale(f: Column) -> Column:
        s = text(f, "shot_scale", "wide")
        tall = text(f, "orientation", "landscape") == "portrait"
        return F.when(f["meta"].isNotNull() & (s == "wide") & (f["face_count"] <= 0) & tall, "detail").otherwise(s)

    people = F.when(l["mode"] == r["mode"], 1.0).when(in_pairs(l["mode"], r["mode"], NEAR_MODES), 0.48).when(in_pairs(l["mode"], r["mode"], FAR_MODES), 0.12).otherwise(0.30)
    ls, rs = l["shot"], r["shot"]
    likeness = reduce(lambda c, kv: c.when(in_pairs(ls["mode"], rs["mode"], [kv[0]]), kv[1]), SHOT_LIKENESS.items(), F.when(ls["mode"] == rs["mode"], 1.0)).otherwise(0.20)
    shots = F.when(~ls["confident"] | ~rs["confident"], 0.5).otherwise(likeness)
    near = lambda k, s: F.exp(-s * F.abs(number(l, k) - number(r, k)))
    center = F.exp(-3.0 * (F.abs(number(l, "cx", 0.5) - number(r, "cx", 0.5)) + F.abs(number(l, "cy", 0.5) - number(r, "cy", 0.5))))
    return clip01(
        0.14 * optional_cosine(l["composition"], r["composition"])
        + 0.08 * turned
        + 0.14 * _steps(scale(l), scale(r), SCALES, (0.78, 0.52, 0.22))
        + 0.14 * _steps(text(l, "face_bucket", "zero"), text(r, "face_bucket", "zero"), BUCKETS, (0.72, 0.38, 0.12))
        + 0.18 * people
        + 0.10 * center
        + 0.08 * (near("hspread", 6.0) + near("vspread", 6.0)) / 2.0
        + 0.08 * near("scale", 8.0)
        + 0.06 * shots
    )


def pair_components(df: DataFrame, config: SceneConfig, l: Column, r: Column) -> DataFrame:
    """Adds the nine similarities, the conflicts, the penalties and ``combined`` of each pair of structs l and r."""
    c = config
    both = lambda k: l[k].isNotNull() & r[k].isNotNull()
    delta = F.abs(l["ts"] - r["ts"])
    df = df.withColumns(
        {
            "semantic": clip01(dot(l["semantic"], r["semantic"])), "action": action_similarity(l, r), "people": set_similarity(l["people"], r["people"]),
            "layout": optional_cosine(l["layout"], r["layout"]), "subject": optional_cosine(l["subject"], r["subject"]),
            "background": optional_cosine(l["background"], r["background"]), "color": optional_cosine(l["color"], r["color"]),
            "time": F.when(delta.isNull(), 0.5).otherwise(time_similarity(delta, c.maximum_soft_time_gap_seconds)),
            "composition": composition_similarity(l, r), "delta": delta,
            "action_reliable": both("action_scores") & l["action"]["confident"] & r["action"]["confident"],
            "shots_confident": l["shot"]["confident"] & r["shot"]["confident"],
        }
    )
    fa, fb = l["action"]["family"], r["action"]["family"]
    soft = F.col("action_reliable") & F.coalesce(l["action"]["key"] != r["action"]["key"], F.lit(False)) & F.coalesce(fa != fb, F.lit(False)) & in_pairs(fa, fb, CONFLICTING)
    tiny = F.greatest(F.coalesce(l["face_area"], F.lit(0.0)), F.coalesce(r["face_area"], F.lit(0.0))) < 0.05
    softened = (F.abs(l["face_count"] - r["face_count"]) <= 1) | ((F.col("layout") >= 0.88) & (F.col("subject") >= 0.88)) | tiny
    strength = F.when(l["mode"] == r["mode"], "none").when(in_pairs(l["mode"], r["mode"], STRONG_MODES) & ~softened, "strong").otherwise("weak")
    shot_modes = (l["shot"]["mode"], r["shot"]["mode"])
    reaction = F.col("shots_confident") & (in_pairs(*shot_modes, REACTIONS) | in_pairs(l["mode"], r["mode"], ["speaker-audience"]))
    df = df.withColumns(
        {
            "action_soft_conflict": soft, "action_hard_conflict": soft & l["action"]["strong"] & r["action"]["strong"], "participant_conflict": strength,
            "shot_conflict": in_pairs(*shot_modes, SHOT_CONFLICTS), "main_vs_reaction": reaction,
        }
    )
    available = {k: both(k) for k in ("layout", "subject", "background", "color")} | {"action": F.col("action_reliable")}
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in c.weights().items():
        used = F.when(available.get(name, F.lit(True)), F.lit(w)).otherwise(0.0)
        total, weight = total + used * F.col(name), weight + used
    bridge = (F.col("delta") > c.maximum_soft_time_gap_seconds) & (F.col("semantic") < c.strong_pair_similarity) & (F.col("action") < 0.78) & (F.col("subject") < c.cross_soft_boundary_similarity)
    pick = lambda when, value, other=0.0: F.when(when, value).otherwise(other)
    strong_shots = l["shot"]["strong"] & r["shot"]["strong"]
    df = df.withColumns(
        {
            "action_penalty": F.when(F.col("action_hard_conflict"), c.strong_action_conflict_penalty).when(F.col("action_soft_conflict"), c.action_conflict_penalty).otherwise(0.0),
            "participant_penalty": F.when(F.col("participant_conflict") == "strong", c.participant_mode_strong_penalty).when(F.col("participant_conflict") == "weak", c.participant_mode_weak_penalty).otherwise(0.0),
            "shot_penalty": pick(F.col("shot_conflict") & F.col("shots_confident"), c.shot_mode_conflict_penalty),
            "reaction_penalty": F.when(F.col("main_vs_reaction") & strong_shots, c.main_vs_reaction_strong_penalty).when(F.col("main_vs_reaction"), c.main_vs_reaction_supported_penalty).otherwise(0.0),
            "bridge_penalty": pick(F.coalesce(bridge, F.lit(False)), c.temporal_bridge_penalty),
            "_score": total / weight,
        }
    )
    apart = (F.col("delta") > c.maximum_hard_time_gap_seconds) & (F.col("semantic") < c.strong_pair_similarity) & (F.col("subject") < c.long_range_subject_scene_threshold) & (F.col("people") < 0.75)
    less = F.col("action_penalty") + F.col("participant_penalty") + F.col("shot_penalty") + F.col("reaction_penalty") + F.col("bridge_penalty")
    return df.withColumn("combined", F.when(F.coalesce(apart, F.lit(False)), 0.0).otherwise(clip01(F.col("_score") - less))).drop("_score")


def transition(df: DataFrame, config: SceneConfig, l: Column, r: Column) -> DataFrame:
    """For rows of neighbours with pair components: change (combined), reliability, reasons and continuity."""
    c = config
    up = {k: 1.0 - F.col(k) for k in ("semantic", "people", "layout", "subject", "background", "composition", "time")}
    w = c.transition_weights()
    rest = sum(v for k, v in w.items() if k != "action")
    seen = sum(((w[k] / rest) * up["time" if k == "temporal" else k] for k in w if k != "action"), F.lit(0.0))
    whole = sum(w.values())
    full = sum(((v / whole) * ((1.0 - F.col("action")) if k == "action" else up["time" if k == "temporal" else k]) for k, v in w.items()), F.lit(0.0))
    detail = l["action"]["detail"] | r["action"]["detail"] | l["shot"]["detail"] | r["shot"]["detail"]
    df = df.withColumns({"change": clip01(F.when(F.col("action_reliable"), full).otherwise(seen)), "detail": detail})
    sem, sub, comp, lay, bg = (F.col(k) for k in ("semantic", "subject", "composition", "layout", "background"))
    alike = {
        "all_signal_continuity": (sem >= max(c.continuity_semantic_similarity, 0.92)) & (sub >= max(c.continuity_subject_scene_similarity, 0.92)) & (comp >= max(c.continuity_composition_similarity, 0.90)) & (lay >= max(c.continuity_layout_similarity, 0.88)),
        "background_composition_layout": (bg >= c.continuity_background_similarity) & (comp >= c.continuity_composition_similarity) & (lay >= c.continuity_layout_similarity),
        "semantic_subject_scene": (sem >= c.continuity_semantic_similarity) & (sub >= c.continuity_subject_scene_similarity),
    }
    some = (up["semantic"] >= c.conflict_visual_support_threshold) | (up["subject"] >= c.conflict_subject_scene_support_threshold) | (up["composition"] >= c.conflict_composition_support_threshold) | (up["layout"] >= c.conflict_layout_support_threshold)
    much = (up["semantic"] >= c.conflict_strong_visual_support_threshold) | (up["subject"] >= c.conflict_subject_scene_strong_support_threshold) | ((up["composition"] >= c.conflict_composition_strong_support_threshold) & (up["layout"] >= c.conflict_layout_strong_support_threshold))
    df = df.withColumns(
        {
            "continuity_reasons": F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in alike.items()])),
            "continuity": clip01(F.greatest((sem + sub) / 2.0, (bg + comp + lay) / 3.0, (sem + sub + comp + lay) / 4.0)),
            "visual_support": clip01(F.greatest(up["semantic"], up["subject"], up["composition"], up["layout"])),
            "_some": some, "_much": much,
        }
    )
    plain = ~F.col("detail")
    gap = F.coalesce(F.col("delta") > c.maximum_adjacent_gap_within_scene_seconds, F.lit(False))
    hard = {
        "composition_threshold": plain & (up["composition"] >= c.composition_hard_boundary_threshold),
        "semantic_background_layout": plain & (up["semantic"] >= c.semantic_soft_boundary_threshold + 0.05) & (up["background"] >= c.background_hard_support_threshold) & (up["layout"] >= c.layout_hard_support_threshold),
        "semantic_plus_composition": plain & (up["semantic"] >= c.semantic_hard_boundary_threshold) & (up["composition"] >= c.composition_soft_boundary_threshold),
        "semantic_subject_scene_layout": plain & (up["semantic"] >= 0.38) & (up["subject"] >= c.conflict_subject_scene_strong_support_threshold) & (up["layout"] >= c.layout_hard_support_threshold),
        "time_gap_with_visual_change": gap & F.col("_some"),
    }
    strength = F.col("participant_conflict")
    weak = {"main_vs_reaction": F.col("main_vs_reaction"), "participant_mode_conflict": strength != "none", "shot_mode_conflict": F.col("shot_conflict") & ~F.col("main_vs_reaction")}
    names = lambda rules: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    df = df.withColumns({"_hard": names(hard), "_weak": names(weak)})
    override = (
        (F.size("continuity_reasons") > 0) & (F.size("_weak") > 0) & (strength != "strong") & ~F.col("main_vs_reaction")
        & (~F.col("_some") | ((strength == "weak") & (F.col("visual_support") < 0.35)))
    )
    strong, reaction = strength == "strong", F.col("main_vs_reaction")
    total = F.col("change")
    jump = (total >= c.hard_boundary_threshold) & (plain | (total >= c.hard_boundary_threshold + 0.10))
    one = lambda name: F.array(F.lit(name))
    none = F.array().cast("array<string>")
    # The first rule that holds decides; each has a reliability and its reasons.
    cascade = [
        (F.size("_hard") > 0, "hard", F.col("_hard")),
        (override, "none", none),
        (F.col("action_hard_conflict") & F.col("_much") & plain, "hard", one("action_conflict")),
        (F.col("action_soft_conflict") & F.col("action_reliable") & F.col("_some") & plain, "supported", one("action_conflict")),
        (strong & F.col("_much") & F.col("shots_confident") & plain, "hard", one("participant_mode_conflict")),
        (strong & (F.col("_much") | F.col("_some")) & plain, "supported", one("participant_mode_conflict")),
        (strong, "weak", one("participant_mode_conflict")),
        (reaction & (F.col("_much") | F.col("_some")) & plain, "supported", one("main_vs_reaction")),
        (reaction, "weak", one("main_vs_reaction")),
        (jump, "hard", one("combined_threshold")),
        (total >= c.soft_boundary_threshold, "supported", one("combined_threshold")),
        (F.size("_weak") > 0, "weak", F.col("_weak")),
    ]
    decided = lambda k: reduce(lambda e, x: e.when(x[0], x[k]), cascade[1:], F.when(cascade[0][0], cascade[0][k]))
    return df.withColumns({"reliability": decided(1).otherwise("none"), "reasons": decided(2).otherwise(none), "override": (F.size("_hard") == 0) & override}).drop("_some", "_much", "_hard", "_weak")
