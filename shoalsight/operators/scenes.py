"""Scene grouping: sessions, transitions, segments and groups of a photo timeline.

Everything that looks at neighbouring photos is expressions over windows of chunks of an album. What is sequential by
nature (recovering small segments, refining components, merging neighbours) runs in ``applyInPandas`` over blocks:
stretches between hard boundaries of one session. None of these steps ever crosses a hard boundary, so a block is the
largest unit that belongs together, and memory is bounded by the longest one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scene as rules
from ..functions.concepts import Concept
from ..plans.materialize import written
from ..scene_config import SceneConfig
from .timeline import opens_session, running_count, support

_FEATURE = "path ts semantic people layout subject background composition color action_scores face_count face_area meta action shot mode".split()
OUT = "album string, session long, pos long, path string, ts double, segment long, grp long, medoid string, representative string, cohesion double"


#: Judged columns of ``transitions``.
JUDGED = "score change reliability reasons continuity_reasons continuity visual_support override pair next_path support accepted".split()
#: Positions of an album that are looked at together.
CHUNK = 2048


def transitions(
    features: DataFrame, config: SceneConfig, concepts: dict[str, tuple[Concept, ...]] | None = None, complete: Callable[[DataFrame], DataFrame] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Rows of timed photos with session, pos, and the judged transition to the next photo of the session (null after the
    last): change, reliability, reasons, accepted and the pair components. ``features``: album and the feature columns.

    ``complete`` adds the feature columns that ``features`` lacks, and neither drops nor repeats rows. It is called when the
    rows are dealt out and in order, so what it adds is not shuffled, if it works row by row or by broadcast joins. ``keep``:
    the columns to return besides album, session, pos, path and ts; by default those given and ``JUDGED``. Beyond these there
    are block (number of hard transitions before, in the album) and alone (no other photo in its block)."""
    c, before, after = config, max(1, config.boundary_context_window - 1), config.boundary_context_window + 1
    keep = [k for k in (keep or [*features.columns, *JUDGED]) if k not in ("album", "path", "ts")]
    timed = running_count(features.filter("ts is not null"), ["album"], "ts", "path", F.lit(True), "_at").withColumn("_at", F.col("_at") - 1)
    # Chunks of positions, each with the rows around it that its own rows look at: all that follows stays inside them.
    chunk = lambda at: F.floor(at / CHUNK).cast("long")
    reach = F.sequence(chunk(F.greatest(F.col("_at") - after, F.lit(0))), chunk(F.col("_at") + before))
    rows = timed.withColumn("_chunk", F.explode(reach)).repartition("album", "_chunk").sortWithinPartitions("album", "_chunk", "_at")
    rows = rules.with_profiles(complete(rows) if complete else rows, c, concepts).withColumn("f", F.struct(*_FEATURE))
    order = Window.partitionBy("album", "_chunk").orderBy("_at")
    given = [k for k in features.columns if k in keep]
    held = [F.struct(*given).alias("_given")] if given else []  # the pair components have some of their names
    rows = rows.select("album", "path", "ts", "_chunk", "_at", *held, "f", *[F.lead("f", k).over(order).alias(f"_next_{k}") for k in (1, 2)])
    me, on, skip = F.col("f"), F.col("_next_1"), F.col("_next_2")
    base = rows.columns
    # The photo after is a detail, and those around it belong together.
    rows = rules.pair_components(rows, c, me, skip).withColumn("_detail", F.coalesce(skip.isNotNull() & (on["shot"]["mode"] == "detail") & (F.col("combined") >= c.strong_pair_similarity), F.lit(False)))
    rows = rules.transition(rules.pair_components(rows.select(*base, "_detail"), c, me, on), c, me, on)
    alike = (F.col("semantic") >= c.strong_pair_similarity) | (F.col("action") >= 0.72) | (F.col("people") >= 0.60)
    opens = opens_session(F.col("ts"), on["ts"], c.session_gap_seconds, c.maximum_hard_time_gap_seconds, alike)
    pair = F.struct("semantic", "action", "people", "layout", "subject", "background", "composition", "time", "combined")
    told = {"score": F.col("combined"), "pair": pair, "next_path": on["path"]} | {k: F.col(k) for k in JUDGED if k not in ("score", "pair", "next_path", "support", "accepted")}
    sides = {"_semantic": F.col("semantic"), "_composition": F.col("composition")}
    rows = rows.select("album", "path", "ts", "_chunk", "_at", *[F.col(f"_given.{k}").alias(k) for k in given], "_detail", (on.isNull() | opens).alias("_ends"), *[v.alias(k) for k, v in (told | sides).items()])
    ends = lambda k: F.coalesce((F.lead if k > 0 else F.lag)("_ends", abs(k)).over(order), F.lit(True)) if k else F.col("_ends")
    rows = rows.withColumns({f"_e{k}": ends(k) for k in range(-before, after)} | {f"_s{k}": (F.lead if k > 0 else F.lag)("score", abs(k)).over(order) for k in range(-before, after) if k} | {"_detail_before": F.lag("_detail").over(order)})
    within = lambda k: reduce(lambda x, y: x & y, [~F.col(f"_e{j}") for j in range(min(k, 0), max(k, 0) + 1)])
    score_at = lambda k: F.when(within(k), F.col(f"_s{k}"))
    lefts = F.filter(F.array(*[score_at(-k) for k in range(1, c.boundary_context_window)]).cast("array<double>"), lambda x: x.isNotNull())
    left = F.when(F.size(lefts) > 0, F.aggregate(lefts, F.lit(0.0), lambda t, x: t + x) / F.size(lefts))
    rows = rows.withColumn("support", support(left, [score_at(k) for k in range(1, after)], F.col("score")))
    enough = (
        (F.col("support") >= c.boundary_support_margin)
        | (F.col("change") >= c.soft_boundary_threshold + 0.08)
        | ((1.0 - F.col("_semantic") >= c.semantic_hard_boundary_threshold - 0.02) & (1.0 - F.col("_composition") >= c.composition_soft_boundary_threshold))
        | (1.0 - F.col("_composition") >= c.composition_hard_boundary_threshold - 0.04)
    )
    detail = (F.col("_detail") & within(1)) | (F.coalesce(F.col("_detail_before"), F.lit(False)) & within(-1))
    rows = rows.withColumn("accepted", (F.col("reliability") == "hard") | ((F.col("reliability") == "supported") & ~detail & enough))
    rows = rows.withColumns({k: F.when(~F.col("_ends"), F.col(k)) for k in JUDGED})
    rows = rows.withColumn("_cuts", F.col("_ends") | (F.col("reliability") == "hard"))
    cut_before = F.coalesce(F.lag("_cuts").over(order), F.lit(True))
    rows = rows.withColumns({"_opens": F.col("_e-1"), "_cut_before": cut_before}).filter(F.col("_chunk") == chunk(F.col("_at")))
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "album", "path", "ts", *[k for k in keep if k in given or k in JUDGED], "_chunk", "_at", "_opens", "_cut_before", F.count_if("_opens").over(sofar).alias("_session"), F.count_if("_cut_before").over(sofar).alias("_block"),
        F.max(F.when(F.col("_opens"), F.col("_at"))).over(sofar).alias("_start"), (F.col("_cut_before") & F.col("_cuts")).alias("alone"),
    )
    rows = written(rows, "transitions")
    # Counts and the last start carried over from the chunks before; the first chunk of an album has none before.
    ahead = Window.partitionBy("album").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("album", "_chunk").agg(F.count_if("_opens").alias("_n"), F.count_if("_cut_before").alias("_m"), F.max(F.when(F.col("_opens"), F.col("_at"))).alias("_last"))
    totals = totals.select("album", "_chunk", F.sum("_n").over(ahead).alias("_sessions"), F.sum("_m").over(ahead).alias("_blocks"), F.max("_last").over(ahead).alias("_since"))
    none = {k: F.lit(0).cast("long") for k in ("_sessions", "_blocks", "_since")}
    rows = rows.filter("_chunk = 0").withColumns(none).unionByName(rows.filter("_chunk > 0").join(totals.filter("_chunk > 0"), ["album", "_chunk"]))
    session, pos = F.col("_sessions") + F.col("_session") - 1, F.col("_at") - F.coalesce("_start", "_since")
    return rows.select("album", session.alias("session"), pos.alias("pos"), "path", "ts", *keep, (F.col("_blocks") + F.col("_block") - 1).alias("block"), "alone")


_PAIR_TABLES = {
    "conflict": rules.CONFLICTING, "compatible": rules.COMPATIBLE, "strong_modes": rules.STRONG_MODES, "near_modes": rules.NEAR_MODES, "far_modes": rules.FAR_MODES,
    "shot_conflicts": rules.SHOT_CONFLICTS, "reactions": rules.REACTIONS, "speaker_audience": ["speaker-audience"],
}


class Block:
    """The photos of a block (rows in timeline order), with vectorised pair components."""

    def __init__(self, rows: pd.DataFrame, config: SceneConfig, timed: bool = True):
        self.c, self.timed = config, timed
        self.rows, self.n = rows, len(rows)
        self.pos = rows["pos"].to_numpy(np.int64)
        self.path = rows["path"].tolist()
        self.ts = rows["ts"].to_numpy(float)
        self.change = rows["change"].to_numpy(float)
        self.reliability = ["none" if x is None or x != x else x for x in rows["reliability"]]
        self.accepted = np.array([bool(x) and x == x for x in rows["accepted"]])
        self.faces = rows["face_count"].to_numpy(float)
        self.area = np.nan_to_num(rows["face_area"].to_numpy(float))
        self.quality = rows["quality"].to_numpy(float)
        self.people = [frozenset(x) if x is not None else frozenset() for x in rows["people"]]
        self.vectors = {}
        for k in ("semantic", "layout", "subject", "background", "composition", "color", "action_scores"):
            held = [None if v is None else np.asarray(v, float) for v in rows[k]]
            width = max((len(v) for v in held if v is not None), default=1)
            m = np.full((self.n, width), np.nan)
            for i, v in enumerate(held):
                if v is not None and len(v) == width:
                    m[i] = v
            self.vectors[k] = m
        self.has = {k: ~np.isnan(m[:, 0]) for k, m in self.vectors.items()}
        centred = self.vectors["action_scores"] - self.vectors["action_scores"].mean(axis=1, keepdims=True)
        length = np.linalg.norm(centred, axis=1, keepdims=True)
        self.centred, self.flat = centred / np.where(length > 1e-12, length, 1), ~(length[:, 0] > 1e-12)
        for k in ("action_confident", "action_strong", "shot_confident", "shot_strong"):
            setattr(self, k, rows[k].to_numpy(bool))
        self.action_key, self.family, self.shot_mode, self.mode = (rows[k].tolist() for k in ("action_key", "action_family", "shot_mode", "mode"))
        self.keys = [frozenset(x) for x in rows["action_keys"]]
        self.meta = {k: rows[k].tolist() for k in ("orientation", "shot_scale", "face_bucket")}
        self.number = {k: rows[k].to_numpy(float) for k in ("cx", "cy", "hspread", "vspread", "scale")}
        self.no_meta = rows["no_meta"].to_numpy(bool)
        self._memo: dict[tuple[int, int], dict] = {}

    def _cosine(self, k: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        m = self.vectors[k]
        s = np.clip((m[i] * m[j]).sum(axis=1), 0.0, 1.0)
        return np.where(np.isnan(s), 0.5, s)

    @staticmethod
    def _in(table: str, a: list, b: list) -> np.ndarray:
        held = set(rules.unordered(_PAIR_TABLES[table]))
        return np.array([x is not None and y is not None and "-".join(sorted((x, y))) in held for x, y in zip(a, b, strict=True)], bool)

    def _sets(self, values: list[frozenset], i, j, none: float, one: float) -> np.ndarray:
        def of(a, b):
            return none if not a and not b else one if not a or not b else len(a & b) / len(a | b)

        return np.array([of(values[x], values[y]) for x, y in zip(i, j, strict=True)], float)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        c = self.c
        pick = lambda values, at: [values[x] for x in at]
        out = {k: self._cosine(k, i, j) for k in ("layout", "subject", "background", "color")}
        out["semantic"] = np.clip((self.vectors["semantic"][i] * self.vectors["semantic"][j]).sum(axis=1), 0, 1)
        reliable = self.has["action_scores"][i] & self.has["action_scores"][j] & self.action_confident[i] & self.action_confident[j]
        fa, fb = pick(self.family, i), pick(self.family, j)
        same = np.array([x == y for x, y in zip(fa, fb, strict=True)])
        missing = np.array([x is None or y is None for x, y in zip(fa, fb, strict=True)])
        conflict = self._in("conflict", fa, fb)
        family = np.select([missing, same, self._in("compatible", fa, fb), conflict], [0.5, 1.0, 0.65, 0.15], 0.35)
        centred = np.clip(((self.centred[i] * self.centred[j]).sum(axis=1) + 1.0) / 2.0, 0, 1)
        centred = np.where(self.flat[i] | self.flat[j] | np.isnan(centred), 0.5, centred)
        action = np.clip(0.45 * centred + 0.30 * self._sets(self.keys, i, j, 0.5, 0.5) + 0.25 * family, 0, 1)
        out["action"] = np.where(reliable, action, 0.5)
        out["people"] = self._sets(self.people, i, j, 0.5, 0.35)
        delta = np.abs(self.ts[i] - self.ts[j])
        out["time"] = np.where(np.isnan(delta), 0.5, np.exp(-delta / max(c.maximum_soft_time_gap_seconds, 1)))
        out["composition"] = self._composition(i, j)
        shots = self.shot_confident[i] & self.shot_confident[j]
        keys_differ = np.array([x != y for x, y in zip(pick(self.action_key, i), pick(self.action_key, j), strict=True)])
        soft = reliable & keys_differ & ~missing & ~same & conflict
        out["action_hard"] = hard = soft & self.action_strong[i] & self.action_strong[j]
        ma, mb = pick(self.mode, i), pick(self.mode, j)
        tiny = np.maximum(self.area[i], self.area[j]) < 0.05
        softened = (np.abs(self.faces[i] - self.faces[j]) <= 1) | ((out["layout"] >= 0.88) & (out["subject"] >= 0.88)) | tiny
        unlike = np.array([x != y for x, y in zip(ma, mb, strict=True)])
        out["participant_strong"] = strong = unlike & self._in("strong_modes", ma, mb) & ~softened
        sa, sb = pick(self.shot_mode, i), pick(self.shot_mode, j)
        out["reaction"] = reaction = shots & (self._in("reactions", sa, sb) | self._in("speaker_audience", ma, mb))
        total, weight = np.zeros(len(i)), np.zeros(len(i))
        there = {k: self.has[k][i] & self.has[k][j] for k in ("layout", "subject", "background", "color")} | {"action": reliable}
        for name, w in c.weights().items():
            used = np.where(there.get(name, True), w, 0.0)
            total, weight = total + used * out[name], weight + used
        bridge = (delta > c.maximum_soft_time_gap_seconds) & (out["semantic"] < c.strong_pair_similarity) & (out["action"] < 0.78) & (out["subject"] < c.cross_soft_boundary_similarity)
        less = (
            np.where(hard, c.strong_action_conflict_penalty, np.where(soft, c.action_conflict_penalty, 0.0))
            + np.where(strong, c.participant_mode_strong_penalty, np.where(unlike, c.participant_mode_weak_penalty, 0.0))
            + np.where(self._in("shot_conflicts", sa, sb) & shots, c.shot_mode_conflict_penalty, 0.0)
            + np.where(reaction & self.shot_strong[i] & self.shot_strong[j], c.main_vs_reaction_strong_penalty, np.where(reaction, c.main_vs_reaction_supported_penalty, 0.0))
            + np.where(bridge, c.temporal_bridge_penalty, 0.0)
        )
        apart = (delta > c.maximum_hard_time_gap_seconds) & (out["semantic"] < c.strong_pair_similarity) & (out["subject"] < c.long_range_subject_scene_threshold) & (out["people"] < 0.75)
        out["combined"] = np.where(apart, 0.0, np.clip(total / weight - less, 0, 1))
        return out

    def _composition(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        def both(values, default):
            return [default if values[x] is None else values[x] for x in i], [default if values[x] is None else values[x] for x in j]

        def steps(a, b, order, scores):
            at = lambda x: order.index(x) if x in order else len(order) - 1
            return np.array([1.0 if x == y else scores[min(abs(at(x) - at(y)), 3) - 1] if at(x) != at(y) else scores[2] for x, y in zip(a, b, strict=True)])

        oa, ob = both(self.meta["orientation"], "square")
        turned = np.array([1.0 if x == y else 0.55 if "square" in (x, y) else 0.35 for x, y in zip(oa, ob, strict=True)])
        scale = [
            "detail" if not self.no_meta[x] and (s or "wide") == "wide" and self.faces[x] <= 0 and self.meta["orientation"][x] == "portrait" else (s or "wide")
            for x, s in enumerate(self.meta["shot_scale"])
        ]
        ma, mb = [self.mode[x] for x in i], [self.mode[x] for x in j]
        people = np.select([np.array([x == y for x, y in zip(ma, mb, strict=True)]), self._in("near_modes", ma, mb), self._in("far_modes", ma, mb)], [1.0, 0.48, 0.12], 0.30)
        likeness = {"-".join(sorted(k.split("-"))): v for k, v in rules.SHOT_LIKENESS.items()}
        shot = np.array([1.0 if self.shot_mode[x] == self.shot_mode[y] else likeness.get("-".join(sorted((self.shot_mode[x], self.shot_mode[y]))), 0.20) for x, y in zip(i, j, strict=True)])
        shot = np.where(self.shot_confident[i] & self.shot_confident[j], shot, 0.5)
        value = {k: np.where(np.isnan(v), 0.5 if k in ("cx", "cy") else 0.0, v) for k, v in self.number.items()}
        near = lambda k, s: np.exp(-s * np.abs(value[k][i] - value[k][j]))
        center = np.exp(-3.0 * (np.abs(value["cx"][i] - value["cx"][j]) + np.abs(value["cy"][i] - value["cy"][j])))
        score = (
            0.14 * self._cosine("composition", i, j) + 0.08 * turned + 0.14 * steps([scale[x] for x in i], [scale[x] for x in j], rules.SCALES, (0.78, 0.52, 0.22))
            + 0.14 * steps(*both(self.meta["face_bucket"], "zero"), rules.BUCKETS, (0.72, 0.38, 0.12)) + 0.18 * people + 0.10 * center
            + 0.08 * (near("hspread", 6.0) + near("vspread", 6.0)) / 2.0 + 0.08 * near("scale", 8.0) + 0.06 * shot
        )
        return np.clip(score, 0, 1)

    def pair(self, a: int, b: int) -> dict[str, float]:
        key = (min(a, b), max(a, b))
        if key not in self._memo:
            if key[0] == key[1]:
                one = dict.fromkeys(("semantic", "action", "people", "layout", "subject", "background", "composition", "combined"), 1.0)
                self._memo[key] = one | {"action_hard": False, "participant_strong": False, "reaction": False}
            else:
                self._memo[key] = {k: v[0] for k, v in self.pairs(np.array([key[0]]), np.array([key[1]])).items()}
        return self._memo[key]

    def score(self, a: int, b: int) -> float:
        return float(self.pair(a, b)["combined"])

    def alike(self, a: int, b: int) -> bool:
        """Continuity strong enough to cross a supported boundary."""
        c, p = self.c, self.pair(a, b)
        first = p["semantic"] >= c.continuity_semantic_similarity and p["subject"] >= c.continuity_subject_scene_similarity
        return bool(first or (p["background"] >= c.continuity_background_similarity and p["composition"] >= c.continuity_composition_similarity and p["layout"] >= c.continuity_layout_similarity))

    def passable(self, boundary: int, score: float, a: int, b: int) -> bool:
        """Whether a merge with ``score`` may cross the transition after row ``boundary``; a and b lie next to it."""
        if not 0 <= boundary < self.n - 1:
            return True
        kind = self.reliability[boundary]
        if kind == "hard":
            return False
        if kind == "supported":
            return score >= self.c.supported_boundary_merge_similarity and self.alike(a, b)
        return score >= self.c.weak_boundary_merge_similarity


def raw_segments(b: Block) -> list[list[int]]:
    cuts = [0, *(np.flatnonzero(b.accepted[: b.n - 1]) + 1).tolist(), b.n]
    return [list(range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]


def recover_singletons(b: Block, segments: list[list[int]]) -> list[list[int]]:
    """One pass, left to right: a segment of one photo joins the better of its neighbours where that is allowed."""
    if len(segments) < 2:
        return segments
    done: list[list[int]] = []
    waiting = [list(s) for s in segments]

    def anchor(one: int, segment: list[int]) -> float:
        near = segment[:2] + segment[-2:]
        return sum(b.score(one, x) for x in near) / len(near)

    def absorbs(near: int, one: int) -> bool:
        p = b.pair(near, one)
        if p["action_hard"] or ((p["participant_strong"] or p["reaction"]) and not b.alike(near, one)):
            return False
        gap = abs(b.ts[near] - b.ts[one])
        return not gap > b.c.maximum_adjacent_gap_within_scene_seconds

    for k, segment in enumerate(waiting):
        if len(segment) != 1:
            done.append(segment)
            continue
        one = segment[0]
        sides = []  # (segment, score, neighbour, boundary)
        if done:
            sides.append((done[-1], anchor(one, done[-1]), done[-1][-1], one - 1))
        if k + 1 < len(waiting):
            sides.append((waiting[k + 1], anchor(one, waiting[k + 1]), waiting[k + 1][0], one))
        open_ = [b.passable(at, score, near, one) for _, score, near, at in sides]
        target = None
        if len(sides) == 2 and all(open_):
            (left, ls, ln, _), (right, rs, rn, _) = sides
            clear = abs(ls - rs) >= b.c.singleton_recovery_margin or b.alike(ln, one) != b.alike(rn, one)
            if max(ls, rs) >= b.c.singleton_recovery_similarity and clear:
                target = left if ls >= rs else right
        if target is None:
            fit = (s for (s, score, near, _), ok in zip(sides, open_, strict=True) if ok and score >= b.c.singleton_recovery_similarity and absorbs(near, one))
            target = next(fit, None)
        if target is None:
            done.append(segment)
        else:
            target.append(one)
            target.sort()
    return done


def recover_tiny(b: Block, segments: list[list[int]]) -> list[list[int]]:
    """Until nothing changes: segments of up to ``tiny_segment_max_size`` photos join a neighbour where that is allowed."""
    out = [list(s) for s in segments]
    if len(out) < 2:
        return out

    def likeness(left: list[int], right: list[int]) -> float:
        p = b.pair(left[-1], right[0])
        return 0.30 * p["semantic"] + 0.25 * p["subject"] + 0.20 * p["composition"] + 0.15 * p["layout"] + 0.10 * p["background"]

    changed = True
    while changed:
        changed, k = False, 0
        while k < len(out):
            s = out[k]
            if len(s) > b.c.tiny_segment_max_size:
                k += 1
                continue
            options = []  # (score, -side, neighbour); the left one first among equals
            for side, near in ((0, k - 1), (1, k + 1)):
                if 0 <= near < len(out):
                    l, r = (out[near], s) if side == 0 else (s, out[near])
                    score = likeness(l, r)
                    if b.passable(s[0] - 1 if side == 0 else s[-1], score, l[-1], r[0]):
                        options.append((score, -side, near))
            best = max(options, default=None)
            if best is None or best[0] < b.c.tiny_segment_merge_similarity:
                k += 1
                continue
            out[best[2]] = sorted(out[best[2]] + s)
            del out[k]
            changed = True
    return out


def split_by_structure(b: Block, members: list[int]) -> list[list[int]] | None:
    """Cuts a set of rows where its gaps, its span or its size demand it; None where nothing does."""
    m = np.array(sorted(members))
    if len(m) < 2:
        return None
    gap = b.pos[m[1:]] - b.pos[m[:-1]] - 1
    cut = gap > b.c.maximum_internal_gap_size
    if b.timed:
        cut |= np.abs(b.ts[m[1:]] - b.ts[m[:-1]]) > b.c.maximum_adjacent_gap_within_scene_seconds
        cut |= (gap == 0) & b.accepted[m[:-1]] & np.array([b.reliability[x] == "hard" for x in m[:-1]])
    if gap[gap > 0].sum() > b.c.allowed_internal_outliers or (gap > 0).sum() > b.c.maximum_internal_timeline_gaps:
        cut |= gap > 0
    if b.timed and not cut.any() and b.ts[m[-1]] - b.ts[m[0]] > b.c.maximum_scene_span_seconds:
        strength = np.where(gap == 0, b.change[m[:-1]], 0.5 + np.minimum(0.5, gap / 10.0))
        cut[int(np.argmax(strength))] = True
    if not cut.any() and len(m) > b.c.maximum_group_size:
        cut[len(m) // 2 - 1] = True
    return [x.tolist() for x in np.split(m, np.flatnonzero(cut) + 1)] if cut.any() else None


def cohesion(b: Block, members: list[int]) -> tuple[float, int, int]:
    """(combined cohesion, medoid, hard boundaries inside)."""
    m = sorted(members)
    if len(m) == 1:
        return 1.0, m[0], 0
    i, j = np.triu_indices(len(m), 1)
    at = np.array(m)
    p = b.pairs(at[i], at[j])
    scores = np.ones((len(m), len(m)))
    scores[i, j] = scores[j, i] = p["combined"]
    medoid = m[int(np.argmax(scores.mean(axis=1)))]
    gap = b.pos[at[1:]] - b.pos[at[:-1]] - 1
    hard = soft = 0
    penalty = 0.0
    duration = 1.0
    if b.timed:
        inner = at[:-1][(gap == 0) & b.accepted[at[:-1]]]
        is_hard = np.array([b.reliability[x] == "hard" for x in inner], bool)
        hard, soft = int(is_hard.sum()), int((~is_hard).sum())
        penalty = (1.0 if hard else 0.0) + soft * b.c.internal_soft_boundary_penalty + (0.05 * b.change[inner[~is_hard]].max() if soft else 0.0)
        over = b.ts[at[-1]] - b.ts[at[0]] - b.c.maximum_scene_span_seconds
        duration = 1.0 if over <= 0 else float(np.exp(-over / max(b.c.maximum_scene_span_seconds, 1)))
    span = b.pos[at[-1]] - b.pos[at[0]] + 1
    contiguity = np.clip(1.0 - min(0.7, (span - len(m)) / max(span, 1)) - min(0.3, 0.1 * (gap > 0).sum()), 0, 1)
    mean = {k: float(p[k].mean()) for k in ("semantic", "action", "people", "layout", "subject", "background", "composition")}
    # The weights.
    total = (
        0.16 * mean["semantic"] + 0.12 * mean["action"] + 0.08 * mean["people"] + 0.10 * mean["layout"] + 0.12 * mean["subject"] + 0.06 * mean["background"]
        + 0.10 * mean["composition"] + 0.12 * float(np.percentile(p["combined"], 20)) + 0.08 * contiguity + 0.04 * duration + 0.04 * float(b.action_confident[at].mean()) - penalty
    )
    return float(np.clip(min(total, 0.0) if hard else total, 0, 1)), medoid, hard


def average_link_halves(distance: np.ndarray) -> np.ndarray:
    """0/1 labels of the two clusters of average linkage; row 0 is in cluster 0."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - 2):
        a, c = divmod(int(np.argmin(d)), n)
        a, c = min(a, c), max(a, c)
        merged = (size[a] * d[a] + size[c] * d[c]) / (size[a] + size[c])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d[c], d[:, c] = np.inf, np.inf
        size[a] += size[c]
        label[label == c] = a
    return (label != label[0]).astype(int)


def refine(b: Block, members: list[int]) -> list[list[int]]:
    todo, out = [sorted(members)], []
    while todo:
        m = todo.pop(0)
        if len(m) < 2:
            out.append(m)
            continue
        parts = split_by_structure(b, m)
        if parts is None:
            value, _, hard = cohesion(b, m)
            if len(m) <= b.c.maximum_group_size and value >= b.c.minimum_group_cohesion and not hard:
                out.append(m)
                continue
            if len(m) == 2:
                out += [[m[0]], [m[1]]]
                continue
            at = np.array(m)
            i, j = np.triu_indices(len(m), 1)
            d = np.zeros((len(m), len(m)))
            d[i, j] = d[j, i] = 1.0 - b.pairs(at[i], at[j])["combined"]
            side = average_link_halves(d)
            parts = [at[side == 0].tolist(), at[side == 1].tolist()]
        todo = parts + todo
    return out


def edges(b: Block, segment: list[int]) -> dict[tuple[int, int], float]:
    """Admitted edges of a segment: nearest neighbours by semantic vector, and the photos just after on the timeline."""
    at, c = np.array(segment), b.c
    k = min(c.scene_neighbor_count, len(at) - 1)
    wanted: dict[tuple[int, int], float] = {}
    for s in range(0, len(at), 256):
        block = b.vectors["semantic"][at[s : s + 256]] @ b.vectors["semantic"][at].T
        block[np.arange(len(block)), np.arange(s, s + len(block))] = -np.inf
        for x, near in enumerate(np.argsort(-block, axis=1, kind="stable")[:, :k]):
            for y in near:
                wanted.setdefault((min(at[s + x], at[y]), max(at[s + x], at[y])), c.minimum_pair_similarity)
    for step in range(1, c.adjacent_timeline_radius + 1):
        for x, y in zip(at, at[step:], strict=False):
            wanted[(x, y)] = c.minimum_pair_similarity - 0.03
    if not wanted:
        return {}
    i, j = (np.array(x) for x in zip(*wanted, strict=True))
    p = b.pairs(i, j)
    score = p["combined"].copy()
    ok = ~p["action_hard"]
    if b.timed:
        taken = np.concatenate([[0], np.cumsum(b.accepted)])
        hard = np.concatenate([[0], np.cumsum(b.accepted & np.array([r == "hard" for r in b.reliability]))])
        soft = taken[j] > taken[i]
        ok &= hard[j] == hard[i]
        far = np.abs(b.pos[i] - b.pos[j]) > c.maximum_timeline_edge_distance
        ok &= ~far | ((p["semantic"] >= c.long_range_semantic_threshold) & (p["subject"] >= c.long_range_subject_scene_threshold) & ~soft)
        score = np.where(soft, np.maximum(0.0, score - c.soft_cross_boundary_penalty), score)
        ok &= ~soft | (score >= c.cross_soft_boundary_similarity)
    ok &= score >= np.array(list(wanted.values()))
    return {(int(x), int(y)): float(s) for x, y, s in zip(i[ok], j[ok], score[ok], strict=True)}


def components(members: list[int], links: dict[tuple[int, int], float]) -> list[list[int]]:
    root = {m: m for m in members}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in links:
        a, c = find(x), find(y)
        root[max(a, c)] = min(a, c)
    out: dict[int, list[int]] = {}
    for m in members:
        out.setdefault(find(m), []).append(m)
    return list(out.values())


def cluster_segment(b: Block, segment: list[int]) -> list[list[int]]:
    if len(segment) == 1:
        return [segment]
    if len(segment) < b.c.minimum_group_size:
        return []
    found = [r for comp in components(segment, edges(b, segment)) for r in (refine(b, comp) if len(comp) > 1 else [comp])]
    return [r for r in found if len(r) == 1 or len(r) >= b.c.minimum_group_size] if b.timed else [r for r in found if len(r) >= b.c.minimum_group_size]


def merge_neighbours(b: Block, groups: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for now in sorted(map(sorted, groups)):
        if out and out[-1][-1] + 1 == now[0]:
            last = out[-1]
            kind = b.reliability[last[-1]] if b.accepted[last[-1]] else "none"
            ends = [(last[-1], now[0]), (last[-1], now[min(1, len(now) - 1)]), (last[max(0, len(last) - 2)], now[0])]
            bridge = sum(b.score(x, y) for x, y in ends) / 3
            need = max(b.c.adjacent_merge_similarity, b.c.cross_soft_boundary_similarity if kind == "supported" else 0.0)
            both = last + now
            if kind != "hard" and bridge >= need and split_by_structure(b, both) is None and cohesion(b, both)[0] >= b.c.minimum_group_cohesion:
                out[-1] = both
                continue
        out.append(now)
    return out


def representative(b: Block, members: list[int]) -> int:
    """Best quality, then likeness to the medoid, more faces, nearness to the upper median time, path."""
    if len(members) == 1:
        return members[0]
    at = np.array(sorted(members))
    i, j = np.triu_indices(len(at), 1)
    m = np.ones((len(at), len(at)))
    m[i, j] = m[j, i] = b.pairs(at[i], at[j])["combined"]
    near = m[int(np.argmax(m.mean(axis=1)))]
    times = np.sort(b.ts[at][~np.isnan(b.ts[at])])
    middle = times[len(times) // 2] if len(times) else np.nan

    def key(x: int):
        away = abs(b.ts[at[x]] - middle)
        q = b.quality[at[x]]
        return (-(q if q == q else -1.0), -near[x], -b.faces[at[x]], away if away == away else np.inf, b.path[at[x]])

    return int(at[min(range(len(at)), key=key)])


def group_block(rows: pd.DataFrame, config: SceneConfig, timed: bool = True) -> pd.DataFrame:
    """Segments and groups of one block. ``grp`` is the row of the group's first photo, null for ungrouped photos."""
    rows = rows.sort_values(["ts", "path"] if timed else ["path"], kind="stable").reset_index(drop=True)
    b = Block(rows, config, timed)
    if timed:
        segments = recover_tiny(b, recover_singletons(b, raw_segments(b)))
        found = merge_neighbours(b, [g for s in segments for g in cluster_segment(b, s)])
    else:
        b.pos = np.arange(b.n)
        segments = [list(range(b.n))]
        found = cluster_segment(b, segments[0])
    segment = np.zeros(b.n, np.int64)
    for s in segments:
        segment[s] = s[0]
    group, medoid, best, value = [None] * b.n, [None] * b.n, [None] * b.n, [None] * b.n
    todo = list(found)
    while todo:
        g = sorted(todo.pop(0))
        parts = split_by_structure(b, g) if timed else None
        if parts is not None:
            todo += [p for p in parts if len(p) >= b.c.minimum_group_size]
            continue
        c, mid, hard = cohesion(b, g)
        if len(g) > 1 and (c < b.c.minimum_group_cohesion or hard):
            continue
        rep = representative(b, g)
        for x in g:
            group[x], medoid[x], best[x], value[x] = int(b.pos[g[0]]), b.path[mid], b.path[rep], c
    return pd.DataFrame(
        {
            "album": rows["album"], "session": rows["session"], "pos": b.pos, "path": rows["path"], "ts": rows["ts"], "segment": b.pos[segment],
            "grp": pd.array(group, "Int64"), "medoid": medoid, "representative": best, "cohesion": value,
        }
    )


def _for_blocks(df: DataFrame) -> DataFrame:
    meta = [F.col(f"meta.{k}").alias(k) for k in ("orientation", "shot_scale", "face_bucket", "cx", "cy", "hspread", "vspread", "scale")]
    named = [F.col(f"action.{k}").alias(f"action_{k}") for k in ("key", "family", "confident", "strong", "keys")] + [F.col(f"shot.{k}").alias(f"shot_{k}") for k in ("mode", "confident", "strong")]
    return df.select(
        "album", "session", "pos", "path", "ts", "semantic", "people", "layout", "subject", "background", "composition", "color", "action_scores", "face_count", "face_area", "quality",
        "mode", *named, *meta, F.col("meta").isNull().alias("no_meta"), "change", "reliability", "accepted", "block",
    )


def scene_groups(
    features: DataFrame, config: SceneConfig | None = None, concepts: dict[str, tuple[Concept, ...]] | None = None, complete: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row for each photo: album, session (null if untimed), pos, path, ts, segment, grp, medoid, representative, cohesion.
    ``complete`` as in ``transitions``."""
    config = config or SceneConfig()
    judged = transitions(features, config, concepts, complete, [*features.columns, "change", "reliability", "accepted"])
    # A photo alone in its block is a group of its own; only longer blocks need Python.
    alone = judged.filter("alone").select(
        "album", "session", "pos", "path", "ts", F.col("pos").alias("segment"), F.col("pos").alias("grp"), F.col("path").alias("medoid"), F.col("path").alias("representative"), F.lit(1.0).alias("cohesion")
    )

    def whole(rows: DataFrame, *keys: str) -> DataFrame:
        if complete:  # dealt out before the rows become wide
            rows = complete(rows.repartition(*keys).sortWithinPartitions(*keys))
        return _for_blocks(rules.with_profiles(rows, config, concepts)).groupBy(*keys)

    timed = alone.unionByName(whole(judged.filter("not alone"), "album", "session", "block").applyInPandas(lambda rows: group_block(rows, config), OUT))
    empty = {"session": F.lit(None).cast("long"), "pos": F.lit(0).cast("long"), "change": F.lit(None).cast("double"), "reliability": F.lit(None).cast("string"), "accepted": F.lit(None).cast("boolean"), "block": F.lit(0).cast("long")}
    loose = whole(features.filter("ts is null").withColumns(empty), "album").applyInPandas(lambda rows: group_block(rows, config, timed=False), OUT)
    return timed.unionByName(loose)
