"""Configuration of scene grouping with its presets, and of the other pipelines. Values are fixed defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


# Counts that may be 0, and settings of which the first may not exceed the second.
_MAY_BE_ZERO = ("allowed_internal_outliers", "maximum_internal_timeline_gaps", "maximum_internal_gap_size", "tiny_segment_max_size")
_ORDERED = (
    ("minimum_pair_similarity", "strong_pair_similarity"),
    ("minimum_group_size", "maximum_group_size"),
    ("maximum_soft_time_gap_seconds", "maximum_hard_time_gap_seconds"),
    ("maximum_adjacent_gap_within_scene_seconds", "maximum_scene_span_seconds"),
    ("soft_boundary_threshold", "hard_boundary_threshold"),
    ("semantic_soft_boundary_threshold", "semantic_hard_boundary_threshold"),
    ("composition_soft_boundary_threshold", "composition_hard_boundary_threshold"),
    ("minimum_action_margin", "strong_action_margin"),
    ("minimum_shot_margin", "strong_shot_margin"),
    ("action_conflict_penalty", "strong_action_conflict_penalty"),
    ("participant_mode_weak_penalty", "participant_mode_strong_penalty"),
    ("main_vs_reaction_supported_penalty", "main_vs_reaction_strong_penalty"),
)


@dataclass(frozen=True)
class SceneConfig:
    # The balanced preset.
    semantic_weight: float = 0.27
    action_weight: float = 0.14
    people_weight: float = 0.08
    layout_weight: float = 0.13
    subject_weight: float = 0.19
    background_weight: float = 0.04
    time_weight: float = 0.04
    composition_weight: float = 0.11
    color_weight: float = 0.0
    minimum_pair_similarity: float = 0.74
    strong_pair_similarity: float = 0.86
    minimum_group_cohesion: float = 0.76
    session_gap_seconds: int = 1800
    maximum_soft_time_gap_seconds: int = 1200
    maximum_hard_time_gap_seconds: int = 7200
    maximum_scene_span_seconds: int = 600
    maximum_adjacent_gap_within_scene_seconds: int = 180
    hard_boundary_threshold: float = 0.32
    soft_boundary_threshold: float = 0.22
    semantic_hard_boundary_threshold: float = 0.42
    semantic_soft_boundary_threshold: float = 0.33
    composition_hard_boundary_threshold: float = 0.72
    composition_soft_boundary_threshold: float = 0.48
    layout_hard_support_threshold: float = 0.25
    background_hard_support_threshold: float = 0.38
    boundary_support_margin: float = 0.04
    boundary_context_window: int = 2
    scene_neighbor_count: int = 6
    adjacent_timeline_radius: int = 3
    maximum_timeline_edge_distance: int = 6
    allowed_internal_outliers: int = 2
    maximum_internal_timeline_gaps: int = 2
    maximum_internal_gap_size: int = 2
    minimum_group_size: int = 2
    maximum_group_size: int = 40
    minimum_action_margin: float = 0.012
    strong_action_margin: float = 0.025
    minimum_shot_margin: float = 0.025
    strong_shot_margin: float = 0.045
    action_conflict_penalty: float = 0.20
    strong_action_conflict_penalty: float = 0.30
    participant_mode_weak_penalty: float = 0.03
    participant_mode_strong_penalty: float = 0.10
    shot_mode_conflict_penalty: float = 0.03
    main_vs_reaction_supported_penalty: float = 0.08
    main_vs_reaction_strong_penalty: float = 0.16
    temporal_bridge_penalty: float = 0.08
    soft_cross_boundary_penalty: float = 0.14
    cross_soft_boundary_similarity: float = 0.86
    internal_soft_boundary_penalty: float = 0.10
    conflict_visual_support_threshold: float = 0.22
    conflict_strong_visual_support_threshold: float = 0.32
    conflict_subject_scene_support_threshold: float = 0.20
    conflict_subject_scene_strong_support_threshold: float = 0.30
    conflict_composition_support_threshold: float = 0.30
    conflict_composition_strong_support_threshold: float = 0.42
    conflict_layout_support_threshold: float = 0.22
    conflict_layout_strong_support_threshold: float = 0.20
    continuity_semantic_similarity: float = 0.88
    continuity_subject_scene_similarity: float = 0.88
    continuity_composition_similarity: float = 0.86
    continuity_layout_similarity: float = 0.82
    continuity_background_similarity: float = 0.92
    transition_semantic_weight: float = 0.28
    transition_action_weight: float = 0.16
    transition_people_weight: float = 0.08
    transition_layout_weight: float = 0.15
    transition_background_weight: float = 0.08
    transition_composition_weight: float = 0.21
    transition_temporal_weight: float = 0.04
    adjacent_merge_similarity: float = 0.84
    singleton_recovery_similarity: float = 0.78
    singleton_recovery_margin: float = 0.04
    tiny_segment_max_size: int = 2
    tiny_segment_merge_similarity: float = 0.80
    weak_boundary_merge_similarity: float = 0.82
    supported_boundary_merge_similarity: float = 0.88
    long_range_semantic_threshold: float = 0.90
    long_range_subject_scene_threshold: float = 0.88
    include_people: bool = True
    include_color: bool = True
    include_composition: bool = True
    include_subject: bool = True
    include_background: bool = True

    def __post_init__(self) -> None:
        bad = [f.name for f in fields(self) if isinstance(getattr(self, f.name), float) and not 0.0 <= getattr(self, f.name) <= 1.0]
        whole = [f.name for f in fields(self) if isinstance(getattr(self, f.name), int) and not isinstance(getattr(self, f.name), bool)]
        bad += [n for n in whole if getattr(self, n) < (0 if n in _MAY_BE_ZERO else 1)]
        bad += [great for small, great in _ORDERED if getattr(self, small) > getattr(self, great)]
        if not sum(self.weights().values()) > 0:
            bad.append("weights")
        if bad:
            raise ValueError("out of range: " + ", ".join(sorted(set(bad))))

    def weights(self) -> dict[str, float]:
        """Weights of the signals that are switched on, by column name."""
        off = {"people": not self.include_people, "color": not self.include_color, "composition": not self.include_composition, "subject": not self.include_subject, "background": not self.include_background}
        names = ("semantic", "action", "people", "layout", "subject", "background", "time", "composition", "color")
        return {n: 0.0 if off.get(n) else getattr(self, f"{n}_weight") for n in names}

    def transition_weights(self) -> dict[str, float]:
        names = ("semantic", "action", "people", "layout", "background", "composition", "temporal")
        return {n: getattr(self, f"transition_{n}_weight") for n in names}

    def signature(self) -> str:
        """Text for cache keys: all values, by name."""
        return json.dumps(asdict(self), sort_keys=True)


# What the other presets change.
PRESETS = {
    "balanced": {},
    "session": dict(
        semantic_weight=0.42, action_weight=0.10, people_weight=0.18, layout_weight=0.06, subject_weight=0.06, background_weight=0.03, time_weight=0.15, composition_weight=0.04, color_weight=0.02,
        minimum_pair_similarity=0.60, strong_pair_similarity=0.76, minimum_group_cohesion=0.63, session_gap_seconds=2100, maximum_soft_time_gap_seconds=1500, maximum_scene_span_seconds=3600,
        maximum_adjacent_gap_within_scene_seconds=600, hard_boundary_threshold=0.76, soft_boundary_threshold=0.58, scene_neighbor_count=16, adjacent_timeline_radius=5,
        maximum_timeline_edge_distance=12, maximum_group_size=80, include_subject=False, include_background=False,
    ),
    "tight": dict(
        semantic_weight=0.24, action_weight=0.16, people_weight=0.07, layout_weight=0.15, subject_weight=0.22, background_weight=0.03, time_weight=0.02, composition_weight=0.11, color_weight=0.0,
        minimum_pair_similarity=0.78, strong_pair_similarity=0.89, minimum_group_cohesion=0.80, hard_boundary_threshold=0.28, soft_boundary_threshold=0.18, scene_neighbor_count=4,
        adjacent_timeline_radius=2, maximum_timeline_edge_distance=4, maximum_group_size=25, maximum_scene_span_seconds=300, maximum_adjacent_gap_within_scene_seconds=90, allowed_internal_outliers=1,
        minimum_action_margin=0.010, strong_action_margin=0.022, minimum_shot_margin=0.022, strong_shot_margin=0.040, action_conflict_penalty=0.22, strong_action_conflict_penalty=0.32,
        shot_mode_conflict_penalty=0.04, continuity_semantic_similarity=0.90, continuity_subject_scene_similarity=0.90, continuity_composition_similarity=0.88, continuity_layout_similarity=0.84,
        continuity_background_similarity=0.93, soft_cross_boundary_penalty=0.18, cross_soft_boundary_similarity=0.90, internal_soft_boundary_penalty=0.12, boundary_support_margin=0.03,
        adjacent_merge_similarity=0.88, singleton_recovery_similarity=0.81, singleton_recovery_margin=0.05, tiny_segment_merge_similarity=0.83, weak_boundary_merge_similarity=0.85,
        supported_boundary_merge_similarity=0.91, transition_semantic_weight=0.26, transition_action_weight=0.18, transition_people_weight=0.07, transition_layout_weight=0.16,
        transition_background_weight=0.06, transition_composition_weight=0.24, transition_temporal_weight=0.03,
    ),
}


def preset(name: str, **changes) -> SceneConfig:
    return replace(SceneConfig(), **PRESETS[name] | changes)


def infer_preset(config: SceneConfig) -> str:
    """The preset whose values all hold; balanced otherwise."""
    return next((n for n in ("session", "tight") if all(getattr(config, k) == v for k, v in PRESETS[n].items())), "balanced")


@dataclass(frozen=True)
class DuplicateConfig:
    maximum_phash_distance: int = 18
    maximum_dhash_distance: int = 18
    verify: bool = True

    def __post_init__(self) -> None:
        if not (0 <= self.maximum_phash_distance <= 64 and 0 <= self.maximum_dhash_distance <= 64):
            raise ValueError("hash distances must lie between 0 and 64")


@dataclass(frozen=True)
class FaceConfig:
    recognition_threshold: float = 0.60
    cluster_threshold: float = 0.63
    known_people_only: bool = False
