"""Group labels: from the best concepts of a group, else from its people and how many take part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import people_label

#: Descriptor by the dominant participant mode. Fixed values.
DESCRIPTORS = {"couple": "Couple Portrait", "family_group": "Group Portrait", "small_group": "Group Portrait", "crowd": "Group Portrait", "solo": "Portrait"}


def fallback_label(people: Column, mode: Column, any_face: Column) -> Column:
    """``people``: names by frequency; ``mode``: the dominant participant mode."""
    named = people_label(people)
    what = F.when(any_face, "Portrait Sequence").otherwise("Untitled scene")
    for key, text in reversed(DESCRIPTORS.items()):
        what = F.when(mode == key, text).otherwise(what)
    return F.when(named.isNotNull(), F.concat_ws(" · ", named, what)).otherwise(what)


def group_label(actions: Column, scenes: Column, shots: Column, people: Column, mode: Column, any_face: Column) -> Column:
    """``actions``, ``scenes``, ``shots``: arrays of (label, tags), best first, may be empty or null."""
    named = people_label(people)
    first, second = F.get(actions, 0), F.get(actions, 1)
    has = lambda a, t: F.coalesce(F.array_contains(a["tags"], t), F.lit(False))
    scene, shot = F.get(scenes, 0)["label"], F.get(shots, 0)["label"]
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    reaction = has(first, "audience") | has(first, "reaction")
    by_action = (
        F.when(reaction & has(second, "speech"), F.concat(second["label"], F.lit(" · Audience Reaction")))
        .when(reaction & (first["label"] == "Audience Listening"), F.lit("Audience Reaction"))
        .when(reaction, first["label"])
        .when(has(first, "portrait") & named.isNotNull() & ~first["label"].isin("Portrait", "Solo Portrait"), F.concat_ws(" · ", named, first["label"]))
        .otherwise(first["label"])
    )
    return (
        F.when(some(actions), by_action).when(some(scenes) & some(shots), F.concat_ws(" · ", scene, shot)).when(some(scenes), scene).when(some(shots), shot)
        .when(named.isNotNull(), F.concat(named, F.lit(" · Scene"))).otherwise(fallback_label(people, mode, any_face))
    )
