"""Quality rules: a threshold table compiled into one projection.

Every rule names a measure and the closed range in which a document passes. ``measures`` computes all
measures with built-in expressions (no user function, no shuffle: one pass over the rows), and ``apply_rules``
turns the table into a single ``kept`` expression plus the array of the rules that failed.

Defined results: a null, empty or blank text has no words, all counts 0 and is not kept. Repeated rows are judged
one by one. Columns beside ``text`` pass through; those whose names clash with a measure are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_where, let, text_or_empty, words

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as was be by this are at from or an have not they which".split(),
    "fr": "le la les de des et en un une que qui dans pour par sur est pas avec au ce il du se ne".split(),
    "de": "der die das und in zu den von mit ist auf für im nicht ein eine sich dem des auch als an es".split(),
    "es": "el la los las de que y en un una por con para es del se no al lo como su más o".split(),
}


@dataclass(frozen=True)
class Rule:
    """Passes while ``low <= measure <= high``; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Bounds are loose on purpose: a rule removes what no prose looks like and leaves clean documents alone.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("pipe_ratio", None, 0.25),
    Rule("capital_ratio", None, 0.5),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.95),
)


def _count(text: Column, chars: str) -> Column:
    """Characters of the class ``chars``. One search by pattern: ``translate`` looks up every character of the text."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def repeated_words(w: Column, window: int = 3) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the array; O(n log n) by sorting hashes,
    which is left out where all hashes differ."""
    hashes = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]),
    )
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, window)))


def _covered(hashes: Column, window: int) -> Column:
    grams = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def positions(g: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(g, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(g, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"])

    starts = F.sort_array(let(F.sort_array(grams), positions))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + window - F.greatest(a["end"], p)).alias("n"), (p + window).alias("end")),
        lambda a: a["n"],
    )


def measures(docs: DataFrame, stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds the counts and ratios that rules may name."""
    stops = sorted({x for ws in (stop_words or STOP_WORDS).values() for x in ws})
    t = text_or_empty("text")
    first = docs.withColumns({"_t": t, "_w": words(t), "_lines": F.split(t, "\n")})
    longest = max(map(len, stops), default=0)
    with_word = F.filter("_lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    second = first.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": _count(F.col("_t"), "#*$%&|<>").cast("long"),
            "_capitals": _count(F.col("_t"), "A-Z"),
            "_pipes": F.length("_t") - F.length(F.replace("_t", F.lit("|"), F.lit(""))),
            "n_repeat_words": repeated_words(F.col("_w")).cast("long"),
            "_said": with_word,
            "_stops": F.size(F.filter("_w", lambda x: (F.length(x) <= longest) & ascii_lower(x).isin(stops))),
        }
    )
    lines = F.greatest(F.size("_said"), F.lit(1))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return second.withColumns(
        {
            "n_dup_lines": (F.size("_said") - F.size(F.array_distinct("_said"))).cast("long"),
            "mean_word_chars": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "pipe_ratio": F.col("_pipes") / n,
            "capital_ratio": F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
            "stop_ratio": F.col("_stops") / n,
            "dup_line_ratio": (F.size("_said") - F.size(F.array_distinct("_said"))) / lines,
            "ellipsis_line_ratio": F.size(F.filter("_said", lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)\s*$")))) / lines,
            "bullet_line_ratio": F.size(F.filter("_said", lambda x: F.rlike(x, F.lit(r"^\s*[-*•]")))) / lines,
        }
    ).drop("_t", "_w", "_lines", "_said", "_capitals", "_pipes", "_stops")


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed_rules (names, table order) and kept."""
    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        checks.append(F.when(bad, F.lit(r.measure)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*checks))}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return apply_rules(measures(docs), rules)


def filter_by_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    judged = quality_rules(docs.withColumn("_row", F.struct(*docs.columns)), rules).select("_row", "kept")
    return keep_where(judged, F.col("kept")).select("_row.*")
