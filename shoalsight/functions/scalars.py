"""Small scalar expressions: paths, names, numbers, times, bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes for white space, within ASCII.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
# Fixed value: characters that file names must not hold.
UNSAFE = '<>:"/\\|?*'


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names without one and for names that are a suffix alone."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def normalize_extensions(values: Column) -> Column:
    """Stripped, lower-cased, with a leading dot; blanks dropped, order kept, repeats removed."""
    dotted = F.transform(values, lambda x: F.lower(strip(x)))
    dotted = F.transform(F.filter(dotted, lambda x: x != ""), lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))
    return F.array_distinct(dotted)


def resolve_extensions(supported: Column, selected: Column) -> Column:
    """Selected ones among the supported, in supported order; everything supported where nothing is left."""
    both = F.array_intersect(supported, selected)
    return F.when(selected.isNull() | (F.size(both) == 0), supported).otherwise(both)


def safe_name(title: Column) -> Column:
    """Folder name of a group title: counts cut off, unsafe characters replaced, outer spaces and dots removed."""
    counted = title.endswith(" photos)") & title.contains(" (")
    head = F.when(counted, F.regexp_replace(title, r" \([^(]*$", "")).otherwise(title)
    clean = F.btrim(F.translate(strip(head), UNSAFE, "_" * len(UNSAFE)), F.lit(" ."))
    return F.when(clean == "", F.lit("Unnamed")).otherwise(clean)


def debug_name(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def minute_text(ts: Column) -> Column:
    """UTC whatever the session's time zone."""
    wall = F.timestamp_add("SECOND", F.floor(ts).cast("long"), epoch())
    return F.when(ts.isNull(), F.lit("Unknown time")).otherwise(F.date_format(wall, "yyyy-MM-dd HH:mm 'UTC'"))


def time_range_text(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), F.lit(None).cast("string"))
        .when(start.isNull(), F.concat(F.lit("Ends "), minute_text(end)))
        .when(end.isNull() | (F.abs(end - start) < 1.0), minute_text(start))
        .otherwise(F.concat_ws(" -> ", minute_text(start), minute_text(end)))
    )


def exif_seconds(text: Column) -> Column:
    """UTC seconds of "yyyy:MM:dd HH:mm:ss" or "yyyy-MM-dd HH:mm:ss"; null for anything else."""
    t = strip(text)
    stamp = F.coalesce(F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.timestamp_diff("MICROSECOND", epoch(), stamp.cast("timestamp_ntz")) / 1e6


def day_number(ts: Column) -> Column:
    return F.floor(ts / 86400)


def hash_words(hex_text: Column, words: int = 4) -> list[Column]:
    """BIGINT words of a hex string of 16 digits a word, most significant first."""
    return [F.conv(F.substring(hex_text, 16 * k + 1, 16), 16, -10).cast("long") for k in range(words)]


def hash_hex(words: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def nearest_rank(sorted_values: Column, fraction: float) -> Column:
    """Element at the half-even rounded rank (n - 1) * fraction of a sorted array."""
    n = F.size(sorted_values)
    at = F.bround((n - 1) * F.lit(fraction), 0).cast("int")
    return F.get(sorted_values, F.greatest(F.lit(0), F.least(n - 1, at)))


def people_label(names: Column) -> Column:
    n = F.size(names)
    two = F.concat(F.get(names, 0), F.lit(" & "), F.get(names, 1))
    return (
        F.when(names.isNull() | (n == 0), F.lit(None).cast("string"))
        .when(n == 1, F.get(names, 0))
        .when(n == 2, two)
        .otherwise(F.concat(two, F.lit(" +"), (n - 2).cast("string")))
    )
