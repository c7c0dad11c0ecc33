"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns; sums are taken in doubles, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def clip01(x: Column) -> Column:
    """Null stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def l2_normalize(v: Column | str, tiny: float = 1e-12) -> Column:
    """Unit vector; a vector of length ``tiny`` or less is returned as it is."""
    n = norm(v)
    return F.when(n <= tiny, F.transform(_col(v), lambda x: x.cast("double"))).otherwise(
        F.element_at(F.transform(F.array(n), lambda m: F.transform(_col(v), lambda x: x.cast("double") / m)), 1)
    )


def l2_normalize_floor(v: Column | str, floor: float = 1e-12) -> Column:
    """Batch form: divides by the length or ``floor``, whichever is greater."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.element_at(F.transform(F.array(n), lambda m: F.transform(_col(v), lambda x: x.cast("double") / m)), 1)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1.0 - dot(a, b)


def optional_cosine(a: Column | str, b: Column | str) -> Column:
    """Clipped dot product of unit vectors; 0.5 where one is missing or the lengths differ."""
    a, b = _col(a), _col(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), 0.5).otherwise(clip01(dot(a, b)))


def centered_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of the mean-centred vectors mapped to 0..1; 0.5 where it is undefined."""
    a, b = _col(a), _col(b)

    def centred(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
        return F.element_at(F.transform(F.array(mean), lambda m: F.transform(v, lambda x: x.cast("double") - m)), 1)

    def similarity(p: Column) -> Column:
        x, y = p["x"], p["y"]
        nx, ny = F.sqrt(dot(x, x)), F.sqrt(dot(y, y))
        return F.when((nx <= 1e-12) | (ny <= 1e-12), 0.5).otherwise(clip01((dot(x, y) / (nx * ny) + 1.0) / 2.0))

    pair = F.array(F.struct(centred(a).alias("x"), centred(b).alias("y")))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), 0.5).otherwise(F.element_at(F.transform(pair, similarity), 1))


def set_similarity(a: Column | str, b: Column | str, both_empty: float = 0.5, one_empty: float = 0.35) -> Column:
    """Jaccard similarity of two arrays taken as sets."""
    a, b = F.coalesce(_col(a), F.array().cast("array<string>")), F.coalesce(_col(b), F.array().cast("array<string>"))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty)
        .when((F.size(a) == 0) | (F.size(b) == 0), one_empty)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def time_similarity(delta_seconds: Column, scale_seconds: float) -> Column:
    return F.exp(-F.greatest(delta_seconds, F.lit(0.0)) / max(scale_seconds, 1.0))
