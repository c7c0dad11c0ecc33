"""Suffix-array dedup: removes each byte covered by a ``length``-byte string that also starts earlier.

Content-chosen anchors in place of prefix doubling (see ``repeats``): Spark groups the suffixes at anchors by their first
``gram`` bytes, then by pairs of that rank and the rank of all that the anchor's windows cover, and only where such a
pair is not decisive by all ``length`` bytes; suffixes with a unique hash drop out at each step. Text is UTF-8, matches
never cross documents, a null text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Spec, remove_repeats


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 20) -> DataFrame:
    """doc_id, size (bytes), spans (removed, byte offsets), kept (binary) for each row of ``docs`` (doc_id, text)."""
    return remove_repeats(docs, Spec("bytes", length, gram, first_stays=True))
