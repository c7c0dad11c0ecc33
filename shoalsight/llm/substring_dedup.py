"""Substring dedup: removes each word covered by a window of ``length`` words that occurs anywhere else.

Content-chosen anchors in place of level-wise doubling (see ``repeats``): windows are candidates at full length only if the ``gram`` words at their anchor repeat,
and are compared one by one only where the covering contexts of such a gram differ. Words are maximal runs of
non-separators, compared unchanged; a null text has none. All occurrences are removed, the first included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Spec, remove_repeats


def substring_dedup(docs: DataFrame, length: int = 35, gram: int = 8) -> DataFrame:
    """doc_id, size (words), spans (removed, word offsets), kept (words joined by a space, binary) for each row of ``docs``."""
    return remove_repeats(docs, Spec("words", length, gram, first_stays=False))
