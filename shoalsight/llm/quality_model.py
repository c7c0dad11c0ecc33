"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features`` turns each text into a fixed row of statistics (one pass, whole texts). ``fit`` grows trees on
histograms of at most ``bins`` quantile bins per feature, logistic loss, second-order gains. A fitted model is a few
flat arrays (feature, threshold, left child, leaf value) that ``Model.score`` walks for all rows of a batch at once.

Training rows are a bounded, documented sample: labelled rows outside the held-out fold, at most ``max_train`` of
them, those with the smallest xxhash64(doc_id). Labels, lang, source and doc_id are never inputs.

Defined results: a null text has the statistics of the empty text and gets a score like any other; a null doc_id is
never held out and never trained on; rows without usable labels make the prior 0.5; repeated rows score alike. Of rows
that share a doc_id one is trained on, that with the least hash of its statistics, and of repeated labels the greatest
counts, so reruns agree. Texts of any length are measured whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import STOP_WORDS

_STOPS = frozenset(x for ws in STOP_WORDS.values() for x in ws)

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "'\"()[]{}", "#*$%&|<>", "-_/\\@+=~^`"], 1):
    for _c in _chars.encode():
        _CLASS[_c] = _k
NAMES = [
    *["share_other", "share_lower", "share_upper", "share_digit", "share_space", "share_break", "share_stop", "share_mark", "share_quote", "share_symbol", "share_joint"],
    *["log_words", "log_chars", "mean_word", "distinct_share", "stop_share", "top_share", "pair_share", "next_same_share", "lines_log", "dup_line_share", "line_words", "bare_share", "capital_word_share"],
]


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8")
    n = max(len(raw), 1)
    shares = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / n
    w = text.split()
    k = max(len(w), 1)
    counts: dict[str, int] = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(w, w[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    ends = text.replace("\n", " ").split(". ")
    return [
        *shares,
        float(np.log1p(len(w))),
        float(np.log1p(len(text))),
        sum(map(len, w)) / k,
        len(counts) / k,
        sum(c for x, c in counts.items() if x.lower() in _STOPS) / k,
        max(counts.values(), default=0) / k,
        pairs / max(k - 1, 1),
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / k,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(len(lines), 1),
        k / max(len(lines), 1),
        len(ends) / k,
        sum(c for x, c in counts.items() if len(x) > 1 and x.isupper()) / k,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of statistics in the order of NAMES."""

    def computed(batches):
        for batch in batches:
            rows = [statistics(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(computed, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    """All trees end to end: node i of tree t is ``roots[t] + i``; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + right)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, min_rows: int = 10, penalty: float = 1.0) -> Model:
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (y.sum() + 0.5) / (len(y) + 1)
        empty = np.zeros(0, np.int64)
        return Model(float(np.log(p / (1 - p))), empty, empty, np.zeros(0), empty, np.zeros(0), depth)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(d)], axis=1)  # bin b: x <= cuts[b]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    raw = np.full(n, base)
    roots, feature, threshold, left, value = [], [], [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(len(left)), value.append(0.0)
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -rate * gs / (hs + penalty)
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * min_rows:
                for f in range(d):
                    size = len(cuts[f]) + 1
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=size))[:-1] for v in (g[rows], h[rows], None))
                    ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
                    gain = np.where(ok, gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty), 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] < 0:
                raw[rows] += value[node]
                continue
            _, f, cut = best
            feature[node], threshold[node], left[node] = f, cuts[f][cut], len(feature)
            goes = binned[rows, f] > cut
            for side in (rows[~goes], rows[goes]):
                feature.append(-1), threshold.append(0.0), left.append(len(left)), value.append(0.0)
                todo.append((len(feature) - 1, side, level + 1))
    return Model(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; ``labels``: doc_id, quality."""
    stats = written(features(docs), "statistics")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = stats.join(sample, "doc_id").groupBy("doc_id").agg(F.min_by("x", F.struct(F.xxhash64("x"), F.col("x"))).alias("x"), F.max("quality").alias("quality"))
    train = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "quality").toArrow()
    x = np.asarray(train["x"].combine_chunks().flatten(), float).reshape(len(train), len(NAMES))
    model = fit(x, train["quality"].to_numpy().astype(float))

    def arrow(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(arrow, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted"))
