"""Batch inference with ONNX models inside Spark tasks; one session for each Python worker.

onnxruntime is imported on the workers only. No model ships with the library: paths are parameters and must be readable
on every node (or sent with ``SparkContext.addFile``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .images import decode_boxes, largest_central, suppress

#: Providers in order of preference; those that are not installed are passed over.
PROVIDERS = ("CUDAExecutionProvider", "CoreMLExecutionProvider", "CPUExecutionProvider")
# Channel means and spreads of the visual encoder's input.
MEAN, STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
_sessions: dict = {}


def providers(available: list[str], wanted: tuple[str, ...] = PROVIDERS) -> list[str]:
    found = [p for p in wanted if p in available]
    return found or ["CPUExecutionProvider"]


def session(path: str):
    if path not in _sessions:
        import onnxruntime

        _sessions[path] = onnxruntime.InferenceSession(path, providers=providers(onnxruntime.get_available_providers()))
    return _sessions[path]


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, key: str, model: str, shape: tuple[int, ...], batch: int = 16, run=None) -> DataFrame:
    """(key, embedding) of rows with ``values``, a flat array of a model input; in batches, and one by one where a batch
    fails, so that one bad row gives a null and not an error. ``run(model, array)`` replaces the ONNX session in tests."""
    kind = df.schema[key].dataType.simpleString()

    def infer(x: np.ndarray) -> np.ndarray:
        if run is not None:
            return run(model, x)
        s = session(model)
        return s.run(None, {s.get_inputs()[0].name: x})[0]

    def rows(batches):
        for part in batches:
            values = [None if v is None else np.asarray(v, np.float32) for v in part.column(1).to_pylist()]
            out: list = [None] * len(values)
            for a in range(0, len(values), batch):
                at = [i for i in range(a, min(a + batch, len(values))) if values[i] is not None and values[i].size == int(np.prod(shape))]
                if not at:
                    continue
                try:
                    for i, e in zip(at, unit_rows(np.asarray(infer(np.stack([values[i].reshape(shape) for i in at])), float)), strict=True):
                        out[i] = e.tolist()
                except Exception:
                    for i in at:
                        try:
                            out[i] = unit_rows(np.asarray(infer(values[i].reshape(1, *shape)), float))[0].tolist()
                        except Exception:
                            out[i] = None
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "embedding"])

    return df.select(key, "values").mapInArrow(rows, f"{key} {kind}, embedding array<double>")


def anchor_points(height: int, width: int, stride: int, per_cell: int = 2) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    return np.repeat(np.stack([x, y], axis=-1).reshape(-1, 2) * stride, per_cell, axis=0).astype(float)


def detections(scores: list[np.ndarray], distances: list[np.ndarray], points: list[np.ndarray], size: tuple[int, int], strides=(8, 16, 32), least: float = 0.7, overlap: float = 0.4, most: int = 0):
    """Boxes, scores and five key points from the detector's raw maps, one entry a stride, of an input of (height, width)."""
    boxes, kept, marks = [], [], []
    for s, d, k, stride in zip(scores, distances, points, strides, strict=True):
        anchors = anchor_points(size[0] // stride, size[1] // stride, stride)
        at = np.flatnonzero(s.ravel() >= least)
        boxes.append(decode_boxes(anchors[at], d.reshape(-1, 4)[at] * stride))
        marks.append(anchors[at][:, None, :] + k.reshape(-1, 5, 2)[at] * stride)
        kept.append(s.ravel()[at])
    b, c, m = np.concatenate(boxes), np.concatenate(kept), np.concatenate(marks)
    order = suppress(b, c, overlap)
    b, c, m = b[order], c[order], m[order]
    if 0 < most < len(b):
        pick = largest_central(b, size[1], size[0], most)
        b, c, m = b[pick], c[pick], m[pick]
    return b, c, m
