"""Image measures in NumPy over arrays of grey or BGR values; borders are mirrored without repeating the edge.

They take decoded arrays, so they work with any decoder; ``over_pixels`` runs them on a table of raw pixel rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _pad(grey: np.ndarray) -> np.ndarray:
    mode = "reflect" if min(grey.shape) > 1 else "edge"
    return np.pad(grey.astype(float), 1, mode=mode)


def laplacian_variance(grey: np.ndarray) -> float:
    p = _pad(grey)
    out = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(out.var())


def sobel_mean(grey: np.ndarray) -> float:
    p = _pad(grey)
    column = p[:-2] + 2 * p[1:-1] + p[2:]
    row = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = column[:, 2:] - column[:, :-2], row[2:] - row[:-2]
    return float(np.sqrt(gx**2 + gy**2).mean())


def tile_contrast(grey: np.ndarray, tiles: int = 8) -> float:
    """Mean standard deviation of the tiles; rows and columns that do not fill a tile are cropped."""
    h, w = grey.shape[0] // tiles, grey.shape[1] // tiles
    if not h or not w:
        return 0.0
    cut = grey[: h * tiles, : w * tiles].astype(float).reshape(tiles, h, tiles, w)
    return float(cut.std(axis=(1, 3)).mean())


def shrink(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area-weighted means."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        low = np.clip(np.arange(n)[None, :], edges[:-1, None], edges[1:, None])
        high = np.clip(np.arange(1, n + 1)[None, :], edges[:-1, None], edges[1:, None])
        return (high - low) * m / n

    return weights(grey.shape[0], h) @ grey.astype(float) @ weights(grey.shape[1], w).T


def _words(bits: np.ndarray) -> list[int]:
    packed = np.packbits(bits.ravel().astype(np.uint8))
    return np.frombuffer(packed.tobytes(), ">i8").astype(np.int64).tolist()


def difference_hash(grey: np.ndarray, size: int = 16) -> list[int]:
    small = shrink(grey, size, size + 1)
    return _words(small[:, 1:] > small[:, :-1])


def perceptual_hash(grey: np.ndarray, size: int = 16, factor: int = 4) -> list[int]:
    """Low frequencies of the cosine transform against their median, as 64-bit words."""
    n = size * factor
    small = shrink(grey, n, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:size, :size]
    return _words(low > np.median(low))


def exposure(grey: np.ndarray, dark: float = 5.0, bright: float = 250.0) -> dict[str, float]:
    p = np.percentile(grey, (5, 25, 50, 75, 95))
    return {"dark_share": float((grey <= dark).mean()), "bright_share": float((grey >= bright).mean()), "median": float(p[2]), "tonal_range": float(p[4] - p[0]), "contrast": float(grey.std()), "quartiles": float(p[3] - p[1])}


def sharpness(grey: np.ndarray) -> dict[str, float]:
    p = _pad(grey)
    column, row = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    tenengrad = float(((column[:, 2:] - column[:, :-2]) ** 2 + (row[2:] - row[:-2]) ** 2).mean())
    blurred = sum(p[i : i + grey.shape[0], j : j + grey.shape[1]] for i in range(3) for j in range(3)) / 9
    high = float(np.abs(grey - blurred).mean())
    lap = laplacian_variance(grey)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    # Weights are fixed values; centres and widths are ours.
    score = 0.46 * sigmoid((np.log1p(lap) - 4.5) / 0.9) + 0.34 * sigmoid((np.log1p(tenengrad) - 7.0) / 1.0) + 0.20 * sigmoid((np.log1p(high) - 1.2) / 0.5)
    return {"laplacian": lap, "tenengrad": tenengrad, "high_frequency": high, "focus": float(score)}


def color_descriptor(bgr: np.ndarray) -> np.ndarray:
    """29 values, unit length: HSV means and spreads, opponent-colour means, histograms of 8, 4 and 4, four scalars."""
    b, g, r = (bgr[..., k].astype(float) / 255 for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = np.where(top > low, top - low, 1)
    hue = np.select([top == low, top == r, top == g], [0.0, ((g - b) / d) % 6, (b - r) / d + 2], (r - g) / d + 4) / 6
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    hist = lambda x, n: np.histogram(x, bins=n, range=(0, 1))[0] / x.size
    light = (r + g + b) / 3
    values = [
        hue.mean(), sat.mean(), top.mean(), hue.std(), sat.std(), top.std(), light.mean(), (r - g).mean(), (light - b).mean(),
        *hist(hue, 8), *hist(sat, 4), *hist(top, 4), light.mean(), light.std(), (r - b).mean() / 2 + 0.5, 1 - sat.mean(),
    ]
    v = np.array(values)
    return v / max(np.linalg.norm(v), 1e-12)


def fallback_embedding(bgr: np.ndarray, side: int = 14, bins: int = 64) -> np.ndarray:
    """Unit vector of side*side*4 + bins values: small colour planes, gradients and a grey histogram."""
    planes = [shrink(bgr[..., k], side, side) / 255 for k in range(3)]
    grey = sum(planes) / 3
    p = _pad(grey)
    edge = np.hypot(p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1])
    hist = np.histogram(bgr.mean(axis=2), bins=bins, range=(0, 256))[0] / bgr[..., 0].size
    v = np.concatenate([*(x.ravel() for x in planes), edge.ravel(), hist])
    return v / max(np.linalg.norm(v), 1e-12)


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float = 0.4) -> list[int]:
    """Greedy non-maximum suppression over (x1, y1, x2, y2) with inclusive pixel borders; kept rows, best first."""
    x1, y1, x2, y2 = boxes.T
    area = (x2 - x1 + 1) * (y2 - y1 + 1)
    left, kept = np.argsort(-scores, kind="stable"), []
    while len(left):
        i, rest = left[0], left[1:]
        kept.append(int(i))
        w = np.maximum(0.0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]) + 1)
        h = np.maximum(0.0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]) + 1)
        left = rest[w * h / (area[i] + area[rest] - w * h) <= limit]
    return kept


def largest_central(boxes: np.ndarray, width: float, height: float, most: int) -> list[int]:
    """The ``most`` boxes of greatest area less twice the squared distance from the image's centre."""
    x1, y1, x2, y2 = boxes.T
    away = ((x1 + x2) / 2 - width / 2) ** 2 + ((y1 + y2) / 2 - height / 2) ** 2
    return np.argsort(-((x2 - x1) * (y2 - y1) - 2 * away), kind="stable")[:most].tolist()


def decode_boxes(points: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Boxes from anchor points and the distances to the left, top, right and bottom."""
    return np.concatenate([points - distances[:, :2], points + distances[:, 2:]], axis=1)


def rotation_from_6d(v: np.ndarray) -> np.ndarray:
    """Rotation matrix from two columns, made orthonormal."""
    a = v[:3] / np.linalg.norm(v[:3])
    b = v[3:6] - (a @ v[3:6]) * a
    b /= np.linalg.norm(b)
    return np.stack([a, b, np.cross(a, b)], axis=1)


def euler_degrees(m: np.ndarray) -> tuple[float, float, float]:
    """(pitch, yaw, roll) of the rotation nearest to a 3 x 3 matrix."""
    u, _, vt = np.linalg.svd(m)
    r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    s = float(np.hypot(r[0, 0], r[1, 0]))
    if s > 1e-6:
        out = np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], s), np.arctan2(r[1, 0], r[0, 0])
    else:
        out = np.arctan2(-r[1, 2], r[1, 1]), np.arctan2(-r[2, 0], s), 0.0
    return tuple(float(np.degrees(x)) for x in out)


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of rotation, scale and shift that takes points src to dst with least squares."""
    sm, dm = src.mean(axis=0), dst.mean(axis=0)
    a, b = src - sm, dst - dm
    norm = (a**2).sum()
    c, s = (a * b).sum() / norm, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / norm
    m = np.array([[c, -s], [s, c]])
    return np.concatenate([m, (dm - m @ sm)[:, None]], axis=1)


MEASURES = {"laplacian": laplacian_variance, "sobel": sobel_mean, "local_contrast": tile_contrast}
HASHES = {"p": perceptual_hash, "d": difference_hash}


def over_pixels(df: DataFrame, key: str) -> DataFrame:
    """key, three blur measures and the hash words p0..p3, d0..d3 of grey images (``width``, ``pixels``: rows end to end)."""
    kind = df.schema[key].dataType.simpleString()
    names = [f"{h}{i}" for h in HASHES for i in range(4)]

    def run(batches):
        for batch in batches:
            out = {n: [] for n in [*MEASURES, *names]}
            for w, px in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                grey = np.asarray(px.values, float).reshape(-1, w)
                for n, f in MEASURES.items():
                    out[n].append(f(grey))
                for h, f in HASHES.items():
                    for i, x in enumerate(f(grey)):
                        out[f"{h}{i}"].append(x)
            arrays = [pa.array(v, pa.float64() if n in MEASURES else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, *out])

    schema = f"{key} {kind}, " + ", ".join(f"{n} double" for n in MEASURES) + ", " + ", ".join(f"{n} long" for n in names)
    return df.select(key, "width", "pixels").mapInArrow(run, schema)
