"""Cutting and warping of decoded images (arrays of height x width x channels, BGR) in NumPy.

Everything that moves pixels is one bilinear sampler over coordinate grids, so a rotated or scaled cut is taken from the
original at once, without an image in between. Pixel centres lie on whole coordinates.
"""

from __future__ import annotations

import numpy as np

from .images import shrink, similarity_transform

# Where the five points of a face lie in an aligned face of 112 x 112.
FACE_POINTS = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def as_bgr(image: np.ndarray) -> np.ndarray:
    """Three byte channels of a grey, BGR or BGRA image; other numbers are rounded and cut to 0..255."""
    if image is None or image.ndim not in (2, 3) or not image.size or (image.ndim == 3 and image.shape[2] not in (1, 3, 4)):
        raise ValueError("not an image")
    planes = image[..., None] if image.ndim == 2 else image
    planes = np.repeat(planes, 3, axis=2) if planes.shape[2] == 1 else planes[..., :3]
    return planes if planes.dtype == np.uint8 else np.clip(np.rint(np.nan_to_num(planes)), 0, 255).astype(np.uint8)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, edge: bool = False) -> np.ndarray:
    """Values at (x, y), bilinear; beyond the borders 0, or the nearest pixel with ``edge``."""
    h, w = image.shape[:2]
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros((*x.shape, *image.shape[2:]))
    for dx in (0, 1):
        for dy in (0, 1):
            i, j = top + dy, left + dx
            share = (1 - np.abs(x - j)) * (1 - np.abs(y - i))
            if not edge:
                share = np.where((i >= 0) & (i < h) & (j >= 0) & (j < w), share, 0)
            out += image[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)] * share.reshape(*x.shape, *[1] * (image.ndim - 2))
    return out


def warp(image: np.ndarray, matrix: np.ndarray, width: int, height: int, edge: bool = False) -> np.ndarray:
    """The image under a 2 x 3 matrix that takes its coordinates to those of the result."""
    back = np.linalg.inv(matrix[:, :2])
    y, x = np.mgrid[:height, :width].astype(float)
    x, y = x - matrix[0, 2], y - matrix[1, 2]
    return sample(image, back[0, 0] * x + back[0, 1] * y, back[1, 0] * x + back[1, 1] * y, edge)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = np.mgrid[:height, :width]
    return sample(image, (x + 0.5) * w / width - 0.5, (y + 0.5) * h / height - 0.5, edge=True)


def limited(image: np.ndarray, most: int) -> np.ndarray:
    """Area means of the image with its largest side cut down to ``most``; smaller images are left alone."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    size = max(1, round(h * most / max(h, w))), max(1, round(w * most / max(h, w)))
    return shrink(image, *size) if image.ndim == 2 else np.stack([shrink(image[..., k], *size) for k in range(image.shape[2])], axis=-1)


def letterbox(image: np.ndarray, width: int, height: int) -> tuple[np.ndarray, float]:
    """The image scaled to fit at the top left of a black canvas, and the scale."""
    h, w = image.shape[:2]
    inner = (width, max(1, int(width * h / w))) if h * width <= height * w else (max(1, int(height * w / h)), height)
    out = np.zeros((height, width, *image.shape[2:]))
    out[: inner[1], : inner[0]] = resize(image, *inner)
    return out, inner[1] / h


def encoder_input(bgr: np.ndarray, side: int, mean, spread) -> np.ndarray:
    """Channels x side x side of RGB: the shorter side fitted, the middle cut out, scaled by channel means and spreads."""
    h, w = bgr.shape[:2]
    fit = side / min(h, w)
    big = resize(bgr, max(side, round(w * fit)), max(side, round(h * fit)))
    top, left = (big.shape[0] - side) // 2, (big.shape[1] - side) // 2
    rgb = big[top : top + side, left : left + side, ::-1] / 255
    return np.moveaxis((rgb - np.asarray(mean)) / np.asarray(spread), 2, 0).astype(np.float32)


def face_points(points) -> np.ndarray | None:
    """Five finite points whose eyes are at least 2 pixels apart, else None."""
    flat = np.asarray([] if points is None else points, float).ravel()
    if len(flat) < 10 or not np.isfinite(flat[:10]).all():
        return None
    found = flat[:10].reshape(5, 2)
    return found if np.hypot(*(found[1] - found[0])) >= 2 else None


def aligned_face(image: np.ndarray, points) -> np.ndarray:
    """112 x 112, the five points moved near FACE_POINTS by least squares."""
    found = face_points(points)
    if found is None:
        raise ValueError("five points are needed")
    return warp(image, similarity_transform(found, FACE_POINTS), 112, 112)


def square_crop(image: np.ndarray, box: tuple[int, int, int, int], grown: float = 1.0) -> np.ndarray:
    """The square around a box (x, y, w, h), its border pixels repeated beyond the image; empty where it lies outside."""
    x, y, w, h = box
    half = max(w, h) * max(1.0, grown) / 2
    across = np.arange(np.floor(x + w / 2 - half), np.ceil(x + w / 2 + half)).astype(int)
    down = np.arange(np.floor(y + h / 2 - half), np.ceil(y + h / 2 + half)).astype(int)
    inside = lambda at, n: len(at) and at[0] < n and at[-1] >= 0
    if w <= 0 or h <= 0 or not inside(across, image.shape[1]) or not inside(down, image.shape[0]):
        return image[:0, :0]
    return image[np.clip(down, 0, image.shape[0] - 1)][:, np.clip(across, 0, image.shape[1] - 1)]


def eye_crops(image: np.ndarray, points, wide: float, high: float) -> list[np.ndarray] | None:
    """Cuts around the two eyes, level with the line between them, ``wide`` x ``high`` eye distances in size; None where the
    points are not valid or the eyes under 8 pixels apart."""
    found = face_points(points)
    if found is None:
        return None
    line = found[1] - found[0]
    apart = float(np.hypot(*line))
    if apart < 8:
        return None
    w, h = max(12, round(apart * wide)), max(8, round(apart * high))
    along, across = line / apart, np.array([-line[1], line[0]]) / apart
    v, u = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    return [sample(image, x + u * along[0] + v * across[0], y + u * along[1] + v * across[1], edge=True) for x, y in found[:2]]


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred along both axes; borders are mirrored without repeating the edge."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-reach, n + reach)) % max(2 * n - 2, 1)
        at = np.where(at >= n, 2 * n - 2 - at, at)
        total = 0.0
        for k, weight in enumerate(weights):
            total = total + weight * np.take(out, at[k : k + n], axis=axis)
        out = total
    return out


def blur_faces(image: np.ndarray, boxes, width: int | None = None, height: int | None = None, sigma: float = 21.0) -> np.ndarray:
    """Face boxes (x, y, w, h, in an image of ``width`` x ``height``) and a quarter of their size around them are blurred."""
    h, w = image.shape[:2]
    sx, sy = w / max(width or w, 1), h / max(height or h, 1)
    out, soft = image.astype(float), None
    for x, y, bw, bh in boxes:
        a, b = max(0, round(x * sx)), min(w, round((x + bw) * sx))
        c, d = max(0, round(y * sy)), min(h, round((y + bh) * sy))
        if a >= b or c >= d:
            continue
        px, py = max(1, (b - a) // 4), max(1, (d - c) // 4)
        cut = np.s_[max(0, c - py) : min(h, d + py), max(0, a - px) : min(w, b + px)]
        soft = gaussian(image, sigma) if soft is None else soft
        out[cut] = soft[cut]
    return out


def subject_crop(image: np.ndarray, box=None) -> np.ndarray:
    """The part in ``box`` (left, top, right, bottom as shares); the middle three fifths without one."""
    h, w = image.shape[:2]
    if box is None or len(box) != 4:
        return image[int(h * 0.2) : int(h * 0.8), int(w * 0.2) : int(w * 0.8)] if int(h * 0.2) < int(h * 0.8) and int(w * 0.2) < int(w * 0.8) else image
    a, c = min(max(round(box[0] * w), 0), w - 1), min(max(round(box[1] * h), 0), h - 1)
    return image[c : max(c + 1, min(h, round(box[3] * h))), a : max(a + 1, min(w, round(box[2] * w)))]


def oval_mask(height: int, width: int) -> np.ndarray:
    """Whether each pixel lies in the ellipse that fills the box."""
    y, x = np.mgrid[:height, :width]
    return ((x - (width - 1) / 2) / (width / 2)) ** 2 + ((y - (height - 1) / 2) / (height / 2)) ** 2 <= 1
