"""Decoding of image files in Spark tasks.

BMP, PNG (8 bits, not interlaced) and PGM/PPM are read here with NumPy and zlib; other formats by OpenCV or Pillow where
one of them is installed on the workers. A file that cannot be read gives a row with an error and no pixels.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crops import as_bgr, limited


def _bmp(data: bytes) -> np.ndarray:
    start, _, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("BMP of another kind")
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    image = rows.reshape(abs(h), w, bits // 8)[..., :3]
    return image[::-1] if h > 0 else image


def _png(data: bytes) -> np.ndarray:
    at, body, w = 8, b"", 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            w, h, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour if w else -1)
    if channels is None or depth != 8 or woven:
        raise ValueError("PNG of another kind")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w * channels), np.uint8)
    for y in range(h):
        how, line, above = raw[y, 0], raw[y, 1:].copy(), out[y]
        if how == 1:
            line = np.add.accumulate(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line += above
        elif how in (3, 4):
            for x in range(len(line)):
                a, b = (int(line[x - channels]), int(above[x - channels])) if x >= channels else (0, 0)
                c = int(above[x])
                if how == 3:
                    guess = (a + c) // 2
                else:
                    guess = min((abs(c - b), 0, a), (abs(a - b), 1, c), (abs(a + c - 2 * b), 2, b))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y + 1] = line
    image = out[1:].reshape(h, w, channels)
    return image[..., :1] if channels <= 2 else image[..., [2, 1, 0]]


def _netpbm(data: bytes) -> np.ndarray:
    kind, w, h, top = re.match(rb"P([56])\s(?:#[^\n]*\n|\s)*(\d+)\s+(\d+)\s+(\d+)\s", data).groups()
    start = re.match(rb"P[56]\s(?:#[^\n]*\n|\s)*\d+\s+\d+\s+\d+\s", data).end()
    if int(top) != 255:
        raise ValueError("PNM of another depth")
    channels = 1 if kind == b"5" else 3
    image = np.frombuffer(data, np.uint8, int(w) * int(h) * channels, start).reshape(int(h), int(w), channels)
    return image[..., ::-1]


def _installed(data: bytes) -> np.ndarray:
    try:
        import cv2

        image = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
        if image is None:
            raise ValueError("unreadable image")
        return image
    except ImportError:
        pass
    try:
        from PIL import Image, ImageOps
    except ImportError:
        raise ValueError("no decoder for this format is installed") from None
    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))[..., ::-1]


def decode(data: bytes, most: int | None = None, grey: bool = False) -> np.ndarray:
    """BGR bytes, or grey values, with the largest side at most ``most``; ValueError where the data cannot be read."""
    try:
        own = _png if data[:8] == b"\x89PNG\r\n\x1a\n" else _bmp if data[:2] == b"BM" else _netpbm if data[:2] in (b"P5", b"P6") else _installed
        image = as_bgr(own(data))
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"unreadable image: {e}") from e
    if most:
        image = limited(image, most)
    return image @ np.array([0.114, 0.587, 0.299]) if grey else image


def grey_pixels(files: DataFrame, most: int, ignore_errors: bool = True) -> DataFrame:
    """path, width, height, pixels (grey, row after row), error, of rows with path and content. With ``ignore_errors``
    unreadable files are rows with an error; without, the first of them fails the query."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decode(data.as_buffer().to_pybytes() if data.is_valid else b"", most, grey=True)
                    out.append((image.shape[1], image.shape[0], image.ravel().tolist(), None))
                except ValueError as e:
                    if not ignore_errors:
                        raise ValueError(f"{path}: {e}") from e
                    out.append((None, None, None, str(e)))
            w, h, px, why = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(px, pa.list_(pa.float64())), pa.array(why, pa.string())], ["path", "width", "height", "pixels", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, pixels array<double>, error string")


def dropped(read: DataFrame, ignore_errors: bool = True) -> DataFrame:
    """Rows that were read. Rows with an error go silently, or fail the query without ``ignore_errors``."""
    if ignore_errors:
        return read.filter("error is null")
    fine = F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean"))
    return read.filter(fine)
