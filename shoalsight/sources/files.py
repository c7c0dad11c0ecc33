"""Photo files as DataFrames: recursive scans, extensions, dimensions from headers, capture times.

Listing uses Spark's ``binaryFile`` source, whose content column is pruned unless it is needed. It skips names that begin
with ``_`` or ``.``. Dimensions are read from the first bytes of PNG, GIF, BMP, WebP, TIFF and JPEG files and of RAW files
built on TIFF without decoding; the orientation of JPEG and TIFF files swaps them, and EXIF times come from the same block.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import exif_seconds, extension, normalize_extensions, resolve_extensions

# Fixed values.
RASTER = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
RAW = (".arw", ".cr2", ".cr3", ".dng", ".erf", ".kdc", ".mrw", ".nef", ".nrw", ".orf", ".pef", ".raf", ".rw2", ".sr2", ".srw")


def supported_extensions(raw: bool = False) -> tuple[str, ...]:
    return RASTER + RAW if raw else RASTER


def find_files(spark: SparkSession, folder: str, selected: list[str] | None = None, orientation: str | None = None, raw: bool = False) -> DataFrame:
    """path, file_size, mtime, extension of the supported files under ``folder``; with ``orientation`` (landscape or
    portrait) also width and height, and unreadable files are left out."""
    allowed = F.array(*map(F.lit, supported_extensions(raw)))
    chosen = F.lit(None).cast("array<string>") if selected is None else normalize_extensions(F.array(*map(F.lit, selected)).cast("array<string>"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("extension", extension(F.col("path"))).filter(F.array_contains(resolve_extensions(allowed, chosen), F.col("extension")))
    named = [F.col("path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), F.col("extension")]
    if orientation is None:
        return files.select(*named)
    return with_dimensions(files.select(*named, "content")).filter(matches_orientation(F.col("width"), F.col("height"), orientation))


def discover_extensions(files: DataFrame, path: str = "path", raw: bool = False) -> DataFrame:
    return files.select(extension(F.col(path)).alias("extension")).filter(F.col("extension").isin(*supported_extensions(raw))).distinct().orderBy("extension")


def matches_orientation(width: Column, height: Column, orientation: str | None) -> Column:
    """Squares and unknown dimensions match no orientation."""
    if orientation is None:
        return F.lit(True)
    return F.coalesce(width > height if orientation == "landscape" else height > width, F.lit(False))


def _jpeg(data: bytes) -> tuple[int | None, int | None, int, str | None]:
    """Width, height, orientation and capture time of a JPEG file."""
    at, size, turned, time = 2, (None, None), 1, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            turned, time = _exif(body[6:])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", body[1:5])
            size = (w, h)
            break
        at += 2 + length
    return *size, turned, time


def _exif(tiff: bytes) -> tuple[int, str | None]:
    """Orientation (274) and the first of the times 36867, 36868, 306, sub-directories included."""
    found = _tags(tiff)
    time = next((found[t] for t in (36867, 36868, 306) if isinstance(found.get(t), str) and found[t].strip()), None)
    return (found.get(274) if isinstance(found.get(274), int) else 1), time


def _tags(tiff: bytes) -> dict[int, object]:
    """Numbers and texts of a TIFF block, of its first directory and the EXIF directory in it."""
    order = "<" if tiff[:2] == b"II" else ">"
    found: dict[int, object] = {}

    def directory(at: int, depth: int) -> None:
        if depth > 2 or at + 2 > len(tiff):
            return
        for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                return
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            value = struct.unpack(order + "I", entry[8:])[0]
            if kind == 4:
                found.setdefault(tag, value)
            elif kind == 3:
                found[tag] = struct.unpack(order + "H", entry[8:10])[0]
            elif kind == 2:
                found[tag] = (entry[8 : 8 + n] if n <= 4 else tiff[value : value + n]).split(b"\0")[0].decode("utf-8", "ignore")
            if tag == 0x8769:
                directory(value, depth + 1)

    try:
        directory(struct.unpack(order + "I", tiff[4:8])[0], 0)
    except struct.error:
        pass
    return found


def header(data: bytes) -> tuple[int | None, int | None, str | None]:
    """Width and height as shown, and the EXIF time text; nulls where the file cannot be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return *struct.unpack(">II", data[16:24]), None
        if data[:3] == b"GIF":
            return *struct.unpack("<HH", data[6:10]), None
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h), None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), None
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF, None
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None
        if data[:4] in (b"II*\0", b"MM\0*"):  # TIFF, and the RAW formats built on it
            found = _tags(data)
            turned, time = _exif(data)
            w, h = (x if isinstance(x := found.get(t), int) and x else None for t in (256, 257))
            return (h, w, time) if turned in (5, 6, 7, 8) else (w, h, time)
        if data[:2] == b"\xff\xd8":
            w, h, turned, time = _jpeg(data)
            return (h, w, time) if turned in (5, 6, 7, 8) else (w, h, time)
    except (struct.error, IndexError):
        pass
    return None, None, None


def with_dimensions(files: DataFrame) -> DataFrame:
    """Replaces ``content`` by width, height and exif_time; unreadable files get nulls."""
    rest = [c for c in files.columns if c != "content"]

    def read(batches):
        for batch in batches:
            found = [header(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("content")]
            w, h, t = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array(t, pa.string())], [*rest, "width", "height", "exif_time"])

    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in rest)
    return files.select(*rest, "content").mapInArrow(read, f"{kinds}, width long, height long, exif_time string")


def capture_time(exif_text: Column, mtime_seconds: Column) -> dict[str, Column]:
    """ts (UTC seconds) from EXIF, else from the file, and where it came from."""
    t = exif_seconds(exif_text)
    return {"ts": F.coalesce(t, mtime_seconds), "source": F.when(t.isNotNull(), "exif").otherwise("filesystem")}


def split_errors(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, one error row for each unreadable file); a scan goes on past broken files."""
    bad = F.col("width").isNull()
    return read.filter(~bad), read.filter(bad).select("path", F.lit("unreadable image").alias("error"))
