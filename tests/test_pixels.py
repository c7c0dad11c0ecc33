"""Decoding, cutting and warping against plain loops."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalsight.functions import crops, images
from shoalsight.operators import results
from shoalsight.plans import people, scans
from shoalsight.scene_config import PRESETS, SceneConfig, preset
from shoalsight.sources import decode, files


def picture(h=20, w=31, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def bmp(image):
    h, w = image.shape[:2]
    rows = b"".join(r.tobytes() + b"\0" * (-3 * w % 4) for r in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def png(image, filters=(0, 1, 2, 3, 4)):
    """Each line with another filter, computed pixel by pixel."""
    h, w, c = image.shape
    rgb = image[..., ::-1] if c == 3 else image
    raw = b""
    for y in range(h):
        how, line = filters[y % len(filters)], rgb[y].ravel().astype(int)
        up = rgb[y - 1].ravel().astype(int) if y else np.zeros(w * c, int)
        out = []
        for x in range(w * c):
            a, b = (line[x - c], up[x - c]) if x >= c else (0, 0)
            p = a + up[x] - b
            paeth = a if abs(p - a) <= abs(p - up[x]) and abs(p - a) <= abs(p - b) else up[x] if abs(p - up[x]) <= abs(p - b) else b
            out.append((line[x] - (0, a, up[x], (a + up[x]) // 2, paeth)[how]) % 256)
        raw += bytes([how, *out])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", body[:40]) + chunk(b"IDAT", body[40:]) + chunk(b"IEND", b"")


def tiff(w, h, turned=1, order="<"):
    tags = [(256, 4, w), (257, 4, h), (274, 3, turned)]
    mark = b"II*\0" if order == "<" else b"MM\0*"
    entry = lambda t, k, v: struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0))
    return mark + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags)) + b"".join(entry(*t) for t in tags) + b"\0" * 4


def test_decoders():
    image = picture()
    assert (decode.decode(bmp(image)) == image).all() and (decode.decode(png(image)) == image).all()
    grey = picture()[..., :1]
    assert (decode.decode(png(grey)) == grey).all() and (decode.decode(b"P5\n# x\n31 20\n255\n" + grey.tobytes()) == grey).all()
    assert (decode.decode(b"P6 31 20 255\n" + image[..., ::-1].tobytes()) == image).all()
    small = decode.decode(bmp(picture(40, 20)), most=10)
    assert small.shape == (10, 5, 3) and np.allclose(small[0, 0], picture(40, 20)[:4, :4].mean(axis=(0, 1)))
    assert decode.decode(bmp(image), most=31).shape == image.shape
    for bad in (b"", b"text", b"BM", png(image)[:60], b"\x89PNG\r\n\x1a\n", bmp(image)[:80]):
        with pytest.raises(ValueError):
            decode.decode(bad)


def test_header_of_tiff():
    assert files.header(tiff(30, 20)) == (30, 20, None) and files.header(tiff(30, 20, 6, ">")) == (20, 30, None)
    assert files.header(b"II*\0")[0] is None


def plain_sample(image, x, y, edge):
    h, w = image.shape[:2]

    def pixel(i, j):
        if edge:
            return image[min(max(i, 0), h - 1), min(max(j, 0), w - 1)].astype(float)
        return image[i, j].astype(float) if 0 <= i < h and 0 <= j < w else np.zeros(image.shape[2])

    i, j = int(np.floor(y)), int(np.floor(x))
    a, b = y - i, x - j
    return (1 - a) * ((1 - b) * pixel(i, j) + b * pixel(i, j + 1)) + a * ((1 - b) * pixel(i + 1, j) + b * pixel(i + 1, j + 1))


@pytest.mark.parametrize("edge", [False, True])
def test_sampling_and_warping(edge):
    rng, image = np.random.default_rng(1), picture()
    x, y = rng.uniform(-3, 34, 60), rng.uniform(-3, 23, 60)
    np.testing.assert_allclose(crops.sample(image, x, y, edge), [plain_sample(image, a, b, edge) for a, b in zip(x, y)])
    m = np.array([[0.8, -0.6, 9.0], [0.6, 0.8, -4.0]])
    out = crops.warp(image, m, 12, 9, edge)
    for v in range(9):
        for u in range(12):
            s = np.linalg.solve(m[:, :2], [u - 9.0, v + 4.0])
            np.testing.assert_allclose(out[v, u], plain_sample(image, *s, edge), atol=1e-9)


def test_letterbox_and_encoder_input():
    image = picture(20, 40)
    out, scale = crops.letterbox(image, 20, 20)
    assert out.shape == (20, 20, 3) and scale == 0.5 and not out[10:].any() and np.allclose(out[:10], crops.resize(image, 20, 10))
    out, scale = crops.letterbox(picture(40, 20), 32, 20)
    assert scale == 0.5 and not out[:, 10:].any()
    flat = np.full((30, 50, 3), 255, np.uint8)
    x = crops.encoder_input(flat, 16, (0.5, 0.4, 0.3), (0.1, 0.2, 0.3))
    assert x.shape == (3, 16, 16) and np.allclose(x[:, 0, 0], [5, 3, 7 / 3])
    big = np.zeros((16, 48, 3), np.uint8)
    big[:, 16:32, 2] = 255
    assert np.allclose(crops.encoder_input(big, 16, (0, 0, 0), (1, 1, 1))[0], 1)


def test_face_cuts():
    image = picture(120, 160, 3)
    points = crops.FACE_POINTS + [20.0, 5.0]
    np.testing.assert_allclose(crops.aligned_face(image, points), image[5:117, 20:132], atol=1e-6)
    for bad in (None, [1, 2], np.full((5, 2), np.nan), np.zeros((5, 2))):
        assert crops.face_points(bad) is None and crops.eye_crops(image, bad, 0.5, 0.4) is None
    with pytest.raises(ValueError):
        crops.aligned_face(image, None)
    level = np.array([[40, 50], [80, 50], [60, 60], [45, 75], [75, 75]], float)
    left, right = crops.eye_crops(image, level, 0.525, 0.375)  # 21 x 15
    np.testing.assert_allclose(left, image[43:58, 30:51])
    np.testing.assert_allclose(right, image[43:58, 70:91])
    turned = np.array([[60, 30], [60, 70], [50, 50], [40, 40], [40, 60]], float)
    left, _ = crops.eye_crops(image, turned, 0.525, 0.375)
    np.testing.assert_allclose(left, np.rot90(image[20:41, 53:68]), atol=1e-9)
    assert crops.eye_crops(image, level * 0.1, 0.5, 0.4) is None
    assert (crops.square_crop(image, (10, 20, 30, 10)) == image[10:40, 10:40]).all()
    out = crops.square_crop(image, (-5, -5, 10, 10))
    assert out.shape == (10, 10, 3) and (out[:5, :5] == image[0, 0]).all() and (out[5:, 5:] == image[:5, :5]).all()
    assert not crops.square_crop(image, (500, 0, 10, 10)).size and not crops.square_crop(image, (5, 5, 0, 3)).size


def test_blurred_faces_and_subject():
    image = picture(60, 80, 4)
    out = crops.blur_faces(image, [(20, 20, 8, 8), (70, 50, 0, 5)], 160, 120, sigma=2.0)
    soft = crops.gaussian(image, 2.0)
    assert (out[9:15, 9:15] == soft[9:15, 9:15]).all() and (out[:9] == image[:9]).all() and (out[:, 15:] == image[:, 15:]).all()
    k = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    k /= k.sum()
    want = sum(k[i] * k[j] * image[30 + i - 6, 40 + j - 6].astype(float) for i in range(13) for j in range(13))
    np.testing.assert_allclose(soft[30, 40], want)
    assert (crops.blur_faces(image, []) == image).all()
    assert (crops.subject_crop(image) == image[12:48, 16:64]).all() and (crops.subject_crop(image, (0.25, 0.5, 0.5, 1.0)) == image[30:, 20:40]).all()
    assert crops.subject_crop(image, (2.0, 2.0, 3.0, 3.0)).shape == (1, 1, 3)
    mask = crops.oval_mask(9, 13)
    assert mask[4].all() and not mask[0, 0] and (mask == mask[::-1, ::-1]).all()


def test_coercion():
    assert crops.as_bgr(np.array([[1, 2]], np.uint8)).tolist() == [[[1, 1, 1], [2, 2, 2]]]
    assert crops.as_bgr(np.array([[[300.0, -4, np.nan, 9]]])).tolist() == [[[255, 0, 0]]]
    for bad in (None, np.zeros(3), np.zeros((2, 2, 2)), np.zeros((0, 3, 3))):
        with pytest.raises(ValueError):
            crops.as_bgr(bad)


def test_scan_of_files(spark, tmp_path):
    """Sharp, blurred and broken files; extensions are chosen without regard to case or dots."""
    sharp = picture(64, 64, 5)
    soft = np.clip(crops.gaussian(np.full((64, 64, 3), 90.0), 3.0), 0, 255).astype(np.uint8)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "sharp.png").write_bytes(png(sharp))
    (tmp_path / "soft.BMP").write_bytes(bmp(soft))
    (tmp_path / "broken.png").write_bytes(b"text")
    (tmp_path / "notes.txt").write_text("x")
    found, errors = scans.blur_scan(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["soft.BMP"] and [r["path"].rsplit("/", 1)[1] for r in errors.collect()] == ["broken.png"]
    with pytest.raises(Exception, match="broken.png"):
        scans.blur_scan(spark, str(tmp_path), ignore_errors=False)
    names = lambda **k: sorted(r["path"].rsplit("/", 1)[1] for r in files.find_files(spark, str(tmp_path), **k).collect())
    assert names(selected=["PNG"]) == ["broken.png", "sharp.png"] and names(selected=[" .Bmp "]) == ["soft.BMP"] and len(names(selected=["gif"])) == 3
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "path string, error string")
    assert decode.dropped(rows).count() == 1
    with pytest.raises(Exception, match="b: bad"):
        decode.dropped(rows, ignore_errors=False).collect()
    assert scans.fingerprint(str(tmp_path / "notes.txt"), 1) == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_measures_against_loops():
    """The blur measures and hashes of a small image, pixel by pixel."""
    g = picture(24, 20, 6)[..., 0].astype(float)
    at = lambda y, x: g[abs(y) if y < 24 else 46 - y, abs(x) if x < 20 else 38 - x]
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(24) for x in range(20)]
    assert np.isclose(images.laplacian_variance(g), np.var(lap))
    total = 0.0
    for y in range(24):
        for x in range(20):
            gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            total += np.hypot(gx, gy)
    assert np.isclose(images.sobel_mean(g), total / 480)
    assert np.isclose(images.tile_contrast(g, 4), np.mean([g[6 * i : 6 * i + 6, 5 * j : 5 * j + 5].std() for i in range(4) for j in range(4)]))
    small = images.shrink(g, 4, 5)
    assert np.allclose(small, [[g[6 * i : 6 * i + 6, 4 * j : 4 * j + 4].mean() for j in range(5)] for i in range(4)])
    bits = "".join("1" if small[i, j + 1] > small[i, j] else "0" for i in range(4) for j in range(4))
    assert images._words(np.array([int(b) for b in bits.ljust(64, "0")]))[0] & ((1 << 64) - 1) == int(bits.ljust(64, "0"), 2)
    n = 8
    wide = images.shrink(g, n, n)
    dct = [[sum(wide[y, x] * np.cos(np.pi * (2 * y + 1) * u / (2 * n)) * np.cos(np.pi * (2 * x + 1) * v / (2 * n)) for y in range(n) for x in range(n)) for v in range(8)] for u in range(8)]
    want = "".join("1" if v > np.median(dct) else "0" for row in dct for v in row)
    assert images.perceptual_hash(g, 8, 1)[0] & ((1 << 64) - 1) == int(want, 2)


def test_export_names_and_order(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    for k in "xy":
        (tmp_path / k / "p.jpg").write_text(k)
    rows = [(f"{tmp_path}/x/p.jpg",), (f"file:{tmp_path}/y/p.jpg",), (f"{tmp_path}/z/gone.jpg",)]
    plan = results.export_names(spark.createDataFrame(rows, "path string"))
    out = tmp_path / "out"
    got = {r["target"]: r["error"] for r in results.copy_files(plan, str(out)).collect()}
    assert sorted(p.name for p in out.iterdir()) == ["p.jpg", "p_1.jpg"] and {t for t, e in got.items() if e} == {"gone.jpg"}
    assert all(r["error"] for r in results.copy_files(plan, str(out), link=True).collect())
    names = spark.createDataFrame([("bob",), ("Ann",), ("carl",)], "name string")
    assert [r[0] for r in results.moved_first(names, "name", "carl").collect()] == ["carl", "Ann", "bob"]
    assert [r[0] for r in results.moved_first(names, "name", None).collect()] == ["Ann", "bob", "carl"]
    c = spark.createDataFrame([(0, 1, 5), (1, 3, 7), (1, 3, 7), (2, 3, 9)], "cluster long, cluster_size long, representative long")
    assert [r["cluster"] for r in people.by_size(c).collect()] == [1, 2, 0]


@pytest.mark.parametrize(
    "change",
    [{"semantic_soft_boundary_threshold": 0.5}, {"composition_soft_boundary_threshold": 0.8}, {"minimum_action_margin": 0.1}, {"minimum_shot_margin": 0.1}, {"action_conflict_penalty": 0.4}, {"participant_mode_weak_penalty": 0.2},
     {"main_vs_reaction_supported_penalty": 0.2}, {"maximum_adjacent_gap_within_scene_seconds": 700}, {"scene_neighbor_count": 0}, {"session_gap_seconds": 0}, {"tiny_segment_max_size": -1}, {"boundary_context_window": 0}],
)
def test_configurations_are_checked(change):
    with pytest.raises(ValueError, match="out of range"):
        SceneConfig(**change)
    assert SceneConfig(allowed_internal_outliers=0, tiny_segment_max_size=0) and all(preset(p) for p in PRESETS)
