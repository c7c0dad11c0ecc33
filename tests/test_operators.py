import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shoalsight.functions import faces, images, scalars, vectors
from shoalsight.operators import groups, hamming, incremental, results, timeline, vector_join
from shoalsight.operators.components import connected_components
from shoalsight.plans import materialize
from shoalsight.plans.duplicates import candidate_pairs, duplicate_groups
from shoalsight.plans.people import face_clusters, name_clusters, recognise
from shoalsight.scene_config import DuplicateConfig, FaceConfig
from shoalsight.sources import files
from shoalsight.streaming.ingest import ingest, windowed_counts


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def plain_components(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)] + [(400, 401 + i) for i in range(30)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == plain_components(pairs)


def test_components_empty_and_limit(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long"), max_rounds=1)


def test_band_join_is_exact(spark):
    rng = random.Random(2)
    flip = lambda h, n: h ^ sum(1 << k for k in rng.sample(range(256), n))
    base = [rng.getrandbits(256) for _ in range(30)]
    hashes = base + [flip(rng.choice(base), rng.randint(0, 24)) for _ in range(90)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(h >> (64 * (3 - k)) & (2**64 - 1)) for k in range(4)]) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, p0 long, p1 long, p2 long, p3 long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(i, j, bin(a ^ b).count("1")) for a, i in first.items() for b, j in first.items() if i < j and bin(a ^ b).count("1") <= 18}
    got = {tuple(r) for r in hamming.hamming_pairs(df, "id", ["p0", "p1", "p2", "p3"], 18).collect()}
    assert got == want
    text = f"{hashes[0]:064x}"
    r = one(spark, **{f"w{k}": c for k, c in enumerate(scalars.hash_words(F.lit(text)))}, back=scalars.hash_hex(scalars.hash_words(F.lit(text))))
    assert [r[f"w{k}"] for k in range(4)] == list(rows[0][1:]) and r["back"] == text


def test_duplicates(spark):
    rows = [(1, "/a/x.jpg", 10, 10, 5, 5), (2, "/b/y.jpg", 20, 10, 5, 5), (3, "/c/z.jpg", 5, 5, 4, 5), (4, "/d/w.jpg", 9, 9, -1, 0), (5, "/e/y.jpg", 20, 10, 5, 5)]
    df = spark.createDataFrame(rows, "id long, path string, width int, height int, p0 long, d0 long")
    pairs = candidate_pairs(df, "id", ["p0"], ["d0"], DuplicateConfig(4, 4))
    got = {r["id"]: (r["component"], r["is_best"]) for r in duplicate_groups(df, "id", pairs).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (1, False), 5: (1, False)}
    assert duplicate_groups(df, "id", pairs, verify=lambda p: F.lit(False)).collect() == []
    with pytest.raises(ValueError):
        DuplicateConfig(65)


def vector_rows(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[50:80] = v[0] + 0.2 * rng.normal(size=(30, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("block,pivots", [(2048, 128), (20, 4), (7, 1)])
def test_threshold_pairs(spark, block, pivots):
    v, df = vector_rows(spark, 700)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.8, 1))
    assert {(r["l"], r["r"]) for r in vector_join.threshold_pairs(df, "id", "v", 0.8, block, pivots).collect()} == set(zip(i.tolist(), j.tolist()))
    assert vector_join.threshold_pairs(df.limit(0), "id", "v", 0.8).collect() == []


def test_nearest_and_split(spark):
    v, df = vector_rows(spark)
    rows, refs = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    r = np.arange(0, 300, 3)
    for block in (4096, 7):
        got = {x["id"]: (x["ref"], x["score"]) for x in vector_join.nearest(rows, "id", "v", refs, "id", "v", ref_block=block).collect()}
        for i, (ref, score) in got.items():
            s = v[i] @ v[r].T
            assert ref == r[s.argmax()] and abs(score - s.max()) < 1e-12
    none = vector_join.nearest(rows, "id", "v", refs.limit(0), "id", "v")
    known, unknown = vector_join.split_known(rows, none, "id", 0.5)
    assert known.count() == 0 and unknown.count() == 200
    known, unknown = recognise(rows, "id", "v", refs.withColumn("person", F.when(F.col("id") != 51, F.col("id"))), "id", "v", "person", FaceConfig(0.9))
    assert all(r["score"] >= 0.9 and r["person"] is not None for r in known.collect())


def test_face_clusters(spark):
    v, df = vector_rows(spark)
    rows = face_clusters(df, "id", "v", 0.85).collect()
    i, j = np.nonzero(np.triu(v @ v.T >= 0.85, 1))
    want = plain_components(list(zip(i.tolist(), j.tolist())) + [(k, k) for k in range(300)])
    assert {r["id"]: r["component"] for r in rows} == want
    for c in set(want.values()):
        m = [k for k in want if want[k] == c]
        s = np.round((v[m] @ v[m].T).sum(axis=1), 9)
        assert {r["representative"] for r in rows if r["component"] == c} == {m[int(s.argmax())] if len(m) > 1 else c}
    order = sorted(set(want.values()))
    assert all(r["cluster"] == order.index(r["component"]) for r in rows)
    # Attaching by weaker edges after the components changes nothing: all strong neighbours share the component.
    assert all(want[a] == want[b] for a, b in zip(i.tolist(), j.tolist()))
    known = spark.createDataFrame([("ann", "p1")], "person string, path string")
    named = name_clusters(spark.createDataFrame([(0, "p1"), (0, "p2"), (1, "p3")], "cluster int, path string"), spark.createDataFrame([(0, "ann")], "cluster int, person string"), known)
    assert sorted(tuple(r) for r in named.collect()) == [("ann", "p1"), ("ann", "p2")]


def test_neighbours_across_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.0, 5.0, 40000.0, 90000.0, 1e6]) + rng.randint(0, 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts double, id long")
    got = {r["id"]: r for r in timeline.with_neighbours(df, ["k"], "ts", "id", F.col("id"), before=2, after=3, bucket=7.0).collect()}
    count = {r["id"]: r["c"] for r in timeline.running_count(df, ["k"], "ts", "id", F.col("id") % 2 == 0, "c", bucket=7.0).collect()}
    for k in "ab":
        order = [i for _, _, i in sorted(r for r in rows if r[0] == k)]
        for n, i in enumerate(order):
            at = lambda m: order[m] if 0 <= m < len(order) else None
            assert [got[i][f"_before_{s}"] for s in (1, 2)] == [at(n - 1), at(n - 2)]
            assert [got[i][f"_after_{s}"] for s in (1, 2, 3)] == [at(n + 1), at(n + 2), at(n + 3)]
            assert count[i] == sum(x % 2 == 0 for x in order[: n + 1])


def test_sessions(spark):
    ts = [0, 100, 2000, 9300, 86390, 86500, 88301]
    df = spark.createDataFrame([("a", float(t), i, i // 3) for i, t in enumerate(ts)], "album string, ts double, id long, tag int")
    plain = {r["id"]: r["session"] for r in timeline.sessionize(df, ["album"], "ts", "id").collect()}
    assert [plain[i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4]
    alike = timeline.sessionize(df, ["album"], "ts", "id", alike=F.col("_before_1.v") == F.col("tag"), value=F.col("tag"))
    assert [r["session"] for r in alike.orderBy("id").collect()] == [0, 0, 0, 1, 2, 2, 3]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("array<double>")
    r = one(
        spark, unit=vectors.l2_normalize(v(3.0, 4.0)), zero=vectors.l2_normalize(v(0.0, 0.0)), opt=vectors.optional_cosine(v(1.0), none), shape=vectors.optional_cosine(v(1.0), v(1.0, 0.0)), clip=vectors.optional_cosine(v(-1.0), v(1.0)),
        same=vectors.centered_similarity(v(1.0, 2.0), v(2.0, 4.0)), flat=vectors.centered_similarity(v(1.0, 1.0), v(1.0, 2.0)), null=vectors.clip01(F.lit(None).cast("double")),
    )
    assert r["unit"] == [0.6, 0.8] and r["zero"] == [0.0, 0.0] and (r["opt"], r["shape"], r["clip"]) == (0.5, 0.5, 0.0)
    assert abs(r["same"] - 1.0) < 1e-12 and r["flat"] == 0.5 and r["null"] is None


def test_scalars(spark):
    r = one(
        spark, a=scalars.safe_name(F.lit(' A/b: "c" (3 photos)')), b=scalars.safe_name(F.lit(" . ")), c=scalars.elapsed(F.lit(3725)), d=scalars.elapsed(F.lit(65)), e=scalars.exif_seconds(F.lit("1970:01:02 00:00:01")), f=scalars.exif_seconds(F.lit("nope")),
        g=scalars.people_label(F.array(*map(F.lit, "abcd"))), h=scalars.minute_text(F.lit(0.0)), i=scalars.extension(F.lit("/x/.hidden")), j=scalars.extension(F.lit("/x/a.b.JPG")), k=scalars.nearest_rank(F.array(*map(F.lit, range(11))), 0.75),
        l=scalars.resolve_extensions(F.array(F.lit(".a")), F.array(F.lit(".b"))), m=scalars.stem(F.lit("/x/a.b.JPG")),
    )
    assert tuple(r) == ("A_b_ _c_", "Unnamed", "01:02:05", "01:05", 86401.0, None, "a & b +2", "1970-01-01 00:00 UTC", "", ".jpg", 8, [".a"], "a.b")


def test_faces(spark):
    box = lambda *b: F.struct(*[F.lit(x).alias(k) for k, x in zip("xywh", map(float, b))])
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    r = one(
        spark, empty=faces.subject_box(none, F.lit(100), F.lit(100)), thin=faces.subject_box(F.array(box(50, 50, 1, 1)), F.lit(100), F.lit(100)), layout=faces.face_layout(none, F.lit(10), F.lit(10), F.lit(0)),
        one=faces.participant_mode(F.lit(1), F.lit(0)), quirk=faces.participant_mode(F.lit(1), F.lit(0), fixed=False), cwm=faces.confidence_weighted_mean([(F.lit(0.5), 1.0, F.lit(1.0)), (F.lit(float("nan")), 9.0, F.lit(1.0)), (F.lit(None).cast("double"), 1.0, F.lit(1.0))], 0.2),
        fallback=faces.confidence_weighted_mean([], 0.2), soft=faces.softmax(F.array(F.lit(1.0), F.lit(1.0))), blend=faces.blended(F.lit(None).cast("double"), F.lit(1.0), 0.5),
    )
    assert r["empty"] == [0.2, 0.2, 0.8, 0.8] and [round(x, 4) for x in r["thin"]] == [0.355, 0.355, 0.655, 0.655] and r["layout"] is None
    assert (r["one"], r["quirk"], r["cwm"], r["fallback"], r["soft"], r["blend"]) == ("solo", "small_group", 0.5, 0.2, [0.5, 0.5], 0.5)


def test_images():
    grey = np.full((80, 80), 127.0)
    assert images.laplacian_variance(grey) == images.sobel_mean(grey) == images.tile_contrast(grey) == 0.0
    board = np.indices((64, 64)).sum(axis=0) % 2 * 255.0
    assert images.laplacian_variance(board) > 1e5 and images.tile_contrast(board) > 100 and images.tile_contrast(board[:5, :5]) == 0.0
    rng = np.random.default_rng(1)
    img = rng.uniform(0, 255, (90, 120))
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    for h in (images.perceptual_hash, images.difference_hash):
        assert len(h(img)) == 4 and bits(h(img), h(img * 0.9 + 5)) == 0 and bits(h(img), h(rng.uniform(0, 255, (90, 120)))) > 60
    np.testing.assert_allclose(images.shrink(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    boxes = np.array([[0, 0, 9, 9], [1, 1, 10, 10], [50, 50, 60, 60]], float)
    assert images.suppress(boxes, np.array([0.8, 0.9, 0.7])) == [1, 2]
    assert images.largest_central(boxes, 110, 110, 1) == [2]
    for angles in ((10, -20, 30), (0, 0, 0)):
        p, y, r = np.radians(angles)
        rx, ry, rz = (np.array(m) for m in ([[1, 0, 0], [0, np.cos(p), -np.sin(p)], [0, np.sin(p), np.cos(p)]], [[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]], [[np.cos(r), -np.sin(r), 0], [np.sin(r), np.cos(r), 0], [0, 0, 1]]))
        m = rz @ ry @ rx
        np.testing.assert_allclose(images.euler_degrees(m * 1.01), angles, atol=1e-9)
        np.testing.assert_allclose(images.rotation_from_6d(np.concatenate([m[:, 0] * 2, m[:, 1]])), m, atol=1e-12)
    src = rng.normal(size=(5, 2))
    t = np.array([[0.0, -2.0, 3.0], [2.0, 0.0, 1.0]])
    np.testing.assert_allclose(images.similarity_transform(src, src @ t[:, :2].T + t[:, 2]), t, atol=1e-9)
    bgr = rng.uniform(0, 255, (40, 40, 3))
    assert images.color_descriptor(bgr).shape == (29,) and images.fallback_embedding(bgr).shape == (848,)
    assert images.exposure(grey)["tonal_range"] == 0 and 0 <= images.sharpness(img)["focus"] <= 1
    assert images.decode_boxes(np.array([[5.0, 5.0]]), np.array([[1.0, 2, 3, 4]])).tolist() == [[4, 3, 8, 9]]


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h, turned=1, time=b"2020:01:02 03:04:05\0"):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 274, 3, 1, turned, 0) + struct.pack("<HHII", 306, 2, len(time), 38) + struct.pack("<I", 0) + time
    exif = b"Exif\0\0" + tiff
    sof = struct.pack(">BHHB", 8, h, w, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xd9"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.PNG": png(30, 20), "sub/b.jpg": jpeg(40, 60), "sub/c.jpeg": jpeg(40, 60, turned=6), "broken.jpg": b"text", "d.txt": b"x", "e.png": png(9, 9)}.items():
        (tmp_path / name).write_bytes(data)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(files.find_files(spark, str(tmp_path))) == ["a.PNG", "b.jpg", "broken.jpg", "c.jpeg", "e.png"]
    assert names(files.find_files(spark, str(tmp_path), selected=[".png"])) == ["a.PNG", "e.png"]
    assert names(files.find_files(spark, str(tmp_path), selected=[".gif"])) == ["a.PNG", "b.jpg", "broken.jpg", "c.jpeg", "e.png"]
    assert names(files.find_files(spark, str(tmp_path), orientation="landscape")) == ["a.PNG", "c.jpeg"]
    assert names(files.find_files(spark, str(tmp_path), orientation="portrait")) == ["b.jpg"]
    assert [r[0] for r in files.discover_extensions(files.find_files(spark, str(tmp_path))).collect()] == [".jpeg", ".jpg", ".png"]
    read = files.with_dimensions(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).filter("path not like '%txt'").select("path", "content"))
    good, bad = files.split_errors(read)
    assert good.count() == 4 and names(bad) == ["broken.jpg"]
    t = files.capture_time(F.col("exif_time"), F.lit(7.0))
    got = {r["path"].rsplit("/", 1)[1]: (r["ts"], r["source"]) for r in read.select("path", t["ts"].alias("ts"), t["source"].alias("source")).collect()}
    assert got["b.jpg"] == (1577934245.0, "exif") and got["a.PNG"] == (7.0, "filesystem")


def test_incremental(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "path string, w int, kind string")
    new = spark.createDataFrame([("b", None, "y"), ("c", 5, None)], "path string, w int, kind string")
    assert sorted(tuple(r) for r in incremental.coalesce_upsert(old, new, "path").collect()) == [("a", 1, None), ("b", 2, "y"), ("c", 5, None)]
    import hashlib
    import json

    paths = ["/b", "/a"]
    want = hashlib.sha1(json.dumps({"paths": sorted(paths), "algorithm_version": "1"}, sort_keys=True).encode()).hexdigest()[:12]
    assert one(spark, g=incremental.group_id(F.array(*map(F.lit, paths)), {"algorithm_version": "1"}))["g"] == want


def test_groups_and_results(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, 0.5), (1, 2, 3, 0.1)], "g int, l int, r int, s double")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "g int, id int")
    assert {(r["g"], r["id"]) for r in groups.medoid(members, pairs, ["g"], "id", "s").collect()} == {(1, 1), (2, 9)}
    assert results.page_label(100, 1) == "Showing 49-96 of 100 photos (page 2/3)" and results.page_label(40, 0) == ""
    assert results.progress("duplicates", "matching", 1, 2) == 75 and results.progress("scenes", "detecting_scene_changes", 1, 2) == 64 and results.progress("faces", "x", 9, 4) == 100
    items = spark.createDataFrame([Row(path=f"/{k}/a.jpg", kind=k) for k in "xyz"])
    assert sorted(r["target"] for r in results.export_names(items).collect()) == ["a.jpg", "a_1.jpg", "a_2.jpg"]


def test_export_and_streaming(spark, tmp_path):
    items = spark.createDataFrame([("g1", "/a"), ("g2", "/b")], "folder string, path string")
    results.write_groups(items, str(tmp_path / "out"), "folder")
    assert {r["folder"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"g1", "g2"}
    source, store = tmp_path / "in", str(tmp_path / "store")
    put = lambda rows, n: spark.createDataFrame(rows, "path string, file_size long, mtime_ns long").coalesce(1).write.parquet(str(source / n))
    put([("a", 1, 1), ("b", 1, 1)], "n=1")
    stream = lambda: spark.readStream.schema("path string, file_size long, mtime_ns long").parquet(str(source) + "/*")
    run = lambda: ingest(stream(), store, str(tmp_path / "ck"), lambda df: df.withColumn("done", F.col("file_size") * 10)).awaitTermination()
    run()
    put([("a", 1, 1), ("b", 2, 2), ("c", 1, 1)], "n=2")
    run()
    assert sorted((r["path"], r["mtime_ns"], r["done"]) for r in spark.read.parquet(store).collect()) == [("a", 1, 10), ("b", 1, 10), ("b", 2, 20), ("c", 1, 10)]
    (tmp_path / "ev").mkdir()
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'k' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'k' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'k'").write.parquet(str(tmp_path / "ev/a"))
    counts = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "ev") + "/*"), "ts", "k")
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [1, 2]


def test_distribution(spark):
    rows = spark.createDataFrame([(float(x), x > 7) for x in range(11)], "v double, hot boolean")
    r = groups.distribution(rows, "v", ["hot"]).first()
    assert tuple(r) == (0.0, 5.0, 8.0, 9.0, 10.0, 10.0, 3)


def test_headers():
    assert files.header(b"GIF89a\x05\x00\x07\x00") == (5, 7, None) and files.header(b"") == (None, None, None)


def test_written_tables_are_deleted(spark):
    folder = Path(materialize.shared_folder(spark)) / "shoalsight"
    folder.mkdir(exist_ok=True)
    old = set(folder.iterdir())
    here = lambda: sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - old)
    with materialize.scratch(spark) as held:
        kept, gone = materialize.written(spark.range(5), "kept"), materialize.written(spark.range(6), "gone")
        assert gone.count() == 6 and here() == ["gone", "kept"]
        held.remove(kept._written_path)
    assert here() == ["kept"] and kept.count() == 5
    materialize.forget(kept)
    assert here() == []
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0} and here() == ["stars"]


def test_wide_distances_are_refused():
    assert hamming.band_plan(256, 18) == (10, 1) and hamming.band_plan(256, 9) == (10, 0) and hamming.band_plan(256, 25) == (10, 2) and hamming.band_plan(256, 2) == (5, 0)
    for bits, distance in ((128, 18), (128, 40), (256, 30)):
        with pytest.raises(ValueError):
            hamming.band_plan(bits, distance)


@pytest.mark.parametrize("distance", [3, 9, 18, 27])
def test_hamming_pairs_at_all_radii(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(256) for _ in range(12)]
    hashes = base + [h ^ sum(1 << b for b in rng.sample(range(256), rng.randint(0, 30))) for h in base for _ in range(8)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(h >> (64 * (3 - k)) & (2**64 - 1)) for k in range(4)]) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, p0 long, p1 long, p2 long, p3 long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(i, j, bin(a ^ b).count("1")) for a, i in first.items() for b, j in first.items() if i < j and bin(a ^ b).count("1") <= distance}
    assert {tuple(r) for r in hamming.hamming_pairs(df, "id", ["p0", "p1", "p2", "p3"], distance).collect()} == want


def test_duplicates_keep_pairs_with_other_difference_words(spark):
    """Photos of equal perceptual and unlike difference words: the pairs of those that are alike in both are found."""
    df = spark.createDataFrame([(1, 5, 0), (2, 5, -1), (3, 5, -1), (4, 5, -1), (5, 4, -2)], "id long, p0 long, d0 long")
    pairs = candidate_pairs(df, "id", ["p0"], ["d0"], DuplicateConfig(4, 4))
    found = connected_components(pairs, "l", "r").filter("id <> component").collect()
    assert {(r["id"], r["component"]) for r in found} == {(3, 2), (4, 2), (5, 2)}


@pytest.mark.parametrize("block", [2048, 7])
def test_knn_in_blocks(spark, block):
    v, df = vector_rows(spark, 90)
    df = df.withColumn("g", (F.col("id") % 2).cast("int"))
    got = {(r["l"], r["rank"]): r["r"] for r in vector_join.knn(df, ["g"], "id", "v", 4, block).collect()}
    for i in range(90):
        others = sorted((j for j in range(i % 2, 90, 2) if j != i), key=lambda j: (-float(np.cumsum(v[i] * v[j])[-1]), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == others
