import numpy as np
from pyspark.sql import functions as F

from shoalsight.functions import onnx
from shoalsight.functions.concepts import CONCEPTS, FAMILIES
from shoalsight.operators.prototypes import guard, margins, prototype_scores, top_k
from shoalsight.plans import scans
from shoalsight.scene_config import SceneConfig
from shoalsight.sources import schemas


def test_batch_inference_survives_bad_rows(spark):
    def run(model, x):
        if (x < 0).any():
            raise ValueError("bad row")
        return x.reshape(len(x), -1) + 0.0

    rows = [(i, [float(i), 1.0, 2.0, 2.0]) for i in range(1, 9)] + [(20, [-1.0, 0.0, 0.0, 0.0]), (21, None), (22, [1.0])]
    got = {r["id"]: r["embedding"] for r in onnx.embed(spark.createDataFrame(rows, "id long, values array<double>"), "id", "m", (2, 2), batch=4, run=run).collect()}
    assert got[20] is got[21] is got[22] is None
    for i in range(1, 9):
        v = np.array([i, 1, 2, 2], float)
        np.testing.assert_allclose(got[i], v / np.linalg.norm(v), atol=1e-6)
    assert onnx.providers(["CPUExecutionProvider"]) == ["CPUExecutionProvider"] and onnx.providers([]) == ["CPUExecutionProvider"]


def test_detections():
    size = (16, 16)
    cells = {8: 2 * 2 * 2, 16: 1 * 1 * 2}
    scores = [np.zeros(n) for n in cells.values()]
    scores[0][[0, 1, 6]] = 0.9, 0.8, 0.75
    d = [np.full((n, 4), 0.5) for n in cells.values()]
    k = [np.zeros((n, 5, 2)) for n in cells.values()]
    b, c, m = onnx.detections(scores, d, k, size, strides=(8, 16))
    assert c.tolist() == [0.9, 0.75] and b.tolist() == [[-4, -4, 4, 4], [4, 4, 12, 12]] and m.shape == (2, 5, 2)
    assert len(onnx.detections(scores, d, k, size, strides=(8, 16), most=1)[0]) == 1


def test_concepts():
    assert [len(CONCEPTS[k]) for k in ("action", "scene", "shot")] == [46, 16, 10]
    at = {c.key: c for c in CONCEPTS["action"]}
    assert at["speech_audience"].family == "speech" and at["sitting"].family == "sitting" and at["wedding_toast"].family == "speech"
    assert not {"audience", "toast", "flowers"} & {c.family for c in CONCEPTS["action"]} and len(FAMILIES) == 22


def test_prototypes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0]), (3, [0.6, 0.8])], "id long, v array<double>")
    s = prototype_scores(df, "id", "v", np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]))
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "ord int, name string")
    top = top_k(s, "id", names, 2)
    assert sorted((r["id"], r["rank"], r["name"]) for r in top.collect()) == [(1, 1, "x"), (1, 2, "z"), (3, 1, "y"), (3, 2, "x")]
    m = {r["id"]: (r["name"], r["confident"]) for r in margins(top, "id", 0.012, 0.025).collect()}
    assert m == {1: ("x", False), 3: ("y", True)}
    assert guard(df, "v", 2, "a", "a") is df and guard(df, "v", 3, "a", "a") is None and guard(df, "v", 2, "a", "b") is None


def test_refresh_computes_misses_only(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, file_size long, mtime_ns long")
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        seen.add(df.count())
        return df.withColumn("score", F.lit(1.0))

    first = scans.refresh(files, compute(files.limit(0)).withColumn("version", F.lit(2)), 2, compute)
    assert seen.value == 3
    changed = files.withColumn("mtime_ns", F.col("mtime_ns") + (F.col("path") == "b").cast("int"))
    assert scans.refresh(changed, spark.createDataFrame(first.collect(), first.schema), 2, compute).count() == 3 and seen.value == 4
    assert scans.refresh(files, first, 3, compute).count() == 3


def test_keys_and_tags(spark):
    paths = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, file_size long, mtime_ns long")
    k = scans.folder_key(paths, SceneConfig(), "m")
    assert k == scans.folder_key(paths.orderBy(F.desc("path")).repartition(3), SceneConfig(), "m")
    assert len({k, scans.folder_key(paths.limit(1), SceneConfig(), "m"), scans.folder_key(paths, SceneConfig(), "n"), scans.folder_key(paths, SceneConfig(minimum_group_cohesion=0.5), "m")}) == 4
    with scans.cancellable(spark, "scan"):
        assert "scan" in spark.getTags()
    assert "scan" not in spark.getTags() and scans.cancel(spark, "scan") == []


def test_sections(spark):
    g = spark.createDataFrame(
        [("x", 0, 0, "a", 1.0, 0, 0, 0.9), ("x", 0, 1, "b", 2.0, 0, 0, 0.9), ("x", 0, 2, "c", 3.0, 2, None, None), ("x", None, 0, "u", None, 0, 0, 1.0)],
        "album string, session long, pos long, path string, ts double, segment long, grp long, cohesion double",
    )
    assert {r["path"]: r["group_index"] for r in scans.memberships(g).collect()} == {"a": 1, "b": 1, "c": None, "u": 2}
    judged = spark.createDataFrame([("x", 0, "hard", True), ("x", 0, "supported", False), ("x", 0, None, None)], "album string, session long, reliability string, accepted boolean")
    r = scans.session_sections(g, judged).first()
    assert (r["image_count"], r["segment_count"], r["transition_count"], r["hard_boundary_count"], r["accepted_soft_boundary_count"]) == (3, 2, 2, 1, 0)
    assert tuple(scans.summary(g).first())[:4] == (2, 1.5, 1, 2)


def test_schemas(spark):
    for s in (schemas.FILES, schemas.FACES, schemas.PEOPLE, schemas.REFERENCES, schemas.BLUR, schemas.HASHES, schemas.FOLDERS):
        assert spark.createDataFrame([], s).columns
    old = spark.createDataFrame([("a", 1)], "path string, other int")
    assert schemas.evolve(old, "path string, version long").columns == ["path", "version", "other"]
