"""Scenes with stated outcomes; all run in one job, an album for each."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoalsight.functions import scene as rules
from shoalsight.functions.concepts import Concept
from shoalsight.operators import scenes
from shoalsight.plans import tables
from shoalsight.plans.materialize import written
from shoalsight.plans.queries import QUERIES
from shoalsight.scene_config import PRESETS, SceneConfig, infer_preset, preset

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the test tables")

# Concepts of the scenarios (key, tags).
ACTIONS = [
    ("aisle", "aisle walking ceremony main_action"), ("rings", "rings ceremony interaction main_action"), ("kiss", "kiss ceremony interaction main_action"),
    ("applause", "applause reaction audience"), ("speech", "speech speaker main_action"), ("audience", "audience speech reaction"), ("couple_portrait", "portrait couple posed"),
    ("family_portrait", "portrait family group posed"), ("walking", "walking movement couple"), ("makeup", "makeup preparation interaction"), ("dress", "dressing preparation"),
    ("cake", "cake interaction main_action"), ("detail", "detail"), ("eating", "eating group"), ("dancing", "dance group"),
]
SHOTS = ["portrait", "main_action", "audience", "detail", "reaction"]
CONCEPTS = {"action": tuple(Concept(k, k, k, tuple(t.split())) for k, t in ACTIONS), "scene": (), "shot": tuple(Concept(k, k, k, (k,)) for k in SHOTS)}

# album: rows of name, seconds or -, semantic, action, shots, faces, mode, people; then the groups (ungrouped photos in none).
SCENARIOS = {
    "ceremony": (
        """aisle 10 1,.1,0,.2 aisle main_action 2 couple bride,groom
           rings 20 .92,.12,0,.25 rings main_action 2 couple bride,groom
           kiss 28 .9,.2,0,.18 kiss main_action 2 couple bride,groom
           applause 36 .82,.25,.15,.1 applause reaction 5 crowd bride,groom""",
        [["aisle"], ["rings"], ["kiss"], ["applause"]],
    ),
    "speech": (
        """s1 10 1,0,.1,0 speech main_action 1 solo speaker
           s2 18 .99,.02,.08,0 speech portrait 1 solo speaker
           s3 26 .97,.03,.06,0 speech main_action 1 solo speaker
           audience 34 .82,.22,.2,0 audience audience 6 crowd -
           applause 42 .8,.28,.22,0 applause reaction 6 crowd -
           resume 56 .98,.01,.09,0 speech main_action 1 solo speaker""",
        [["s1", "s2", "s3"], ["audience"], ["applause"], ["resume"]],
    ),
    "portraits": (
        """w1 10 1,.1,0,0 couple_portrait portrait 2 couple bride,groom
           w2 18 .98,.12,0,0 couple_portrait portrait 2 couple bride,groom
           close 26 .97,.15,0,0 couple_portrait portrait 2 couple bride,groom
           walk 60 .8,.15,.18,.2 walking main_action 2 couple bride,groom
           family 74 .76,.2,.18,0 family_portrait portrait 5 family_group bride,groom,p1,p2""",
        [["w1", "w2", "close"], ["walk"], ["family"]],
    ),
    "preparation": (
        """m1 10 1,0,.1,0 makeup main_action 2 couple bride,artist
           m2 18 .98,0,.12,0 makeup detail 2 couple bride,artist
           dress 34 .82,.15,.1,0 dress main_action 1 solo bride
           mirror 52 .74,.38,.02,0 couple_portrait portrait 1 solo bride""",
        [["m1", "m2"], ["dress"], ["mirror"]],
    ),
    "cake": (
        """wide 10 1,0,0,.12 cake main_action 2 couple bride,groom
           close 18 .98,0,0,.16 cake detail:.4,main_action:.7 2 couple bride,groom
           side 26 .96,0,0,.2 cake main_action 2 couple bride,groom""",
        [["wide", "close", "side"]],
    ),
    "venue": (
        """eating 10 1,0,0,0 eating audience 6 crowd -
           speech 20 .92,.15,0,0 speech main_action 1 solo -
           dancing 30 .84,.18,.2,0 dancing main_action 6 crowd -
           cake 40 .86,0,0,.22 cake main_action 2 couple -""",
        [["eating"], ["speech"], ["dancing"], ["cake"]],
    ),
    "untimed": (
        """a - 1,0,0,0 makeup main_action 2 couple bride,artist
           b - .98,0,.1,0 makeup detail:.4,main_action:.6 2 couple bride,artist
           c - .55,0,.7,.1 eating audience 5 crowd g1,g2""",
        [["a", "b"]],
    ),
    "order": (
        """b 20 .98,0,0,0 couple_portrait portrait 2 couple p1,p2
           a 10 1,0,0,0 couple_portrait portrait 2 couple p1,p2
           c 2000 0,1,0,0 speech main_action 1 solo speaker""",
        [["a", "b"], ["c"]],
    ),
    "detail": (
        """p1 10 1,0,0,0 couple_portrait portrait 2 couple a,b
           p2 18 .99,0,0,0 couple_portrait portrait 2 couple a,b
           d 24 .7,.05,0,.35 detail detail 0 none -
           p3 30 .99,0,0,0 couple_portrait portrait 2 couple a,b
           p4 38 1,0,0,0 couple_portrait portrait 2 couple a,b""",
        None,
    ),
}

SCHEMA = (
    "album string, path string, ts double, semantic array<double>, people array<string>, layout array<double>, subject array<double>, background array<double>, composition array<double>, "
    "color array<double>, action_scores array<double>, shot_scores array<double>, face_count int, face_area double, quality double, meta struct<orientation:string,shot_scale:string,"
    "face_bucket:string,participant_mode:string,cx:double,cy:double,hspread:double,vspread:double,scale:double>"
)


def unit(v):
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    return (v / n if n > 1e-12 else v).tolist()


def feature(album, name, at, semantic, action, shots, faces, mode, people):
    n = int(faces)
    some = [x.split(":") for x in shots.split(",")]
    shot = unit([next((float(p[1]) if len(p) > 1 else 1.0 for p in some if p[0] == k), 0.0) for k in SHOTS])
    layout = unit([n / 8, mode == "solo", mode == "couple", mode in ("family_group", "small_group"), 0.4, 0.2 if n > 2 else 0]) if n else None
    sem = unit([float(x) for x in semantic.split(",")])
    meta = (
        "landscape", "close" if n == 1 else "medium" if n == 2 else "wide", "zero" if n == 0 else "one" if n == 1 else "couple" if n == 2 else "small_group" if n <= 4 else "crowd", mode, 0.5, 0.5,
        0.05 if n <= 2 else 0.18, 0.05 if n <= 2 else 0.14, 0.12 if n <= 2 else 0.05,
    )
    return (
        album, name, None if at == "-" else float(at), sem, [] if people == "-" else people.split(","), layout, sem, None, unit([n / 8, 0.5, 0.25, 0.5, 0.2, 0.1]), unit([0.5, 0.5, 0.25, 0.75]),
        [1.0 if k == action else 0.0 for k, _ in ACTIONS], shot, n, 0.05 * n, None, meta,
    )


@pytest.fixture(scope="module")
def features(spark):
    rows = [feature(album, *line.split()) for album, (text, _) in SCENARIOS.items() for line in text.splitlines()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def grouped(features):
    return scenes.scene_groups(features, SceneConfig(), CONCEPTS).toPandas()


def groups_of(rows):
    held = rows.dropna(subset=["grp"]).sort_values(["ts", "path"])
    return [g["path"].tolist() for _, g in held.groupby(["session", "grp"], sort=True, dropna=False)]


@pytest.mark.parametrize("album", [a for a, (_, want) in SCENARIOS.items() if want is not None])
def test_scenarios(grouped, album):
    rows = grouped[grouped["album"] == album]
    assert sorted(map(sorted, groups_of(rows))) == sorted(map(sorted, SCENARIOS[album][1]))


def test_one_detail_does_not_split(grouped):
    rows = grouped[grouped["album"] == "detail"]
    found = groups_of(rows)
    assert len(found) + rows["grp"].isna().sum() <= 2 and any(g[0] == "p1" for g in found)


def test_every_photo_once(grouped, features):
    assert sorted(zip(grouped["album"], grouped["path"])) == sorted((r["album"], r["path"]) for r in features.select("album", "path").collect())


def test_pairs_agree_with_expressions(spark, features):
    """The block's vectorised pair components equal the expression form."""
    c = SceneConfig()
    f = rules.with_profiles(features.filter("album = 'speech' or album = 'portraits' or album = 'detail'").withColumn("album", F.lit("x")), c, CONCEPTS).withColumn("f", F.struct(*scenes._FEATURE))
    a, b = f.select(F.col("f").alias("l")), f.select(F.col("f").alias("r"))
    want = rules.pair_components(a.crossJoin(b).filter("l.path < r.path"), c, F.col("l"), F.col("r")).select("l.path", F.col("r.path").alias("other"), "semantic", "action", "people", "composition", "time", "combined").toPandas()
    blank = {"session": F.lit(0).cast("long"), "pos": F.lit(0).cast("long"), "change": F.lit(0.0), "reliability": F.lit("none"), "accepted": F.lit(False), "block": F.lit(0).cast("long")}
    rows = scenes._for_blocks(f.withColumns(blank)).toPandas().sort_values("path").reset_index(drop=True)
    block = scenes.Block(rows, c)
    at = {p: i for i, p in enumerate(block.path)}
    got = block.pairs(np.array([at[p] for p in want["path"]]), np.array([at[p] for p in want["other"]]))
    for k in ("semantic", "action", "people", "composition", "time", "combined"):
        np.testing.assert_allclose(got[k], want[k].to_numpy(), atol=1e-9, err_msg=k)


def plain_rows(n, gap=10.0, accepted=(), reliability="hard"):
    v = np.array([1.0, 0, 0, 0])
    return pd.DataFrame(
        {
            "album": "x", "session": 0, "pos": np.arange(n), "path": [f"{i:03d}" for i in range(n)], "ts": np.arange(n) * gap, "semantic": [v] * n, "people": [["a"]] * n, "layout": [v] * n,
            "subject": [v] * n, "background": [v] * n, "composition": [v] * n, "color": [v] * n, "action_scores": [None] * n, "face_count": 1, "face_area": 0.1, "quality": np.nan, "mode": "solo",
            "action_key": None, "action_family": None, "action_confident": False, "action_strong": False, "action_keys": [[]] * n, "shot_mode": "portrait", "shot_confident": True, "shot_strong": True,
            "orientation": "landscape", "shot_scale": "close", "face_bucket": "one", "cx": 0.5, "cy": 0.5, "hspread": 0.0, "vspread": 0.0, "scale": 0.1, "no_meta": False, "change": 0.1,
            "reliability": [reliability if i in accepted else "none" for i in range(n)], "accepted": [i in accepted for i in range(n)], "block": 0,
        }
    )


def test_structure_splits():
    b = scenes.Block(plain_rows(15), SceneConfig())
    parts = scenes.split_by_structure(b, [0, 1, 2, 7, 8, 14])
    assert parts == [[0, 1, 2], [7, 8], [14]]
    out = scenes.group_block(plain_rows(6, gap=150.0), SceneConfig())
    held = out.dropna(subset=["grp"]).groupby("grp")["ts"].agg(lambda t: t.max() - t.min())
    assert out["grp"].nunique() + out["grp"].isna().sum() >= 2 and (held <= 600).all()
    hard = scenes.Block(plain_rows(4, accepted=(1,)), SceneConfig())
    assert scenes.raw_segments(hard) == [[0, 1], [2, 3]]
    assert all(not ({x, y} & {0, 1} and {x, y} & {2, 3}) for x, y in scenes.edges(hard, [0, 1, 2, 3]))


@pytest.mark.parametrize("kind,merged", [("weak", True), ("supported", True), ("hard", False)])
def test_singleton_recovery(kind, merged):
    rows = plain_rows(4, accepted=(2,), reliability=kind)
    b = scenes.Block(rows, SceneConfig())
    assert (len(scenes.recover_singletons(b, scenes.raw_segments(b))) == 1) == merged
    assert (len(scenes.recover_tiny(b, scenes.raw_segments(b))) == 1) == merged


def test_average_link():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 1], [6, 6, 1, 0]], float)
    assert scenes.average_link_halves(d).tolist() == [0, 0, 1, 1]


def test_config():
    assert infer_preset(preset("tight")) == "tight" and infer_preset(preset("session")) == "session" and infer_preset(SceneConfig()) == "balanced"
    assert set(PRESETS) == {"balanced", "session", "tight"}
    tight, balanced = preset("tight"), SceneConfig()
    assert tight.minimum_pair_similarity > balanced.minimum_pair_similarity and tight.maximum_group_size < balanced.maximum_group_size
    for bad in ({"minimum_pair_similarity": 1.2}, {"hard_boundary_threshold": 0.1}, {"maximum_group_size": 1}, {"session_gap_seconds": -1}):
        with pytest.raises(ValueError):
            SceneConfig(**bad)
    assert SceneConfig().signature() != tight.signature()


def one_album(features):
    """The timed photos of all scenarios, one after the other in one album."""
    albums = F.array(*map(F.lit, SCENARIOS))
    later = F.array_position(albums, F.col("album")) * 400.0
    return features.withColumns({"album": F.lit("x"), "path": F.concat_ws("-", "album", "path"), "ts": F.col("ts") + later})


@pytest.mark.parametrize("window", [1, 2, 3])
def test_chunks_change_nothing(features, monkeypatch, window):
    """Sessions, positions, transitions, support and blocks do not depend on how an album is cut into chunks."""
    config = SceneConfig(boundary_context_window=window, session_gap_seconds=300)
    found = []
    for size in (2048, 1, 3):
        monkeypatch.setattr(scenes, "CHUNK", size)
        found.append(sorted(map(str, scenes.transitions(one_album(features), config, CONCEPTS).drop("quality").collect())))
    assert len(found[0]) == features.filter("ts is not null").count() and found[1] == found[0] and found[2] == found[0]


def test_completed_late(spark, features, grouped):
    """Features that are added when rows are dealt out give the same groups."""
    light, rest = features.select("album", "path", "ts"), features.drop("ts")
    got = scenes.scene_groups(light, SceneConfig(), CONCEPTS, complete=lambda df: df.join(rest, ["album", "path"])).toPandas()
    plain = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))
    assert plain(got) == plain(grouped)


def vectors_dealt(df):
    """Exchanges of a plan that move vectors."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            types = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
            found += [t for t in types if "array<float" in t or "array<double" in t]
    return found


@pytest.fixture
def plain_plans(spark):
    """Plans with their exchanges, and no joins broadcast but those that ask for it."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    usual = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in usual.items():
        spark.conf.set(k, v)


@needs_tables
@pytest.mark.parametrize("name", ["w17_scene_groups", "w3_scene_boundaries"])
def test_vectors_are_not_dealt_out(spark, plain_plans, monkeypatch, name):
    """Photos are shuffled and written without their vectors, which are many times as large; what goes to Python by blocks is
    dealt out before it gets them."""
    plans = []
    monkeypatch.setattr(scenes, "written", lambda df, *a: plans.append(df) or written(df, *a))
    plans.append(QUERIES[name](spark, DATA))
    assert len(plans) > 1 and not [t for df in plans for t in vectors_dealt(df)]
    assert not [t for df in plans for _, t in df.dtypes if "array<float" in t or "array<double" in t]


@needs_tables
@pytest.mark.parametrize("name", ["w17_scene_groups", "w3_scene_boundaries"])
def test_however_vectors_are_added(spark, tmp_path, monkeypatch, name):
    """The same rows with vectors broadcast or joined; photos without a vector are left out, and one with two comes twice."""
    rows = lambda at: sorted(map(str, QUERIES[name](spark, str(at)).collect()))
    want = rows(DATA)
    monkeypatch.setattr(tables, "BROADCAST_VALUES", 0)
    assert rows(DATA) == want
    known, events = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("embeddings", "events"))
    n = known.count()
    events.write.parquet(f"{tmp_path}/events.parquet")
    known.withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")).otherwise(n)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert 0 < len(rows(tmp_path)) < len(want)
    known.withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")).otherwise(8)).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    of = {"w17_scene_groups": F.floor(F.col("event_id") / 5) % n, "w3_scene_boundaries": (F.col("user_id") + F.floor(F.col("event_id") % 5 / 4)) % n}[name]
    times = events.select(of.alias("v")).groupBy("v").count().collect()
    assert len(rows(tmp_path)) == sum(r["count"] * {7: 0, 8: 2}.get(r["v"], 1) for r in times)
