import random

import brute
import pytest
from pyspark.sql import functions as F

from shoalsight.llm import repeats
from shoalsight.llm.bloom import bloom_of
from shoalsight.llm.repeats import Spec, remove_repeats
from shoalsight.llm.rolling import anchors, byte_values, word_bounds
from shoalsight.llm.substring_dedup import substring_dedup
from shoalsight.llm.suffix_dedup import suffix_dedup

import numpy as np


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [prose(k) for k in (12, 30, 50, 80)]
    out = [None, "", " \t", "x", "a" * 500, "ab " * 200, prose(400)]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng.randint(0, 40))]
        out.append(rng.choice(" \n").join(parts))
    base = prose(200).split(" ")
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        out.append(" ".join(copy))
    out += [out[9], out[9], out[20] + " tail"]
    return out


def spans_ok(row, n):
    ends = [x for s in row["spans"] for x in (s["start"], s["end"])]
    return ends == sorted(set(ends)) and all(0 <= x <= n for x in ends)


@pytest.mark.parametrize("seed,hot", [(1, 16384), (2, 3)])
def test_suffix_dedup(spark, seed, hot):
    texts = corpus(seed)
    df = brute.frame(spark, texts).repartition(5)
    want = brute.suffix_dedup(list(enumerate(texts)), 100)
    got = remove_repeats(df, Spec("bytes", 100, 20, True, hot=hot)).collect()
    assert {r["doc_id"]: (r["size"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want
    assert all(spans_ok(r, r["size"]) for r in got)


@pytest.mark.parametrize("seed,hot", [(3, 16384), (4, 3)])
def test_substring_dedup(spark, seed, hot):
    texts = corpus(seed)
    df = brute.frame(spark, texts).repartition(5)
    want = brute.substring_dedup(list(enumerate(texts)), 35)
    got = remove_repeats(df, Spec("words", 35, 8, False, hot=hot)).collect()
    assert {r["doc_id"]: (r["size"], sum(s["end"] - s["start"] for s in r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_odd_rows(spark, op):
    empty = op(brute.frame(spark, []))
    assert empty.collect() == []
    long = "word " * 40
    rows = [(None, long, 1), (None, long, 2), (7, long, 3), (7, "other " * 30, 4), (8, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("kept", F.lit("clash"))
    got = op(df).collect()
    assert len(got) == 5 and sorted(str(r["doc_id"]) for r in got) == ["7", "7", "8", "None", "None"]
    assert all(r["size"] == 0 and r["spans"] == [] and bytes(r["kept"]) == b"" for r in got if r["doc_id"] == 8)


@pytest.mark.parametrize("parts,hot", [(1, 16384), (2, 16384), (1, 0), (2, 0)])
def test_equal_rows_are_one_document(spark, parts, hot):
    rng = random.Random(5)
    prose = lambda: "".join(rng.choice("abcdefgh ") for _ in range(400))
    alone, whole = prose(), prose()
    part = prose()[:150] + whole[80:330] + prose()[:150]
    docs = {None: alone, 1: whole, 2: part}
    want = brute.suffix_dedup([(-1, alone), (1, whole), (2, part)], 100)
    rows = [(k, t) for _ in range(2) for k, t in docs.items()]
    halves = spark.sparkContext.parallelize(rows, parts)
    df = spark.createDataFrame(halves, "doc_id long, text string")
    assert df.rdd.getNumPartitions() == parts
    got = remove_repeats(df, Spec("bytes", 100, 20, True, hot=hot)).collect()
    assert len(got) == 6 and want[2][1] >= 250 and want[1][1] == want[-1][1] == 0
    for r in got:
        n = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["size"], n, len(r["spans"]), brute.sha(bytes(r["kept"]))) == want[-1 if r["doc_id"] is None else r["doc_id"]]


def test_lengths_double():
    assert Spec("bytes", 100, 20, True).levels == [((20, 40), (0, 20)), ((40, 80), (20, 40)), ((80, 100), (40, 80))]
    assert Spec("words", 35, 8, False).levels == [((8, 16), (0, 8)), ((16, 32), (8, 16)), ((32, 35), (16, 27))]
    assert Spec("words", 64, 8, False).levels[-1] == (None, (32, 56)) and len(Spec("bytes", 100, 20, True).levels) == 3


def test_doubling_leaves_only_what_repeats(spark):
    """Anchors whose gram repeats by chance drop out before the windows are opened; windows of 100 bytes never do."""
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    spec = Spec("bytes", 100, 20, True)
    gram, near, whole = prose(20), prose(70), prose(160)
    texts = [prose(200) + x + prose(200) for x in (gram, gram, near, near, whole, whole)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    parts = [next(anchors(r, 100, 20, byte_values)) for r in raw]
    every = np.concatenate([f.gram for f in parts])
    gram_counts = dict(zip(*np.unique(every, return_counts=True)))
    rows = [np.flatnonzero([gram_counts[g] > 1 for g in f.gram]) for f in parts]
    blooms = []
    for level in range(3):
        held = []
        for f, at in zip(parts, rows):
            names = repeats._ranks(spec, f, at)
            held += [repeats._pairs(f.gram[at[names[:, level, s] > 0]], names[names[:, level, s] > 0, level, s], level, s) for s in (0, 1)]
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        keys = pairs[n > 1].view(np.int64).tolist()
        blooms.append(bloom_of(spark.createDataFrame([(k,) for k in keys], "a long"), "a", max(len(keys), 1), bits_per_key=64))
    left = []
    for f, at in zip(parts, rows):
        low, high = repeats._left(spec, blooms, f, at)
        left.append(sorted({int(p) for a, l, h in zip(at, low, high) for p in range(f.first[a] + f.offset[a] - h, f.first[a] + f.offset[a] - l + 1)}))
    assert not any(left[:4]) and all(set(range(200, 261)) <= set(x) for x in left[4:]) and all(len(x) < 130 for x in left[4:])


@pytest.mark.parametrize("hot", [16384, 3])
@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_anchors_listed_by_join(spark, unit, hot):
    """Beyond the bitmaps' bound the anchors to open come by a join; the results are the same."""
    texts = corpus(7)
    df = brute.frame(spark, texts).repartition(5)
    spec = Spec("bytes", 100, 20, True, hot, 1 << 12) if unit == "bytes" else Spec("words", 35, 8, False, hot, 1 << 10)
    got = remove_repeats(df, spec).collect()
    if unit == "bytes":
        want = brute.suffix_dedup(list(enumerate(texts)), 100)
        assert {r["doc_id"]: (r["size"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want
    else:
        want = brute.substring_dedup(list(enumerate(texts)), 35)
        assert {r["doc_id"]: (r["size"], sum(s["end"] - s["start"] for s in r["spans"]), brute.sha(bytes(r["kept"]))) for r in got} == want


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("bits", [1 << 28, 1 << 8])
def test_repeated_rows_of_words(spark, parts, bits):
    """Where no occurrence stays each row counts: rows with equal ids and texts are occurrences of each other."""
    rng = random.Random(8)
    prose = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage, alone, shared = prose(40), prose(60), prose(60)
    rows = [(None, shared), (None, shared), (3, shared), (4, prose(10) + " " + passage + " tail"), (4, prose(5) + " " + passage), (5, alone), (6, None), (6, None)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["size"], bytes(r["kept"]).decode()) for r in remove_repeats(df, Spec("words", 35, 8, False, max_bits=bits)).collect())
    want = [("3", 60, ""), ("4", 45, rows[4][1][: -len(passage) - 1]), ("4", 51, rows[3][1].replace(passage + " ", "")), ("5", 60, alone), ("6", 0, ""), ("6", 0, ""), ("None", 60, ""), ("None", 60, "")]
    assert got == sorted(want)


def test_very_long_texts(spark):
    """Texts longer than a part, with repeats across the parts' border."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(600_000))
    texts = [long, long[262_000:262_400] + "x" * 10, "y" + long[500_000:]]
    got = {r["doc_id"]: r for r in suffix_dedup(brute.frame(spark, texts)).collect()}
    assert [[(s["start"], s["end"]) for s in got[k]["spans"]] for k in (0, 1, 2)] == [[], [(0, 400)], [(1, 100_001)]]


def test_anchor_parts_cover_all_windows():
    rng = np.random.default_rng(1)
    from shoalsight.llm import rolling

    old, rolling.PART = rolling.PART, 64
    try:
        v = rng.integers(0, 2**63, 1000).astype(np.uint64)
        seen = []
        for _, _, first, count, offset in anchors(v, 35, 8):
            assert (offset - count + 1 >= 0).all() and (offset <= 35 - 8).all()
            seen += [p for f, c in zip(first, count) for p in range(f, f + c)]
        assert seen == list(range(len(v) - 34))
    finally:
        rolling.PART = old


def test_word_bounds():
    for text in ("", " ", "a", " ab c\x0b d\n\n", "\x1cx \x85y"):
        raw = np.frombuffer(text.encode(), np.uint8)
        s, e = word_bounds(raw)
        assert [raw[a:b].tobytes().decode() for a, b in zip(s, e)] == brute.words(text)
