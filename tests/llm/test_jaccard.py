import random

import brute
import pytest

from shoalsight.llm.jaccard_join import Join, jaccard_components, keep_one


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    common = prose(15)
    out = [None, "", " \n", "one", "One", "one two", "ONE  two", "a b c d e", "a b c d e f"]
    for _ in range(40):
        out.append(" ".join(prose(rng.randint(3, 120)) + (common if rng.random() < 0.4 else [])))
    for size, edits in ((60, 8), (25, 2), (12, 30)):
        base = prose(150)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append((" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    chain = prose(100)
    for k in range(30):  # each links with the next, the ends do not
        out.append(" ".join(chain[:]))
        chain = chain[1:] + prose(1)
    rng.shuffle(out)
    return out + out[:10]


@pytest.mark.parametrize("seed,k,percent,group", [(1, 3, 90, 8), (2, 5, 80, 32), (3, 3, 90, 2)])
def test_components(spark, seed, k, percent, group):
    texts = corpus(seed)
    df = brute.frame(spark, texts).repartition(6)
    got = jaccard_components(df, Join(k=k, percent=percent, group=group, visitors=40 // group, buckets=1 << 10)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(list(enumerate(texts)), k, percent)


def test_low_percent(spark):
    rng = random.Random(6)
    texts = []
    for n, m in ((64, 160), (60, 140), (30, 70), (200, 300)):  # parts of texts, whose parity maps have other sizes
        words = [f"w{rng.randrange(10**6)}" for _ in range(m)]
        texts += [" ".join(words), " ".join(words[:n])]
    want = brute.components(list(enumerate(texts)), 1, 40)
    got = jaccard_components(brute.frame(spark, texts).repartition(3), Join(k=1, percent=40, group=4, buckets=1 << 10)).collect()
    assert [want[i][1] for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_odd_rows(spark):
    assert jaccard_components(brute.frame(spark, [])).collect() == []
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t, 1), (None, t, 1), (5, t, 1), (5, t, 1), (6, t + " x", 1), (7, None, 1), (8, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 56, None), (None, 56, None), (5, 56, 5), (5, 56, 5), (6, 57, 5), (7, 0, 7), (8, 0, 8)], key=str)
    left = keep_one(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([None, None, 5, 7, 8], key=str)


def test_rows_that_share_ids(spark):
    """Rows that share a doc_id are linked by their own texts, and only copies go; extra columns and long texts pass."""
    rng = random.Random(21)
    a, b, c, long = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (80, 80, 80, 50_000))
    rows = [(1, a, 1), (5, a + " x", 2), (5, b, 3), (9, b + " y", 4), (6, c, 5), (6, c + " z", 6), (6, c, 7), (None, a, 8), (None, a, 9), (7, None, 10), (7, None, 11), (7, "", 12), (8, long, 13), (9, long + " y", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert found >= {(1, 76, 1), (5, 77, 1), (5, 76, 5), (9, 77, 5), (6, 76, 6), (6, 77, 6), (None, 76, None), (7, 0, 7), (8, 49_996, 8), (9, 49_997, 8)}
    left = keep_one(df)
    assert left.columns == df.columns
    kept = sorted(r["th"] for r in left.collect())
    assert [x for x in kept if x not in (5, 6, 7)] == [1, 3, 8, 9, 10, 11, 12, 13] and len([x for x in kept if x in (5, 6, 7)]) == 1
    assert keep_one(brute.frame(spark, [])).collect() == [] and keep_one(brute.frame(spark, [None, "", " "])).count() == 3


def test_common_token_is_salted(spark):
    """A prefix token of many groups is joined in parts, and more tokens than the bitmap holds by a join; the links are the same."""
    texts = corpus(9)
    df = brute.frame(spark, texts).repartition(6)
    got = jaccard_components(df, Join(k=3, percent=90, group=2, visitors=20, salted=2, buckets=1 << 10, max_bits=1 << 10)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.components(list(enumerate(texts)), 3, 90)
