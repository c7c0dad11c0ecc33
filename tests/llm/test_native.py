"""Quality rules, line dedup, mixing and decontamination against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import brute
from pyspark.sql import functions as F

from shoalsight.llm import mixing
from shoalsight.llm.common import keep_where
from shoalsight.llm.decontaminate import MASKS, contaminated, drop_contaminated
from shoalsight.llm.line_dedup import LineRuns, dedup_lines
from shoalsight.llm.mixing import mix, mix_documents, schedule, source_targets
from shoalsight.llm.quality_rules import Rule, filter_by_rules, quality_rules


def prose(rng, n, vocab="the of and stone river light walks under green hill seven carry softly bright morning".split()):
    return " ".join(rng.choice(vocab) + rng.choice(["", "", str(rng.randint(0, 999))]) for _ in range(n))


def plain_measures(text):
    t = text or ""
    w = brute.words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    said = [x for x in t.split("\n") if brute.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(said) - len(set(said)), len(twice)


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "x y x y x y z", "é ü#|\n\né ü#|", "word " * 60, prose(rng, 300), "the end\x0bof\x1cit\n" * 30, "$$$ " * 80]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    df = brute.frame(spark, texts).withColumn("n_words", F.lit("clash"))
    for r in quality_rules(df).collect():
        want = plain_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_filter(spark):
    rng = random.Random(6)
    good = prose(rng, 120)
    df = brute.frame(spark, [good, "SHOUT!! " * 3 + good.upper(), " | ".join(good.split()), None, "too short", good, good]).withColumn("kept", F.lit(1))
    left = filter_by_rules(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 5, 6]
    strict = filter_by_rules(df, (Rule("mean_word_chars", 100.0),))
    assert strict.collect() == []
    assert filter_by_rules(brute.frame(spark, [])).collect() == []


def plain_lines(docs, min_docs=3, min_chars=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_texts(seed):
    rng = random.Random(seed)
    common = [prose(rng, 6) for _ in range(6)] + ["exactly twenty chars", "only nineteen chars", "É accented line of text"]
    out = [None, "", "\n\n", "  " + common[0].upper() + " \t"]
    for _ in range(40):
        out.append("\n".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(["", prose(rng, 5), " " + rng.choice(common).title()]) for _ in range(rng.randint(0, 9))))
    return out + out[10:13]


def test_line_dedup(spark):
    texts = line_texts(7)
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = dedup_lines(brute.frame(spark, texts).repartition(3), n_batches=batches, fanout=fanout).collect()
        assert {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["text"] or "") for r in got} == plain_lines(list(enumerate(texts)))


def test_line_dedup_odd_rows(spark):
    assert dedup_lines(brute.frame(spark, [])).collect() == []
    line = "this line is long enough"
    df = spark.createDataFrame([(None, line, 1), (1, line, 2), (1, line, 2), (2, "x\n" + line, 3)], "doc_id long, text string, pos int")
    got = sorted((str(r["doc_id"]), r["text"], r["pos"]) for r in dedup_lines(df).collect())
    assert got == [("1", "", 2), ("1", "", 2), ("2", "x\n" + line, 3), ("None", "", 1)]


def test_line_runs_mark_fresh_keys(spark):
    store = LineRuns(spark, fanout=2, min_chars=5)
    a, b = brute.frame(spark, ["first line\nsecond line"]), brute.frame(spark, ["second line\nthird line"], first=10)
    store.add(a)
    assert store.fresh_keys(b).count() == 1
    store.add(b)
    assert [len(x) for x in store.levels] == [0, 1]
    assert sorted((r["n_docs"], r["max_doc"]) for r in store.totals().collect()) == [(1, 0), (1, 10), (2, 10)]


def test_line_runs_hold_each_key_once(spark):
    """The anti-join decides which keys are new: without it a key would come back in a second run of keys."""
    store = LineRuns(spark, fanout=3, min_chars=5)
    texts = ["first line\nsecond line", "second line\nthird line\nsecond line", "first line\nsecond line", "fourth line"]
    for i, t in enumerate(texts):
        store.add(brute.frame(spark, [t], first=i))
    held = store._read(store.levels).collect()
    assert len(held) == len({(r["h1"], r["h2"]) for r in held}) == 4
    assert sorted(r["n_docs"] for r in store._read(store.additions).collect()) in ([1, 1, 1], [1, 2])
    assert sorted((r["n_docs"], r["max_doc"]) for r in store.totals().collect()) == [(1, 1), (1, 3), (2, 2), (3, 2)]
    assert [(r["n_docs"], r["max_doc"]) for r in store.totals(3).collect()] == [(3, 2)]


def test_line_dedup_counts_documents(spark):
    """Rows that share a doc_id are one document; long lines and texts are compared whole."""
    line, long = "a line of twenty characters", "x" * 300_000
    rows = [(1, line, 0), (1, line + "\nother", 1), (2, line, 2), (3, long + "a", 3), (4, long + "b", 4), (5, long + "a\n" * 2000, 5), (6, long + "a", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    got = {r["pos"]: r["text"] for r in dedup_lines(df).collect()}
    assert [got[k] for k in (0, 1, 2)] == [line, line + "\nother", line]
    assert got[4] == long + "b" and got[3] == "" and got[6] == long + "a" and got[5].startswith("a\n")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: source -> size. Raises the common level until what exceeds a cap is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 400]) if i % 7 else 1), rng.choice(["a", "a", "a", "b", "c", None, "Ä", "tiny"][: 8 if i % 5 else 7])) for i in range(300)] + [(900, None, "z"), (901, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block=64).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mix(df.repartition(7), block=64).collect())) == sorted(map(str, got))
    kept = mix_documents(df.withColumn("taken", F.lit("x")), block=64)
    assert kept.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"] and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["taken"]}


def test_mix_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == []
    df = spark.createDataFrame([(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s")], empty.schema)
    assert sorted((str(r["doc_id"]), r["taken"]) for r in mix(df).collect()) == [("1", 2), ("1", 2), ("None", 2)]


def test_schedule_follows_shares(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 9000), ("c", 4000)], "source string, size long")
    t = source_targets(sizes, (1, 2, 3), 3)
    share = {r["sid"]: r["target"] / 18000 for r in t.collect()}
    first = [r["sid"] for r in schedule(t, 10).orderBy("slot").limit(300).collect()]
    assert all(abs(first.count(s) / 300 - x) < 0.02 for s, x in share.items())


def plain_points(n):
    """Multiples of the golden ratio modulo 1, in fractions."""
    return [Fraction(k * mixing.GOLDEN % mixing.WHOLE, mixing.WHOLE) for k in range(n)]


def test_schedule_is_the_points(spark):
    """Every slot belongs to the source whose share holds the slot's point, and any prefix is near the shares."""
    assert abs(mixing.GOLDEN / mixing.WHOLE - (5**0.5 - 1) / 2) < 1e-15
    rng = random.Random(14)
    rows = [(f"s{k}", rng.choice([1, 3, 9, 40, 700, 9000])) for k in range(40)]
    t = source_targets(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3), 3).collect()
    targets = spark.createDataFrame(t).coalesce(1)
    block, need = 16, {}
    for r in sorted(t, key=lambda r: r["sid"]):
        goal = math.floor(r["target"] + 0.5)
        blocks = -(-r["source_size"] // block)
        need[r["sid"]] = goal // r["source_size"] * blocks + -(-(goal % r["source_size"]) // block)
    total = sum(need.values())
    edges, low = [], 0
    for sid, n in need.items():
        edges.append((Fraction(low, total), Fraction(low + n, total), sid))
        low += n
    want, left = [], dict(need)
    for k, x in enumerate(plain_points(3 * total + 8)):
        sid = next(s for a, b, s in edges if a <= x < b)
        if left[sid]:
            want.append((k, sid, need[sid] - left[sid]))
            left[sid] -= 1
    got = sorted((r["slot"], r["sid"], r["rank"]) for r in schedule(targets, block).collect())
    assert got == want and not any(left.values())
    counts = Counter()
    for k, (slot, sid, _) in enumerate(got[: total // 2], 1):
        counts[sid] += 1
        assert all(abs(counts[s] - k * n / total) < 3 + math.log2(k) for s, n in need.items())


def test_first_slots(spark):
    """A document's first slot is that of the block where its stream position lies."""
    rng = random.Random(15)
    df = spark.createDataFrame([(i, prose(rng, rng.randint(0, 90)), rng.choice("aabc")) for i in range(120)], "doc_id long, text string, source string")
    got = mix(df, block=32).collect()
    at = {}
    for r in got:
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        if r["taken"]:
            at.setdefault(r["source"], []).append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["first_slot"]))
    assert set(at) == {"a", "b", "c"} and all([s for _, s in sorted(x)] == sorted(s for _, s in x) for x in at.values())


def test_decontaminate(spark):
    rng = random.Random(11)
    items = [prose(rng, n) for n in (9, 13, 20, 40)] + ["too few words", None]
    clean = [prose(rng, 200) for _ in range(20)] + [None, "", "..."]

    def leak(text, wrong):
        w = text.split()
        for k in range(wrong):
            w[(k * 6 + 5) % len(w)] = "other"
        return prose(rng, 30) + "\n" + " ".join(w).upper().replace(" ", ", ") + " " + prose(rng, 10)

    leaks = [leak(t, wrong) for t in items[:4] for wrong in (0, 1)] + [leak(items[3], 5)]
    df = brute.frame(spark, clean + leaks + [leaks[0]])
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(df, tests).collect()}
    n = len(clean)
    assert got == {(n + 2 * i + k, i) for i in range(4) for k in (0, 1)} | {(n + 8, 3), (n + 9, 0)}
    for rows in (10, 2_000_000):
        assert {(r["doc_id"], r["item_id"]) for r in contaminated(df, tests, broadcast_rows=rows).collect()} == got
    left = drop_contaminated(df, tests)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(n))
    assert contaminated(brute.frame(spark, []), tests).collect() == [] and contaminated(df, tests.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, items[3], 1), (None, items[3], 1)], "doc_id long, text string, item_id int")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(odd, tests).collect()] == [(None, 3)]


def test_masks_reach_every_accepted_overlap():
    masks = [[k for k, c in enumerate(m) if c == "1"] for m in MASKS]
    for n in range(8, 14):
        for left in combinations(range(n), -(-3 * n // 4)):
            assert any(all(s + k in left for k in m) for m in masks for s in range(n)), (n, left)


def plain_leaks(docs, items, window=13, least=8):
    """(doc, item) -> equal words in the best window, comparing each item word by word along each diagonal."""
    out = {}
    for d, text in docs:
        dw = brute.words((text or "").lower())
        for i, item in items:
            iw = brute.words(item.lower())
            span = min(window, len(iw))
            best = 0
            for diag in range(-len(iw), len(dw)) if len(iw) >= least else ():
                same = [0 <= diag + j < len(dw) and dw[diag + j] == w for j, w in enumerate(iw)]
                best = max(best, *(sum(same[j : j + span]) for j in range(len(iw) - span + 1)))
            if span and best >= -(-3 * span // 4):
                out[d, i] = best
    return out


def test_decontaminate_random_edits(spark):
    rng = random.Random(12)
    items = [prose(rng, n) for n in (7, 8, 8, 9, 10, 11, 12, 13, 14, 17, 40)]
    docs = [prose(rng, 60)]
    for item in items * 6:
        w = item.split()
        for k in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) * 3 // 10))):
            w[k] = "other"
        docs.append(" ".join([prose(rng, rng.randint(0, 9)), *w, prose(rng, rng.randint(0, 9))]))
    want = plain_leaks(list(enumerate(docs)), list(enumerate(items)))
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in contaminated(brute.frame(spark, docs), tests).collect()}
    assert len(want) > 40 and got == want


def test_short_items_are_searched_whole(spark):
    rng = random.Random(16)
    items = ["seldom seen phrase", "solitary", "one two three four five six seven", "x y"]
    docs = [prose(rng, 40), prose(rng, 5) + " Seldom, seen phrase! " + prose(rng, 3), "seldom seen", "the solitary", "one two three four five six eight", "one two three four five six seven", "seldom phrase seen", None, "x z y"]
    tests = spark.createDataFrame(list(enumerate(items)) + [(9, ""), (10, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["matched"]) for r in contaminated(brute.frame(spark, docs), tests).collect()}
    assert got == {(1, 0, 3), (3, 1, 1), (5, 2, 7)}


def test_clean_rows_without_own_ids_stay(spark):
    """Each row is judged by its own text, also where ids are null or shared; a very long text is searched whole."""
    rng = random.Random(17)
    item = prose(rng, 30)
    long = prose(rng, 60_000)
    rows = [(None, prose(rng, 50), 1), (None, "a " + item, 2), (None, None, 3), (4, item, 4), (4, prose(rng, 50), 5), (4, prose(rng, 50), 6), (7, long, 7), (8, long + " " + item, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    tests = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = drop_contaminated(df, tests)
    assert left.columns == df.columns and sorted(r["_id"] for r in left.collect()) == [1, 3, 5, 6, 7]


def test_hits_are_verified_above_the_projections(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    rows = keep_where(df.withColumn("n", F.size(F.split("text", " "))), F.col("n") >= 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    condition = next(x for x in plan.split("\n") if "Filter" in x)
    assert "split" not in condition and rows.count() == 1
