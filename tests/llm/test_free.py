"""Token counts, secret scan, quality classifier, and the pipeline as a whole."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from shoalsight.llm import queries, secrets, token_counts
from shoalsight.llm.quality_model import NAMES, fit, quality_scores, statistics

P = pytest.importorskip("public_tokenizers")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    alphabet = " \t\n\r\x0b\x1c\x85 　abXYZ'st're've019é漢字😀.,!?<|endoftext|>²½Ⅷ​\x00"
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "ab" * 3000, " " * 999 + "x", "hello world, it's 2024!"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    got = token_counts.token_counts(brute.frame(spark, texts).withColumn("n_tokens", F.lit(0)), P.path("byte_bpe_50k.json"), limit=50).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    assert token_counts.token_counts(brute.frame(spark, []), P.path("byte_bpe_50k.json")).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    import json

    good = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    good["model"]["merges"] = good["model"]["merges"][:5]
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": good["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": good["model"] | {"end_of_word_suffix": "</w>"}}):
        (tmp_path / "t.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError):
            token_counts.read_merges(str(tmp_path / "t.json"))
    (tmp_path / "t.json").write_text(json.dumps(good))
    assert len(token_counts.read_merges(str(tmp_path / "t.json"))[0]) == 5


def test_token_counts_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(df, P.path("byte_bpe_50k.json")).collect())
    assert got == [("1", 2), ("1", 2), ("None", 0), ("None", 1)]


def test_merge_order():
    ranks = {(b"a", b"b"): 1, (b"b", b"c"): 0, (b"bc", b"d"): 2, (b"a", b"a"): 3}
    assert [token_counts.count_merged(x, ranks) for x in (b"", b"a", b"abc", b"abcd", b"aaaa", b"aaa", b"ab")] == [0, 1, 2, 2, 2, 2, 1]


def plain_base(text):
    """Base spans by walking the text, one kind after the other."""
    out = []
    kinds = [
        ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m.group(2)) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
    ]
    for k, (name, pattern, ok) in enumerate(kinds):
        at = 0
        while m := pattern.search(text, at):
            if ok(m):
                out.append((m.start(), k, name, m.end()))
            at = m.end()
    return sorted(out)


def test_secret_scan(spark):
    rng = random.Random(4)
    bits = ["password", "PassWd", "sECRET", "token", "api_key", "APIkey", "=", " : ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL12", "deadbeef00112233", "0123456789abcdefABC", "é", "😀", "\n", " ", "abcDEF123+/x.y=", "token=secret=abcdefghijkl", "ſecret=abcdefghijkl", "toKen=0123456789ab"]
    texts = [None, "", "plain words only"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    high = "Zq8Lk2Vx9TnB4mWc7RyH1sJd"
    texts += [f"key {high} end", "id 123e4567-e89b-12d3-a456-426614174000 end", "x aaaaaaaaaaaaaaaaaaaaaaaaaaaa1 y", "see path/to/some/deep/file_name_here2 ok"]
    got = {r["doc_id"]: r for r in queries.secret_digest(secrets.scan_secrets(brute.frame(spark, texts).withColumn("spans", F.lit(1)))).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in base).encode()).hexdigest()
        assert set(f"{n}:{s}:{e}" for s, _, n, e in base) <= set(r["spans"].split(","))
    n = len(texts)
    assert got[n - 4]["spans"] == f"entropy:4:{4 + len(high)}" and [got[n - k]["n_entropy"] for k in (3, 2, 1)] == [0, 0, 0]
    assert secrets.scan_secrets(brute.frame(spark, [])).collect() == []


def plain_entropy(text, base, window=20):
    """Entropy spans by counting each window anew and looking at every base span."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m.group()
        if secrets.allowed(run) or any(s < m.end() and e > m.start() for s, e in base):
            continue
        least = 2.9 if re.fullmatch(r"[0-9a-fA-F]+", run) else 3.7 if re.fullmatch(r"[A-Za-z0-9]+", run) else 3.9
        bits = []
        for i in range(len(run) - window + 1):
            part = run[i : i + window]
            bits.append(-sum(part.count(c) / window * np.log2(part.count(c) / window) for c in set(part)))
        high = [i for i, b in enumerate(bits) if b >= least - 1e-9]
        if high:
            out.append((m.start() + high[0], m.start() + high[-1] + window))
    return out


def test_entropy_spans():
    rng = random.Random(10)
    parts = ["Zq8Lk2Vx9TnB4mWc7RyH1sJd", "deadBEEF0123456789ab", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "some_plain_name_of_things", "A+b/c=D-e_f", " ", "\n", "token=", "é", "q8", "0123-4567"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        base = [(s, e) for s, k, e in secrets.find_spans(text) if k < 3]
        assert [(s, e) for s, k, e in secrets.find_spans(text) if k == 3] == plain_entropy(text, base), text


def test_secret_scan_of_repeated_and_long_rows(spark):
    key = "Zq8Lk2Vx9TnB4mWc7RyH1sJd"
    long = f"password=abcdefghijkl {key} " * 30_000
    df = spark.createDataFrame([(1, key), (1, key), (None, key), (2, long)], "doc_id long, text string")
    rows = secrets.scan_secrets(df).collect()
    assert sorted((str(r["doc_id"]), len(r["spans"])) for r in rows) == [("1", 1), ("1", 1), ("2", 60_000), ("None", 1)]


def test_random_keys_are_not_names():
    assert secrets.entropy_spans("letters qZxLkVbTnBwmWcYRyHsJdf end", []) == [(8, 30)]
    rng = random.Random(9)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    for symbols, size in ((lower, 20), (lower.upper(), 24), (lower + lower.upper(), 20), (lower + lower.upper() + digits, 20), (lower + lower.upper() + digits + "+/", 40), (lower + lower.upper() + digits + "-_", 20)):
        keys = ["".join(rng.choice(symbols) for _ in range(size)) for _ in range(2000)]
        assert sum(map(secrets.allowed, keys)) <= 40, symbols
    for name in ("get_user_by_identifier_now", "src/main/java/com/example/service", "CustomerAccountManagerFactoryBean", "MAX_CONNECTION_POOL_SIZE_LIMIT", "path/to/some/deep/file_name_here2"):
        assert secrets.allowed(name) and secrets.entropy_spans(name, []) == []


def test_window_entropy():
    rng = random.Random(1)
    text = "".join(rng.choice("abcd1234") for _ in range(60))
    for w in (5, 20):
        for i, h in enumerate(secrets.window_entropies(text, w)):
            part = text[i : i + w]
            p = np.array([part.count(c) / w for c in set(part)])
            assert abs(h + (p * np.log2(p)).sum()) < 1e-9


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = fit(x[:800], y[:800])
    assert ((m.score(x[800:]) > 0.5) == y[800:]).mean() > 0.95

    def walk(row):
        total = m.base
        for node in m.roots:
            while m.feature[node] >= 0:
                node = m.left[node] + (row[m.feature[node]] > m.threshold[node])
            total += m.value[node]
        return 1 / (1 + np.exp(-total))

    np.testing.assert_allclose(m.score(x[:50]), [walk(r) for r in x[:50]])
    assert fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and len(statistics("")) == len(NAMES)


def test_quality_scores(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("the of and stone river light walks under green hill".split())
    good = [" ".join(word() for _ in range(rng.randint(60, 200))) + "." for _ in range(150)]
    bad = [" ".join([word()] * rng.randint(60, 200)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, ""]
    df = brute.frame(spark, texts).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(df, labels).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 30 and sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    swapped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality_scores(df, swapped).collect()} == {r["doc_id"]: r["score"] for r in got}
    assert quality_scores(brute.frame(spark, []), labels).collect() == []
    assert {r["score"] for r in quality_scores(df.limit(3), labels.limit(0)).collect()} == {0.5}


def test_quality_scores_of_repeated_rows(spark):
    """Rows that share an id: the same one is trained on, whatever the order and partitioning."""
    rng = random.Random(18)
    word = lambda: rng.choice("the of and stone river light walks under green hill".split())
    rows = [(i % 60 if i % 9 else None, " ".join(word() if i % 2 else "the" for _ in range(rng.randint(20, 90)))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    one = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted((str(r["doc_id"]), r["score"], r["held_out"]) for r in quality_scores(one, labels).collect())
    b = sorted((str(r["doc_id"]), r["score"], r["held_out"]) for r in quality_scores(one.orderBy(F.desc("text")).repartition(5), labels).collect())
    assert a == b and len(a) == 240 and not any(h for i, _, h in a if i == "None")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with every kind of case, written as the tables of the pipeline."""
    rng = random.Random(13)
    vocab = "the of and to in stone river light walks under green hill seven carry softly bright morning harbor".split()
    prose = lambda n: "\n".join(" ".join(rng.choice(vocab) + str(rng.randint(0, 99)) * (rng.random() < 0.5) for _ in range(12)) for _ in range(n // 12))
    items = [" ".join(prose(36).split()) for _ in range(5)]
    docs = [prose(rng.choice([72, 144, 288])) for _ in range(60)]
    line = "This common line is found in many documents"
    docs = [d + "\n" + line if i % 4 == 0 else d for i, d in enumerate(docs)]
    docs += [docs[1], docs[2].replace("river", "water", 1), docs[3] + "\n" + items[0], prose(120) + "\n" + items[1] + "\n" + prose(60)]
    docs += ["short", None, "", "BUY!! NOW!! " * 60, " | ".join(prose(120).split())]
    path = str(tmp_path_factory.mktemp("tables"))
    brute.frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_pipeline(spark, tables):
    """Each stage against a plain version on its own input."""
    from test_native import plain_lines

    path, texts, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage{len(outs)}.parquet")
        docs = spark.read.parquet(f"{path}/stage{len(outs)}.parquet")
        outs.append({r["doc_id"]: r for r in docs.collect()})
    good = [i for i, t in enumerate(texts) if i < 64]
    assert sorted(outs[0]) == good and all(outs[0][i]["text"] == texts[i] for i in good)
    lines = plain_lines([(i, outs[0][i]["text"]) for i in outs[0]])
    assert {i: r["text"] for i, r in outs[1].items()} == {i: lines[i][2] for i in lines} and all(r["n_chars"] == len(r["text"]) for r in outs[1].values())
    parts = brute.components([(i, r["text"]) for i, r in outs[1].items()], 5, 80)
    assert sorted(outs[2]) == sorted({c for _, c in parts.values()})
    leaky = {i for i, r in outs[2].items() if any(x in " ".join(r["text"].split()) for x in items)}
    assert leaky and sorted(outs[3]) == sorted(set(outs[2]) - leaky)
    assert all(list(r.asDict()) == columns for k in range(4) for r in outs[k].values())
    assert set(outs[4]) <= set(outs[3]) and all(r["taken"] > 0 for r in outs[4].values())
    whole = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {i: r["taken"] for i, r in outs[4].items()}


def test_pipeline_odd_rows(spark, tables, tmp_path):
    """Null and shared ids: a row goes for its own text alone. Empty tables give empty results."""
    _, docs, items = tables
    clean = [docs[k] for k in (5, 6, 7, 9, 10)]
    rows = [(None, clean[0]), (None, clean[1] + "\n" + items[2]), (7, clean[2]), (7, clean[3] + "\n" + items[3]), (7, clean[4]), (8, clean[2]), (8, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], brute.SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted([("None", clean[0]), ("7", clean[2]), ("7", clean[4])])
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_entry_lists_the_queries():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in q} and "pipeline" in q and set(s) <= set(q)
