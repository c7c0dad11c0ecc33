"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct k-word shingles (one shingle of all its words where it has fewer); two documents
link when their sets' Jaccard similarity is ``percent`` / 100 or more. Documents with equal sets form one class, a vertex
named by the sets' signature; a component is named by the least doc_id of its classes. Then

1. Tokens are ordered from rare to frequent by a fixed-size table of corpus counts (any fixed order is exact; this one
   keeps common passages out of the prefixes). A set linked with another shares a token with it among the first
   ``n - ceil(percent * n / 100) + 1`` of both, its prefix.
2. Similar classes are partitioned into groups of about ``group`` members by a minimum of permuted token hashes; large
   buckets are cut by hash, and each part gets the bucket's least member as a pivot. Pairs inside a group are compared
   at once by a token x member matrix, which already joins most copies of one text. This is done for ``rounds``
   permutations; a bucket that is one component already is not opened again.
3. The token-group matrix has a row (token, group) for each prefix token in the union of a group. Its self-join, with
   length and position bounds, gives the group pairs that can hold a link between different components. In an opened
   pair, each query's overlap with the other group's token union bounds its similarity; members are compared only
   where the bound allows it, and exactly, on whole sets.

Before whole sets are moved for a group or a pair of groups, parity bitmaps of about one bit a token (each token flips
one bit) are compared: two sets differ in at least as many tokens as their bitmaps in bits, so members without any
possible partner are left behind. This bound never loses a link.

Links inside one component are not enumerated, links between different texts are never lost. Nothing is capped: all
groups stay bounded because buckets are split, not cut short. Tokens are 64-bit hashes.

Defined results: null and empty texts have no shingles and link with nothing; rows with a null doc_id take part in
nothing and have a null component; rows that share a doc_id are documents of their own, each linked by its own text.
Texts of any length are taken whole; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .bloom import Bloom, bloom_of
from .common import written
from .rolling import FOLD, Rolling, mix, word_bounds, word_values

_NULL = -(2**63)
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0), np.uint64(0x082EFA98EC4E6C89))


@dataclass(frozen=True)
class Join:
    k: int = 5
    percent: int = 80
    group: int = 256
    rounds: int = 2
    visitors: int = 2048
    salted: int = 256
    buckets: int = 1 << 18
    max_bits: int = 1 << 28

    def need(self, n):
        """Tokens of a set of n that a linked set must share."""
        return -(-self.percent * n // 100)


def shingle_set(raw: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the shingles of a text given as bytes, A-Z lower-cased."""
    raw = FOLD[raw]
    v = word_values(raw, *word_bounds(raw))
    if len(v) >= k:
        return np.unique(Rolling(v).all(k))
    return Rolling(v).of(np.array([0]), np.array([len(v)])) if len(v) else np.zeros(0, np.uint64)


def _texts(batches, k: int, wanted: Bloom | None = None):
    """(id, hash of the text, shingle set) of rows (id, text, hash of id, hash of text); with ``wanted`` only of ids that it has."""
    for batch in batches:
        ids, ths = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        some = np.flatnonzero(wanted.has(batch.column(2).to_numpy())) if wanted else range(batch.num_rows)
        texts = batch.column(1)
        for i in some:
            buf = texts[i].as_buffer() if texts[i].is_valid else b""
            yield int(ids[i]), int(ths[i]), shingle_set(np.frombuffer(buf, np.uint8) if len(buf) else np.zeros(0, np.uint8), k)


def _signature(h: np.ndarray) -> tuple[int, int]:
    a, b = mix(h ^ _SEEDS[2]).sum(dtype=np.uint64), mix(h ^ _SEEDS[3]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def parity_map(h: np.ndarray) -> bytes:
    bits = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    flips = np.bincount(((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _possible(spec: Join, maps: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: whether the sets may link, by their sizes and parity maps."""
    out = np.zeros((len(left), len(right)), bool)
    size = np.array([len(m) for m in maps])
    for a in np.unique(size[left]):
        for b in np.unique(size[right]):
            if 200 * min(a, b) <= spec.percent * max(a, b):
                continue  # sizes differ too much to link: the smaller set has under 2 * min / max of the larger one's tokens
            i, j = np.flatnonzero(size[left] == a), np.flatnonzero(size[right] == b)
            words = []
            for rows in (left[i], right[j]):
                m = np.frombuffer(b"".join(maps[x] for x in rows), np.uint64).reshape(len(rows), -1)
                while m.shape[1] > min(a, b) // 8:
                    half = m.shape[1] // 2
                    m = m[:, :half] ^ m[:, half:]
                words.append(m)
            total = n[left[i]][:, None] + n[right[j]][None, :]
            most = (100 - spec.percent) * total // (100 + spec.percent)
            for s in range(0, len(i), 64):
                differ = np.bitwise_count(words[0][s : s + 64, None, :] ^ words[1][None, :, :]).sum(axis=2, dtype=np.int64)
                out[np.ix_(i[s : s + 64], j)] = differ <= most[s : s + 64]
    return out


def _profiles(spec: Join):
    """A row for each document: n, signatures, permuted minima, parity map; and rows (bucket, count) of its tokens."""
    names = ["id", "th", "n", "s1", "s2", *[f"m{r}" for r in range(spec.rounds)], "map", "bucket", "count"]

    def rows(held):
        *cols, maps = list(zip(*held, strict=True)) if held else [[] for _ in range(6 + spec.rounds)]
        none = pa.nulls(len(held), pa.int64())
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(maps, pa.binary()), none, none], names)

    def run(batches):
        counts, held = np.zeros(spec.buckets, np.int64), []
        for id_, th, h in _texts(batches, spec.k):
            if len(h):
                np.add.at(counts, (h & np.uint64(spec.buckets - 1)).astype(np.int64), 1)
                minima = [int(mix(h ^ _SEEDS[r]).min().astype(np.int64)) for r in range(spec.rounds)]
            else:
                minima = [0] * spec.rounds
            held.append((id_, th, len(h), *_signature(h), *minima, parity_map(h)))
            if len(held) >= 2000:
                yield rows(held)
                held = []
        yield rows(held)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * (5 + spec.rounds) + [pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at])], names)

    return run, ", ".join(f"{x} binary" if x == "map" else f"{x} long" for x in names)


def _prefixes(spec: Join, counts):
    """s1, n and the prefix tokens, rarest first; a task sends a set that it remembers once."""

    def run(batches):
        often, seen = counts.value, set()
        s, n, tokens = [], [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], ["s1", "n", "tokens"])

        for *_, h in _texts(batches, spec.k):
            if not len(h) or (sig := _signature(h)[0]) in seen:
                continue
            if len(seen) >= 500_000:  # only spares work: what is sent twice is aggregated below
                seen.clear()
            seen.add(sig)
            order = np.lexsort((h, often[(h & np.uint64(spec.buckets - 1)).astype(np.int64)]))
            s.append(sig), n.append(len(h)), tokens.append(h[order[: len(h) - spec.need(len(h)) + 1]].tobytes())
            if len(s) >= 1000:
                yield flush()
                s, n, tokens = [], [], []
        if s:
            yield flush()

    return run


def _opened(shared):
    """The tokens of prefixes as rows (t, s1, n, pos); with ``shared`` only those that it has."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)])
            row = np.repeat(np.arange(batch.num_rows), size)
            pos = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(shared.value.has(t)) if shared else np.arange(len(t))
            s, n = (batch.column(c).to_numpy()[row[at]] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(t[at].view(np.int64)), pa.array(s), pa.array(n), pa.array(pos[at])], ["t", "s1", "n", "pos"])

    return run


def _whole_sets(spec: Join, wanted):
    def run(batches):
        i, s, data = [], [], []
        for id_, _, h in _texts(batches, spec.k, wanted.value):
            i.append(id_), s.append(_signature(h)[0]), data.append(h.tobytes())
            if len(i) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(data, pa.binary())], ["rep", "s1", "tokens"])
                i, s, data = [], [], []
        if i:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(data, pa.binary())], ["rep", "s1", "tokens"])

    return run


def _streamed(batches, n_keys: int):
    """Tables of whole groups from rows sorted by the first ``n_keys`` columns."""
    kept: list[pa.RecordBatch] = []
    key = lambda b, i: tuple(b.column(c)[i].as_py() for c in range(n_keys))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if kept and key(kept[0], 0) != key(part, 0):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(part)
    if kept:
        yield pa.Table.from_batches(kept)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], cells: int = 32_000_000) -> np.ndarray:
    """Sizes of all intersections between two lists of sets: the token x member matrices multiplied, by blocks of
    members that keep the matrix under ``cells`` entries."""
    m = np.zeros((len(left), len(right)), np.int64)
    s = 0
    while s < len(right):
        e, tokens = s, 0
        while e < len(right) and (e == s or (tokens + len(right[e])) * (e + 1 - s) <= cells):
            tokens += len(right[e])
            e += 1
        union = np.unique(np.concatenate(right[s:e]))
        other = np.zeros((len(union), e - s), np.uint8)
        for j, x in enumerate(right[s:e]):
            other[np.searchsorted(union, x), j] = 1
        for i, x in enumerate(left):
            at = np.searchsorted(union, x)
            at[at == len(union)] = 0
            m[i, s:e] = other[at[union[at] == x]].sum(axis=0, dtype=np.int64)
        s = e
    return m


def _linked(o: np.ndarray, nl: np.ndarray, nr: np.ndarray, percent: int) -> np.ndarray:
    return 100 * o >= percent * (nl[:, None] + nr[None, :] - o)


_EDGES = "src long, dst long"


def _edge_batch(src: list[int], dst: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _survivors(spec: Join, keys: list[str]):
    """Members of groups that may link with another member (with one of the other side). Rows: two keys, side, rep, s1,
    comp, n, map; side is 0 or 1, or null where members of one group are compared with each other."""

    def run(batches):
        for table in _streamed(batches, 2):
            side = table["side"].to_numpy(zero_copy_only=False)
            n, maps, comp = table["n"].to_numpy(), table["map"].to_pylist(), table["comp"].to_numpy()
            alone = table["side"].null_count > 0
            a = np.arange(len(n)) if alone else np.flatnonzero(side == 0)
            b = a if alone else np.flatnonzero(side == 1)
            able = _possible(spec, maps, n, a, b) & (comp[a][:, None] != comp[b][None, :])
            keep = np.zeros(len(n), bool)
            keep[a] |= able.any(axis=1)
            keep[b] |= able.any(axis=0)
            if keep.any():
                kept = table.select([*keys, "side", "rep", "s1", "comp"]).filter(pa.array(keep)).combine_chunks()
                yield from kept.to_batches()

    return run


def _open(spec: Join, docs: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The surviving members of ``rows`` with their whole sets, sorted by the two keys."""
    rows = rows.select(*keys, F.col("side").cast("int").alias("side"), "rep", "s1", "comp", "n", "map").repartition(*keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{k} long" for k in keys) + ", side int, rep long, s1 long, comp long"
    members = written(rows.mapInArrow(_survivors(spec, keys), schema), "survivors")
    sets = _sets_of(spec, docs, members.select("rep", "s1").distinct())
    return members.join(sets, ["rep", "s1"]).select(*keys, "side", "s1", "comp", "tokens").repartition(*keys).sortWithinPartitions(*keys)


def _inside(spec: Join):
    """Links inside groups. Rows: bucket, part, side, s1, comp, tokens."""

    def run(batches):
        for table in _streamed(batches, 2):
            sig = table["s1"].to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
            n = np.array([len(x) for x in sets])
            i, j = np.nonzero(np.triu(_linked(_overlaps(sets, sets), n, n, spec.percent), 1))
            if len(i):
                yield _edge_batch([sig[x] for x in i], [sig[x] for x in j])

    return run


def _between(spec: Join):
    """Links between queries (side 0) and the members (side 1) of their host. Rows: host, part, side, s1, comp, tokens."""

    def run(batches):
        for table in _streamed(batches, 2):
            side, comp = table["side"].to_numpy(zero_copy_only=False), table["comp"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
            queries, members = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(queries) or not len(members):
                continue
            union = np.unique(np.concatenate([sets[m] for m in members]))
            bound = lambda x: np.isin(x, union, assume_unique=True).sum()
            queries = np.array([q for q in queries if bound(sets[q]) >= spec.need(len(sets[q]))], int)
            if not len(queries):
                continue
            nq, nm = (np.array([len(sets[x]) for x in part]) for part in (queries, members))
            i, j = np.nonzero(_linked(_overlaps([sets[q] for q in queries], [sets[m] for m in members]), nq, nm, spec.percent))
            pairs = {(int(comp[queries[a]]), int(comp[members[b]])) for a, b in zip(i, j, strict=True)}
            pairs = [p for p in pairs if p[0] != p[1]]
            if pairs:
                yield _edge_batch([p[0] for p in pairs], [p[1] for p in pairs])

    return run


def _sets_of(spec: Join, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, s1, tokens of the classes in ``reps`` (rep, s1, distinct)."""
    reps = written(reps, "wanted")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(reps.select(F.xxhash64("rep").alias("h")), "h", reps.count()))
    found = docs.mapInArrow(_whole_sets(spec, wanted), "rep long, s1 long, tokens binary")
    return found.join(reps, ["rep", "s1"], "left_semi").dropDuplicates(["rep", "s1"])


def _labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return classes.withColumn("comp", F.col("s1"))
    found = labels.select(F.col("id").alias("s1"), "component")
    return classes.join(found, "s1", "left").withColumn("comp", F.coalesce("component", "s1")).drop("component")


def _parts(spec: Join, r: int):
    return F.pmod(F.xxhash64("s1", F.lit(r)), F.col("parts"))


def _round(spec: Join, docs: DataFrame, classes: DataFrame, r: int) -> DataFrame:
    """Links inside the groups of permutation r."""
    parts = F.ceil(F.count(F.lit(1)) / spec.group)
    buckets = (
        classes.groupBy(F.col(f"m{r}").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("size"), parts.alias("parts"), F.min(F.struct("s1", "rep", "comp", "n", "map")).alias("pivot"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        .filter("size > 1 and c0 <> c1")
        .select("bucket", "parts", "pivot")
    )
    wide = ["rep", "s1", "comp", "n", "map"]
    members = classes.withColumnRenamed(f"m{r}", "bucket").join(buckets, "bucket").select("bucket", _parts(spec, r).alias("part"), *wide)
    pivots = buckets.filter("parts > 1").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *[f"pivot.{c}" for c in wide])
    members = members.union(pivots).dropDuplicates(["bucket", "part", "rep", "s1"]).withColumn("side", F.lit(None))
    return _open(spec, docs, members, ["bucket", "part"]).mapInArrow(_inside(spec), _EDGES)


def _group_pairs(spec: Join, docs: DataFrame, groups: DataFrame, counts) -> DataFrame:
    """g1 < g2: groups that may hold a link between different components. ``groups``: g, rep, s1, n, comp, map."""
    prefixes = written(docs.mapInArrow(_prefixes(spec, counts), "s1 long, n long, tokens binary"), "prefixes")
    schema = "t long, s1 long, n long, pos long"
    shared = prefixes.mapInArrow(_opened(None), schema).groupBy("t").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a <> b").select("t")
    shared = written(shared, "shared-tokens")
    n = shared.count()
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(shared, "t", n, max_bits=spec.max_bits))
    postings = prefixes.mapInArrow(_opened(bloom), schema)
    if 16 * n > spec.max_bits:  # the bitmap lets too much through
        postings = postings.join(shared, "t", "left_semi")
    postings = postings.join(groups.select("s1", "g", "comp"), "s1")
    matrix = postings.groupBy("t", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )
    matrix = written(matrix, "matrix")
    # A token of many groups is dealt to ``salts`` tasks: one side by salt, the other once for each.
    salts = F.ceil(F.count(F.lit(1)) / spec.salted).cast("int").alias("salts")
    mixed = matrix.groupBy("t").agg(F.min("c0").alias("a"), F.max("c1").alias("b"), salts).filter("a <> b").select("t", "salts")
    matrix = written(matrix.join(mixed, "t"), "mixed-matrix")
    wide = ("g", "lo", "hi", "rest", "c0", "c1")
    a = matrix.select("t", F.pmod(F.xxhash64("g"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_1") for c in wide])
    b = matrix.select("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_2") for c in wide])
    p = spec.percent
    least = F.ceil(p * (F.col("lo_1") + F.col("lo_2")) / (100 + p) - F.lit(1e-9))
    return (
        a.join(b, ["t", "salt"])
        .filter("g_1 < g_2 and (c0_1 <> c1_1 or c0_2 <> c1_2 or c0_1 <> c0_2)")
        .filter((100 * F.col("hi_2") >= p * F.col("lo_1")) & (100 * F.col("hi_1") >= p * F.col("lo_2")) & (F.least("rest_1", "rest_2") >= least))
        .select(F.col("g_1").alias("g1"), F.col("g_2").alias("g2"))
        .distinct()
    )


def _hosted(spec: Join, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries (side 0) and members (side 1) by host group and part. The smaller group of a pair visits the larger one, the
    host, whose members are there once for each part of about ``visitors`` queries."""
    sizes = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    size = lambda n: sizes.select(F.col("g").alias(f"g{n}"), F.col("size").alias(f"size{n}"))
    first = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("g1") < F.col("g2")))
    routes = pairs.join(size(1), "g1").join(size(2), "g2").select(
        F.when(first, F.col("g1")).otherwise(F.col("g2")).alias("guest"), F.when(first, F.col("g2")).otherwise(F.col("g1")).alias("host"), F.least("size1", "size2").alias("size")
    )
    routes = written(routes, "routes")
    load = routes.groupBy("host").agg(F.ceil(F.sum("size") / spec.visitors).alias("parts"))
    wide = ["rep", "s1", "comp", "n", "map"]
    guests = routes.join(load, "host").join(groups, F.col("guest") == groups["g"]).select("host", _parts(spec, 9).alias("part"), F.lit(0).alias("side"), *wide)
    members = groups.join(load, groups["g"] == F.col("host")).select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), *wide)
    return guests.unionByName(members)


def _components(docs: DataFrame, spec: Join) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, s1, s2) of all documents, id null as _NULL and th the hash of the text; and (s1, s2, n, comp, least)
    of the classes: the component's name and its least id."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), "text")
    base = base.withColumns({"h": F.xxhash64("id"), "th": F.xxhash64("text")})
    run, schema = _profiles(spec)
    profiles = written(base.mapInArrow(run, schema), "profiles")
    table = profiles.filter("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    often = np.zeros(spec.buckets, np.int64)
    often[table["bucket"].to_numpy()] = table["count"].to_numpy()
    counts = docs.sparkSession.sparkContext.broadcast(often)
    rows = profiles.filter("bucket is null")
    minima = [f"m{r}" for r in range(spec.rounds)]
    classes = rows.filter(f"n > 0 and id <> {_NULL}").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), *[F.min(m).alias(m) for m in [*minima, "map"]])
    classes = written(classes, "classes")
    edges = labels = None
    for r in range(spec.rounds):
        found = _round(spec, base, _labelled(classes, labels), r)
        edges = written(found if edges is None else edges.union(found), "links")
        labels = written(connected_components(edges), "labels")
    sizes = classes.groupBy("m0").agg(F.ceil(F.count(F.lit(1)) / spec.group).alias("parts"))
    groups = _labelled(classes, labels).join(sizes, "m0").select(F.xxhash64("m0", _parts(spec, 0)).alias("g"), "rep", "s1", "n", "comp", "map")
    groups = written(groups, "groups")
    pairs = written(_group_pairs(spec, base, groups, counts), "group-pairs")
    opened = _open(spec, base, _hosted(spec, groups, pairs), ["host", "part"])
    more = opened.mapInArrow(_between(spec), _EDGES)
    labels = written(connected_components(edges.union(more)), "labels")
    named = _labelled(classes, labels)
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    # Written, so that Spark sees two plain shuffles below the join and can split the copies of one text.
    named = written(named.select("s1", "s2", "n", "comp").join(least, "comp"), "names")
    return rows.select("id", "th", "n", "s1", "s2"), named


def jaccard_components(docs: DataFrame, spec: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs`` (doc_id, text)."""
    rows, named = _components(docs, spec)
    out = rows.join(named, ["s1", "s2", "n"], "left")
    own = F.when(F.col("id") != _NULL, F.col("id"))
    component = F.when(F.col("id") != _NULL, F.coalesce("least", "id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, spec: Join = Join()) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id (of rows that share it, the one whose
    text's hash is least; of rows equal in both, one). Rows with a null doc_id and texts without words stay."""
    rows, named = _components(docs, spec)
    rows = rows.filter(f"id <> {_NULL} and n > 0").groupBy("id", "th", "n", "s1", "s2").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.join(named.drop("least"), ["s1", "s2", "n"]).select("id", "th", "comp", "copies"), "kept-or-not")
    first = rows.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("first"))
    judged = rows.join(first, "comp").withColumn("gone", F.struct("id", "th") != F.col("first"))
    judged = written(judged.filter("gone or copies > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th"), "gone"), "gone")
    keyed = docs.withColumns({"_kid": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), "_kth": F.xxhash64("text")})
    at = lambda df: (F.col("_kid") == df["_id"]) & (F.col("_kth") == df["_th"])
    gone, again = judged.filter("gone"), judged.filter("not gone")
    kept = keyed.join(gone, at(gone), "left_anti")
    if not again.isEmpty():
        # Rows equal in doc_id and text are aggregated, not listed, however many they are.
        all_ = F.struct(*docs.columns)
        one = kept.join(again, at(again), "left_semi").groupBy("_kid", "_kth").agg(F.min_by(all_, F.xxhash64(*docs.columns)).alias("_row"))
        kept = kept.join(again, at(again), "left_anti").select(*docs.columns).unionByName(one.select("_row.*"))
    return kept.select(*docs.columns)
