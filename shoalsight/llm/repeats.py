"""Finds every window of W values (bytes or words) that repeats in a corpus, and removes what such windows cover.

Prefix doubling over content-chosen positions. A window's anchor is its k-gram of least hash (``rolling.anchors``), which
depends on the window's content alone, so a repeated window has equal anchors at equal offsets, and only anchors, one
position for about (W - k) / 2 values, enter:

1. Rank k. Grams are counted over the corpus; an anchor whose gram occurs once is unique and drops out (a bitmap of
   bounded size carries the repeated grams to the next pass over the texts).
2. Ranks at growing offsets. What an anchor's windows cover to its right has the lengths k, 2k, 4k ... W, to its left
   k, 2k, ... W - k. The rank of 2L values from an anchor on is the rank of the pair (rank of its first L values, rank of
   the L values that follow). At each level Spark groups the pairs of the anchors that are left, and a pair that no other
   context shares is unique: the windows that reach that far drop out, and with its last window an anchor. Only pairs that
   repeat at L are ranked at 2L, until all are unique or the length is past W.
3. Contexts. Anchors with equal rank over all that their windows cover settle all these windows at once.
4. Windows. Where the contexts of one gram differ, the windows left by step 2, repeated at the last length on both sides,
   are ranked one by one by all W values: anchors are sorted by gram with what they cover, and a task streams through
   whole grams; grams with more than ``hot`` anchors send each window's hash as a row of its own, so no task holds such
   a group.

In all passes, equal pairs are first collapsed where the texts are read, so a passage in a third of all documents
sends a few rows for each task. Nothing is sampled or capped. Memory of a task is bounded by one batch of documents
plus ``hot`` anchors. Bitmaps have at most ``max_bits`` bits; where more grams than they tell apart are to be opened, the
anchors to open are listed by a join instead (``_listed``).

Ranks are named by hashes, not by places in a sorted list. Equality is that of 64-bit hashes twice over (gram and context
or window); ranks at growing offsets are 32-bit hashes beside the gram's 64 bits, and a chance collision among them only
leaves a window to step 4. Earlier means smaller doc_id, then start; a null doc_id is smaller than all, and rows that
share a doc_id are ordered by a hash of their text. Where the first stays, rows equal in both count as one document, so
all of them get the result of one; otherwise each row counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import written
from .rolling import Anchors, Rolling, anchors, byte_values, mix, word_bounds, word_values

_NULL = -(2**63)
_FLUSH = 250_000


@dataclass(frozen=True)
class Spec:
    unit: str  # "bytes" or "words"
    window: int
    gram: int
    first_stays: bool  # whether the earliest occurrence is left alone
    hot: int = 16_384
    max_bits: int = 1 << 28

    @property
    def levels(self) -> list[tuple[tuple[int, int] | None, tuple[int, int] | None]]:
        """For each doubling the values that it adds to the right and to the left of an anchor, as (length before, after)."""

        def steps(start: int, grown: int, limit: int) -> list[tuple[int, int]]:
            out = []
            while start < limit:
                out.append((start, min(grown, limit)))
                start, grown = out[-1][1], 2 * out[-1][1]
            return out

        return list(zip_longest(steps(self.gram, 2 * self.gram, self.window), steps(0, self.gram, self.window - self.gram)))


def _ranks(spec: Spec, found: Anchors, rows: np.ndarray) -> np.ndarray:
    """(row, level, side): rank at each length, as 32-bit names; 0 where no window of the anchor reaches that far."""
    out = np.zeros((len(rows), len(spec.levels), 2), np.uint32)
    offset = found.offset[rows]
    reach = (spec.window - (offset - found.count[rows] + 1), offset)
    for side in (0, 1):
        rank = found.gram[rows]
        for level, steps in enumerate(spec.levels):
            if steps[side] is None:
                break
            start, end = steps[side]
            at = np.flatnonzero(reach[side] >= end)
            piece = found.piece(rows[at], start, end) if side == 0 else found.piece(rows[at], -end, -start)
            rank[at] = mix(rank[at] * np.uint64(3) + piece)
            out[at, level, side] = np.maximum(rank[at] >> np.uint64(32), 1)
    return out


def _pairs(grams: np.ndarray, names: np.ndarray, level: int, side: int) -> np.ndarray:
    return mix(grams ^ mix(names.astype(np.uint64) + np.uint64((2 * level + side + 1) << 40)))


def _left(spec: Spec, repeated: list[Bloom], found: Anchors, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of the anchor in the windows that are repeated at every length they reach."""
    high = found.offset[rows]
    low = high - found.count[rows] + 1
    names = _ranks(spec, found, rows)
    for side in (0, 1):
        on = np.ones(len(rows), bool)
        for level, bloom in enumerate(repeated):
            on &= names[:, level, side] > 0
            unique = on.copy()
            unique[on] = ~bloom.has(_pairs(found.gram[rows[on]], names[on, level, side], level, side))
            on &= ~unique
            if side == 0 and unique.any():
                low = np.where(unique, np.maximum(low, spec.window - spec.levels[level][0][1] + 1), low)
            elif unique.any():
                high = np.where(unique, np.minimum(high, spec.levels[level][1][1] - 1), high)
    return low, high


@dataclass
class _Docs:
    """Neighbouring documents of a batch, from ``row`` on: their values end to end, document d from base[d] to base[d + 1]."""

    row: int
    ids: np.ndarray
    ths: np.ndarray
    base: np.ndarray
    values: np.ndarray

    def anchors(self, spec: Spec):
        return anchors(self.values, spec.window, spec.gram, byte_values if spec.unit == "bytes" else lambda part: part, self.base)

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base[1:], p, side="right")

    def places(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, th and the place inside its document of each value."""
        d = self.of(p)
        return self.ids[d], self.ths[d], p - self.base[d]


#: Bytes of short documents that are handled at once.
BLOCK = 1 << 15


def _documents(spec: Spec, batches):
    """Rows (id, th, text) as _Docs; a document longer than BLOCK is alone."""
    for batch in batches:
        texts = batch.column(2).fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        i = 0
        while i < len(texts):
            j = max(int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1, i + 1)
            if spec.unit == "bytes":
                values, base = data[at[i] : at[j]], at[i : j + 1] - at[i]
            else:
                raw = np.frombuffer(b"\n".join([data[a:b] for a, b in zip(at[i:j], at[i + 1 : j + 1], strict=True)]), np.uint8)
                start, end = word_bounds(raw)
                values = word_values(raw, start, end)
                base = np.searchsorted(start, at[i : j + 1] - at[i] + np.arange(j - i + 1))
                base[-1] = len(start)
            yield _Docs(i, ids[i:j], ths[i:j], base, values)
            i = j


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first two keys, then the rest; and the number of the group of the first two for each row in order."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1


def _after_first(order: np.ndarray, first: np.ndarray, group: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether each row, in order, is elsewhere than the first of its group; equal rows of one document are at one place."""
    lead = order[first][group]
    return np.logical_or.reduce([x[order] != x[lead] for x in place])


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges overlapping or touching runs of each document; doc: small integers."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * far)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + doc[1:] * far > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - doc[first] * far


_OUT = "a long, c long, id long, th long, p long, n int, q int, cnt long, data binary"


def _batch(**columns) -> pa.RecordBatch:
    """Missing columns are null; uint64 hashes become int64 bit by bit."""
    kinds = dict(a=pa.int64(), c=pa.int64(), id=pa.int64(), th=pa.int64(), p=pa.int64(), n=pa.int32(), q=pa.int32(), cnt=pa.int64(), data=pa.binary())
    size = len(columns["p"])
    arrays = []
    for name, kind in kinds.items():
        v = columns.get(name)
        if isinstance(v, np.ndarray) and v.dtype == np.uint64:
            v = v.view(np.int64)
        arrays.append(pa.nulls(size, kind) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kind))
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


def _runs(ids: np.ndarray, ths: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows without ``a``: the run from p, of n values."""
    keys, doc = np.unique(np.stack([ids, ths], 1), axis=0, return_inverse=True)
    doc, start, end = _union(doc.ravel(), start, end)
    return _batch(id=keys[doc, 0], th=keys[doc, 1], p=start, n=(end - start).astype(np.int32))


class _Pending:
    """Anchors of a batch of documents, before equal ones are collapsed."""

    def __init__(self, spec: Spec):
        self.spec, self.parts, self.data, self.size = spec, [], [], 0

    def add(self, docs: _Docs, g, c, p, n, q, data=None) -> None:
        """``data``: a list of bytes, or an array with a row for each anchor."""
        ids, ths, p = docs.places(p)
        self.parts.append((g, c, ids, ths, p, n, q))
        if isinstance(data, np.ndarray):
            self.data.append(data)
        elif data is not None:
            self.data += data
        self.size += len(g)

    def _picked(self, data: list, rows: np.ndarray):
        if not data:
            return None
        return _binary(np.concatenate(data)[rows]) if isinstance(data[0], np.ndarray) else [data[x] for x in rows]

    def flush(self):
        """First of each (gram, context) with their number; then the runs that are settled here."""
        if not self.size:
            return
        w = self.spec.window
        g, c, i, t, p, n, q = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        data = self.data
        self.parts, self.data, self.size = [], [], 0
        order, group = _groups(g, c, i, t, p)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(first, len(group)))
        gone = _after_first(order, first, group, i, t, p) if self.spec.first_stays else (count > 1)[group]
        f = order[first]
        yield _batch(a=g[f], c=c[f], id=i[f], th=t[f], p=p[f], n=n[f].astype(np.int32), q=q[f].astype(np.int32), cnt=count, data=self._picked(data, f))
        if gone.any():
            o = order[gone]
            yield _runs(i[o], t[o], p[o], p[o] + n[o] - 1 + w)


def _gram_counts(spec: Spec):
    def run(batches):
        held, size = [], 0

        def flush():
            a, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["a", "n"])

        for docs in _documents(spec, batches):
            for found in docs.anchors(spec):
                held.append(found.gram)
                size += len(found.gram)
            if size >= 2 * _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as its bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _context_ranks(spec: Spec, repeated):
    """Anchors of repeated grams with their contexts; ``data``: their ranks at growing offsets."""

    def run(batches):
        known: Bloom = repeated.value
        pending = _Pending(spec)
        for docs in _documents(spec, batches):
            for found in docs.anchors(spec):
                at = np.flatnonzero(known.has(found.gram))
                if len(at):
                    pending.add(docs, *(x[at] for x in found), _ranks(spec, found, at).reshape(len(at), -1))
            if pending.size >= _FLUSH:
                yield from pending.flush()
        yield from pending.flush()

    return run


def _level_pairs(spec: Spec, level: int, before):
    """Pairs at one level of the anchors whose pairs repeat at all levels before: a (the pair), lo, hi (contexts)."""

    def run(batches):
        repeated: list[Bloom] = [b.value for b in before]
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, contexts = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            names = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(grams), len(spec.levels), 2)
            pairs, held = [], []
            for side in (0, 1):
                at = np.flatnonzero(names[:, level, side])
                for k, bloom in enumerate(repeated):
                    at = at[bloom.has(_pairs(grams[at], names[at, k, side], k, side))]
                pairs.append(_pairs(grams[at], names[at, level, side], level, side))
                held.append(contexts[at].view(np.int64))
            pair, context = np.concatenate(pairs), np.concatenate(held)
            if not len(pair):
                continue
            order = np.lexsort((context, pair))
            pair, context = pair[order], context[order]
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            last = np.append(first[1:], len(pair)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(pair[first].view(np.int64)), pa.array(context[first]), pa.array(context[last])], ["a", "lo", "hi"])

    return run


def _covered(spec: Spec, values: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each run of n windows from p on: the bytes that they cover, or the hashes of the windows of words."""
    if spec.unit == "bytes":
        return [values[x : x + m - 1 + spec.window].tobytes() for x, m in zip(p, n, strict=True)]
    a = int(p.min())
    h = Rolling(values[a : int((p + n).max()) - 1 + spec.window]).all(spec.window)
    return [h[x - a : x - a + m].tobytes() for x, m in zip(p, n, strict=True)]


def _singles(spec: Spec, values: np.ndarray, g, p, n, q):
    """Windows of anchors one by one: gram, rank, place, 1, offset, and the anchor's row."""
    row = np.repeat(np.arange(len(g)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, offset = p[row] + k, q[row] - k
    h = Rolling(byte_values(values) if spec.unit == "bytes" else values).of(at, at + spec.window)
    return g[row], mix(h + offset.astype(np.int64).view(np.uint64)), at, np.ones(len(row), np.int64), offset, row


def _open(spec: Spec, repeated: list[Bloom], found: Anchors, at: np.ndarray):
    """The rows of ``at`` with windows left, and their gram, context, first window, windows and offset."""
    low, high = _left(spec, repeated, found, at)
    keep = low <= high
    at, low, high = at[keep], low[keep], high[keep]
    return at, found.gram[at], found.context[at], found.first[at] + found.offset[at] - high, high - low + 1, high


def _open_contexts(spec: Spec, levels, several, hot):
    """Anchors of grams with several contexts, with what their windows cover that are left after all levels; windows of hot
    grams as rows of their own."""

    def run(batches):
        some, many, repeated = several.value, hot.value, [b.value for b in levels]
        pending, single = _Pending(spec), _Pending(spec)
        for docs in _documents(spec, batches):
            for found in docs.anchors(spec):
                big = many.has(found.gram)
                at = np.flatnonzero(big | some.has(found.gram))
                at, g, c, p, n, q = _open(spec, repeated, found, at)
                few, lots = np.flatnonzero(~big[at]), np.flatnonzero(big[at])
                if len(few):
                    pending.add(docs, g[few], c[few], p[few], n[few], q[few], _covered(spec, docs.values, p[few], n[few]))
                if len(lots):
                    single.add(docs, *_singles(spec, docs.values, g[lots], p[lots], n[lots], q[lots])[:5])
            if pending.size >= _FLUSH // 4:
                yield from pending.flush()
            if single.size >= _FLUSH:
                yield from single.flush()
        yield from pending.flush()
        yield from single.flush()

    return run


def _open_listed(spec: Spec, levels):
    """The same for documents that come with the anchors to open: id, th, text, todo (a, c, p, cnt, big). The windows of hot
    grams are rows of their own with ``data`` null."""

    def run(batches):
        repeated = [b.value for b in levels]
        for batch in batches:
            todo = batch.column("todo")
            row = np.repeat(np.arange(len(todo)), todo.value_lengths().to_numpy())
            key = (row << 40) + todo.flatten().field("p").to_numpy()
            key, order = np.unique(key, return_index=True)
            counts = todo.flatten().field("cnt").to_numpy()[order]
            hot = todo.flatten().field("big").to_numpy(zero_copy_only=False)[order]
            for docs in _documents(spec, [batch]):
                for found in docs.anchors(spec):
                    d = docs.of(found.first)
                    here = ((d + docs.row) << 40) + found.first - docs.base[d]
                    of = np.minimum(np.searchsorted(key, here), max(len(key) - 1, 0))
                    at, g, c, p, n, q = _open(spec, repeated, found, np.flatnonzero(key[of] == here) if len(key) else np.zeros(0, int))
                    cnt, big = counts[of[at]], hot[of[at]]
                    few, lots = np.flatnonzero(~big), np.flatnonzero(big)
                    if len(few):
                        id_, th, at_ = docs.places(p[few])
                        yield _batch(a=g[few], c=c[few], id=id_, th=th, p=at_, n=n[few].astype(np.int32), q=q[few].astype(np.int32), cnt=cnt[few], data=_covered(spec, docs.values, p[few], n[few]))
                    if len(lots):
                        a, h, at_, one, offset, of_row = _singles(spec, docs.values, g[lots], p[lots], n[lots], q[lots])
                        id_, th, at_ = docs.places(at_)
                        yield _batch(a=a, c=h, id=id_, th=th, p=at_, n=one.astype(np.int32), q=offset.astype(np.int32), cnt=cnt[lots][of_row])

    return run


def _rank_windows(spec: Spec):
    """Rows of whole grams, sorted by gram, are opened into windows; gives the runs that repeat."""

    def settle(table: pa.Table):
        n = table["n"].to_numpy()
        data = table["data"].to_pylist()
        if spec.unit == "bytes":
            joined = np.frombuffer(b"".join(data), np.uint8)
            base = np.cumsum([0, *map(len, data)])[:-1]
            windows = np.repeat(base - np.cumsum(n) + n, n) + np.arange(n.sum())
            h = Rolling(byte_values(joined)).of(windows, windows + spec.window)
        else:
            h = np.frombuffer(b"".join(data), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a, i, t = (table[x].to_numpy()[row] for x in ("a", "id", "th"))
        p = table["p"].to_numpy()[row] + k
        h = mix(h + (table["q"].to_numpy()[row] - k).astype(np.int64).view(np.uint64))
        order, group = _groups(a, h, i, t, p)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        if spec.first_stays:
            gone = _after_first(order, first, group, i, t, p)
        else:
            gone = (np.add.reduceat(table["cnt"].to_numpy()[row][order], first) > 1)[group]
        if gone.any():
            o = order[gone]
            yield _runs(i[o], t[o], p[o], p[o] + spec.window)

    def run(batches):
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            cut = int(np.searchsorted(a, a[-1], side="left"))  # where the last, perhaps unfinished, gram begins
            if kept and kept[-1].column(0)[-1].as_py() == a[-1] and cut == 0:
                kept.append(batch)
                continue
            kept.append(batch.slice(0, cut))
            size = sum(b.num_rows for b in kept)
            if size >= 4096:
                yield from settle(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(cut))
        kept = [b for b in kept if b.num_rows]
        if kept:
            yield from settle(pa.Table.from_batches(kept))

    return run


def repeated_runs(docs: DataFrame, spec: Spec) -> DataFrame:
    """id, th and runs, array of (start, length) in values, unordered and overlapping, of documents with repeats.

    ``docs``: id (long), th (long), text.
    """
    sc = docs.sparkSession.sparkContext

    def bitmap(keys: DataFrame, n: int):
        return sc.broadcast(bloom_of(keys, "a", n, max_bits=spec.max_bits))

    grams = docs.mapInArrow(_gram_counts(spec), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a")
    grams = written(grams, "repeated-grams")
    n_grams = grams.count()
    ranks = written(docs.mapInArrow(_context_ranks(spec, bitmap(grams, n_grams)), _OUT), "context-ranks")
    runs = [ranks.filter("a is null").select("id", "th", "p", "n")]

    def settled(rows: DataFrame) -> DataFrame:
        """Of rows that stand for equal (a, c), those that repeat: all, or all but the first."""
        same = Window.partitionBy("a", "c")
        if spec.first_stays:
            here = F.struct("id", "th", "p")
            rows = rows.withColumn("_gone", here != F.min(here).over(same))
        else:
            rows = rows.withColumn("_gone", F.sum("cnt").over(same) > 1)
        return rows.filter("_gone").select("id", "th", "p", (F.col("n") - 1 + spec.window).cast("int").alias("n"))

    firsts = ranks.filter("a is not null")
    beyond = 16 * n_grams > spec.max_bits
    if beyond:
        firsts = firsts.join(grams, "a", "left_semi")
    runs.append(settled(firsts.drop("data")))
    per_gram = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("a", "rows")
    per_gram = written(per_gram, "open-grams")
    n_some, n_hot = per_gram.agg(F.count_if(F.col("rows") <= spec.hot), F.count_if(F.col("rows") > spec.hot)).first()
    levels: list = []
    for level in range(len(spec.levels)):
        pairs = firsts.select("a", "c", "data").mapInArrow(_level_pairs(spec, level, list(levels)), "a long, lo long, hi long")
        pairs = pairs.groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("a")
        pairs = written(pairs, f"repeated-pairs-{level}")
        levels.append(bitmap(pairs, pairs.count()))
    if beyond:
        todo = firsts.join(per_gram, "a").groupBy("id", "th").agg(F.collect_list(F.struct("a", "c", "p", "cnt", (F.col("rows") > spec.hot).alias("big"))).alias("todo"))
        # Rows equal in id and text are opened once where they count once.
        one = docs.dropDuplicates(["id", "th"]) if spec.first_stays else docs
        opened = one.join(todo, ["id", "th"]).select("id", "th", "text", "todo").mapInArrow(_open_listed(spec, levels), _OUT)
    else:
        some, hot = (bitmap(per_gram.filter(F.col("rows") <= spec.hot), n_some), bitmap(per_gram.filter(F.col("rows") > spec.hot), n_hot))
        opened = docs.mapInArrow(_open_contexts(spec, levels, some, hot), _OUT)
    opened = written(opened, "open-contexts")
    runs.append(opened.filter("a is null").select("id", "th", "p", "n"))
    runs.append(settled(opened.filter("a is not null and data is null").drop("data")))
    sorted_ = opened.filter("data is not null").repartition("a").sortWithinPartitions("a")
    runs.append(sorted_.mapInArrow(_rank_windows(spec), _OUT).select("id", "th", "p", "n"))
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "th").agg(F.collect_list(F.struct(F.col("p").alias("start"), F.col("n").alias("length"))).alias("runs"))


def merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, end) of overlapping or touching runs."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["start"] + r["length"]) for r in runs or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, size (values), spans (array of (start, end) removed), kept (binary): one row for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.xxhash64("text").alias("th"), "text")
    runs = repeated_runs(keyed.select("id", "th", "text"), spec)
    joined = keyed.join(runs, ["id", "th"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                gone = merged(runs.as_py())
                raw = (text.as_py() or "").encode("utf-8")
                values = raw if spec.unit == "bytes" else raw.split()
                parts, at = [], 0
                for s, e in gone:
                    parts.append(values[at:s])
                    at = e
                parts.append(values[at:])
                sizes.append(len(values))
                spans.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join(parts) if spec.unit == "bytes" else b" ".join(w for p in parts for w in p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "size", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, size long, spans array<struct<start:long,end:long>>, kept binary")
