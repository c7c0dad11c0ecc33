"""Token counts by byte-pair merging with a heap over a linked list.

A text is cut at the special strings of the vocabulary (one token each, as the tokenizer does by default), the rest is
split into pieces by the byte-level pattern, and a piece's symbols, its UTF-8 bytes at first, are merged: the pair of
neighbours with the lowest rank is popped from a heap (the leftmost of equal ones), joined in the linked list, and its
two new pairs are pushed. The count is the initial symbols minus the merges; no identifiers are made. Counts of short
pieces are remembered in each Python worker, in a table of bounded size that is emptied when full.

Merge ranks are read once on the driver from a tokenizer file whose path is a parameter and sent as a broadcast
variable (its size is the vocabulary's, whatever the data). A file with another normalizer, split or model is refused.
Defined results: a null text counts as the empty text with 0 tokens; repeated rows are counted one by one; texts of any
length are counted whole; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the split pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
REMEMBERED, LONGEST = 500_000, 48


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in vocabulary files: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(n)] = b
            n += 1
    return out


def read_merges(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges in rank order and the special strings of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type", "BPE") == "BPE"
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if not plain or odd or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} is no byte-level tokenizer of the kind that is counted here")
    at = byte_alphabet()
    raw = lambda s: bytes(at[c] for c in s)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return [(raw(a), raw(b)) for a, b in merges], [t["content"] for t in added]


def count_merged(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left when no neighbouring pair of ``piece`` has a rank."""
    n = len(piece)
    if n < 2:
        return n
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, size = heapq.heappop(heap)
        a, j = symbol[i], right[i]
        if a is None or j >= n or len(a) + len(symbol[j]) != size or ranks.get((a, symbol[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = a + symbol[j], None
        right[i] = k = right[j]
        merges += 1
        if k < n:
            left[k] = i
            if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (r, i, len(symbol[i]) + len(symbol[k])))
        if (h := left[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
            heapq.heappush(heap, (r, h, len(symbol[h]) + len(symbol[i])))
    return n - merges


class Counter(dict):
    """piece -> tokens, filled when asked for."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str]):
        super().__init__()
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def __missing__(self, piece: str) -> int:
        n = count_merged(piece.encode("utf-8"), self.ranks)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.specials is None or self.specials.search(text) is None:
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


#: By path, once for each Python worker.
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of ``docs`` (doc_id, text)."""
    table, key = docs.sparkSession.sparkContext.broadcast(read_merges(path)), path

    def counted(batches):
        if key not in _counters:
            _counters[key] = Counter(*table.value)
        counter = _counters[key]
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                tokens.append(counter.count(text))
            t = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), t, pa.array([x > limit for x in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
