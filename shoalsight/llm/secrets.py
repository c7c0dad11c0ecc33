"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Base kinds are assign, access and hex (below). The entropy kind looks at candidate strings, runs of at least
``min_chars`` token characters. A candidate's class is the narrowest of hex digits, alphanumerics and base64 symbols
that holds all of it; a window of ``window`` characters slides over it, its entropy kept by incremental counts (each
step changes two counts, and the sum of c*log2(c) with them), and the span from the first to the last window at or
above the class's threshold is reported. Suppressed are candidates on the allow list (UUIDs, dates and numbers, repeated
short periods; names and file paths whose parts all read as words) and those that overlap a base span.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans (the digest of the empty
string, an empty span list); repeated rows are scanned one by one; columns beside doc_id and text are ignored. Texts of
any length are scanned whole, in time that grows with their length; runs under 20 characters are no candidates.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# The patterns of the base kinds, with the characters that a match needs to count.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class of characters, and the entropy in bits that a window must reach.
CLASSES = ((re.compile(r"[0-9a-fA-F]+"), 2.9), (re.compile(r"[A-Za-z0-9]+"), 3.7), (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9))
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9_+/=-]+"),
    re.compile(r"(.{1,6})\1{2,}.{0,6}"),
)
#: Words without digits, paths and names; allowed only where their parts read as words.
NAMES = (
    re.compile(r"[^0-9]+"),
    re.compile(r"/?([A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z0-9_-]*"),
    re.compile(r"([A-Za-z]+[0-9]{0,4}[_-])+[A-Za-z]*[0-9]{0,4}"),
)
#: A part is cut where the case changes as in camelCase. A word has a vowel, no five consonants in a row, 15 letters at most.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"(?=.*[aeiouy])(?!.*[^aeiouy]{5}).{4,15}", re.IGNORECASE)


def allowed(run: str) -> bool:
    if any(p.fullmatch(run) for p in ALLOWED):
        return True
    if not any(p.fullmatch(run) for p in NAMES):
        return False
    parts = PART.findall(run)
    return sum(map(len, parts)) >= 3.5 * len(parts) and all(len(x) < 4 or WORD.fullmatch(x) for x in parts)


def window_entropies(text: str, window: int):
    """Shannon entropy in bits of each ``window`` characters of ``text``, in order."""
    counts: dict[str, int] = {}
    term = lambda c: c * math.log2(c) if c > 1 else 0.0
    total = 0.0
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term(c + 1) - term(c)
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term(c - 1) - term(c)
        if i >= window - 1:
            yield math.log2(window) - total / window


def entropy_spans(text: str, taken: list[tuple[int, int]], window: int = 20) -> list[tuple[int, int]]:
    """Spans of high entropy that overlap none of ``taken``."""
    out, taken = [], sorted(taken)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in CANDIDATE.finditer(text):
        run = m.group()
        before = bisect_left(starts, m.end())  # of the spans that begin before the run's end, the furthest end decides
        if (before and reach[before - 1] > m.start()) or allowed(run):
            continue
        least = next(bits for kind, bits in CLASSES if kind.fullmatch(run))
        high = [i for i, bits in enumerate(window_entropies(run, window)) if bits >= least]
        if high:
            out.append((m.start() + high[0], m.start() + high[-1] + window))
    return out


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted; the first three kinds are the base."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = entropy_spans(text, [(s, e) for s, _, e in base])
    return sorted(base + [(s, 3, e) for s, e in more])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans as array of (kind, start, end), for each row of ``docs`` (doc_id, text)."""

    def scanned(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(v.as_py() or "")] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
