"""Plain versions of the corpus operators, one document after the other."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def frame(spark, texts, first=0, **columns):
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def suffix_dedup(docs, w):
    """docs: (id, text) in order of id."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - w + 1):
            s = raw[p : p + w]
            if s in seen:
                gone[p : p + w] = b"\1" * w
            seen.add(s)
        flags = bytes(gone)
        out[i] = (len(raw), sum(flags), len(re.findall(b"\1+", flags)), sha(bytes(b for b, g in zip(raw, flags) if not g)))
    return out


def substring_dedup(docs, w):
    counts = Counter(tuple(ws[p : p + w]) for _, t in docs for ws in [words(t)] for p in range(len(ws) - w + 1))
    out = {}
    for i, t in docs:
        ws = words(t)
        gone = set()
        for p in range(len(ws) - w + 1):
            if counts[tuple(ws[p : p + w])] > 1:
                gone.update(range(p, p + w))
        out[i] = (len(ws), len(gone), sha(" ".join(x for k, x in enumerate(ws) if k not in gone).encode()))
    return out


def shingles(text, k):
    ws = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def components(docs, k, share):
    """id -> (set size, smallest linked id); share in hundredths."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    at = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            at[s].append(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in at[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= share * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}
