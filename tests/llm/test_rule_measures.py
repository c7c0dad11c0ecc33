"""The counts of the quality rules against plain Python on texts of odd characters."""

import random
import re

from shoalsight.llm.quality_rules import STOP_WORDS, measures

STOPS = {x for ws in STOP_WORDS.values() for x in ws}


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lower = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    n = max(len(words), 1)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(covered),
        round(text.count("|") / n, 9),
        round(sum("A" <= c <= "Z" for c in text) / max(sum(map(len, words)), 1), 9),
        round(sum(w in STOPS for w in lower) / n, 9),
    )


def test_counts_are_those_of_plain_python(spark):
    rng = random.Random(6)
    parts = ["The", "für", "FÜR", "wHich", "&&", "a|b", "<>", "#*", "$%^[]", "Ä", "😀", "É", "whichever", "of", "\\", "K"]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\r\n", " ", "\x1c"]
    texts = ["".join(rng.choice(parts[: rng.randint(2, 16)]) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "pipe_ratio", "capital_ratio", "stop_ratio"]
    for r in rows:
        assert tuple(round(r[x], 9) for x in names) == plain(texts[r["doc_id"]])
