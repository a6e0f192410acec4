"""Frequent phrases against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.text import LETTERS
from sessionloom.operators import phrases

STOP = ("the", "and")
ROWS = (
    [("en", x) for x in ("Alpha beta gamma delta", "alpha, BETA gamma.delta the alpha beta", "up alpha-beta of gamma", "äöü éclair Žižek äöü éclair ɏɏɏ ɐɐɐ", None, "", "  ", "a bb", "日本語 alpha日beta×gamma", "snake_case x1y2 snake_case x1y2\nsnake_case x1y2\x00end")]
    + [("fr", "un deux trois"), ("fr", "deux trois quatre deux trois"), (None, "alpha beta gamma"), (None, "alpha beta gamma"), ("", "one two"), ("es", None)]
    + [("de", " ".join(f"wort{i * j % 7}" for i in range(40))) for j in range(6)]
)


def brute(rows, k):
    counts = defaultdict(Counter)
    for g, text in rows:
        words = [w for w in re.findall(f"[{LETTERS}]+", (text or "").lower()) if len(w) > 2 and w not in STOP]
        for n in (3, 2):
            counts[g].update((n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    out = set()
    for g, c in counts.items():
        best = sorted(((size, n, p) for (size, p), n in c.items() if n >= 2), key=lambda x: (-x[0], -x[1], x[2]))
        out |= {(g, *x, i + 1) for i, x in enumerate(best[:k])}
    return out


@pytest.mark.parametrize(("bits", "k"), [(64, 5), (64, 1), (7, 5), (1, 2)])
def test_phrases_are_exact_whatever_the_hash(spark, bits, k):
    docs = spark.createDataFrame(ROWS, "lang string, text string").repartition(3)
    got = [(r["lang"], r["size"], r["n"], r["phrase"], r["rank"]) for r in phrases.phrases(docs, "lang", STOP, k, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, k)


def test_phrases_of_no_rows(spark):
    assert phrases.phrases(spark.createDataFrame([], "lang string, text string"), "lang", STOP).collect() == []


def test_few_hashes_leave_a_bucket(spark):
    """Rows are made of the most frequent hashes of each bucket alone."""
    docs = spark.range(1000).select(F.lit("x").alias("lang"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("word"), F.floor(F.pow(F.pmod(F.hash("id", i), F.lit(1000)) / 1000, 3) * 90)))).alias("text"))
    words = [re.findall(f"[{LETTERS}]+", r["text"]) for r in docs.collect()]
    different = len({tuple(w[i : i + 3]) for w in words for i in range(len(w) - 2)})
    rows = phrases._frequent_hashes(docs, "lang", (), 3, 5, 64).count()
    assert different > 20_000 and rows < different / 10


def test_spaces_stand_for_all_but_letters():
    text = "".join(chr(c) + "a" for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    want = [w for w in re.split(f"[^{LETTERS}]+", text) if w]
    assert phrases.spaced(np.frombuffer(text.encode(), np.uint8)).tobytes().decode().split() == want
