"""Counting of phrases by one automaton against masking them one after the other."""

import random

from pyspark.sql import functions as F

from racebook import constants as K
from racebook.operators import text


def plain(body, phrases):
    if body is None:
        return None
    out = []
    for p in phrases:
        out.append(body.count(p))
        body = body.replace(p, "\u0001" * len(p))
    return out


def test_counts_equal_masking(spark):
    rng = random.Random(9)
    phrases = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(25)}, key=lambda p: (-len(p), rng.random())) + ["ab", "aa"]
    bodies = ["".join(rng.choice("abéx ") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", "a" * 5000, "x" * 100000, "ab" * 30000]
    d = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING").repartition(3)
    got = {r.i: r.n for r in d.select("i", text.phrase_counts(F.col("body"), phrases).alias("n")).collect()}
    assert [got[i] for i in range(len(bodies))] == [plain(b, phrases) for b in bodies]
    assert d.select(text.phrase_counts(F.col("body"), []).alias("n")).distinct().count() == 2


def test_default_phrases(spark):
    ordered = [p for p, _, _ in text.Lexicon().ordered()]
    rng = random.Random(3)
    every = [p for axis in K.PHRASES.values() for p, _ in axis]
    bodies = ["".join(rng.choice([*every, "、", "です。"]) for _ in range(12)) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING")
    got = {r.i: r.n for r in d.select("i", text.phrase_counts(F.col("body"), ordered).alias("n")).collect()}
    assert [got[i] for i in range(100)] == [plain(b, ordered) for b in bodies]
