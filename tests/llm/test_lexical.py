"""Ranked search by an automaton against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from racebook.llm import lexical, plans

DOCS, ITEMS = "doc_id LONG, text STRING, score DOUBLE, term STRING", "item_id LONG, text STRING, rank INT"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    words = [TERM.findall((t or "").translate(SMALL)) for _, t, *_ in docs]
    full, length = sum(map(bool, words)), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    asked = {}
    for key, text, *_ in items:
        asked.setdefault(key, set()).update(TERM.findall((text or "").translate(SMALL)))
    out = []
    for key, terms in asked.items():
        found = []
        for (doc_id, *_), w, c in zip(docs, words, counts):
            if not w:
                continue
            m = 100 - 90 + (90 * len(w) * full) // length
            score = sum(math.floor(1000 * math.log((2 * full + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(key, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def odd_tables():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(120)] + ["日本語", "ÉCOLE", "école", "x1", "1", "a", "aa", "aaa", "ÿ", " ", "𝒳"]
    join = lambda n: "".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in [0]) + "".join(rng.choice([" ", ", ", "\n", "-", "\x00", "~", "@", "[", "{", "\x7f", "/"]) + rng.choice(vocabulary) for _ in range(n))
    docs = [(i, join(rng.randint(0, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,;"), (203, join(3000)), (204, "a" * 5000 + " " + "aa " * 4000), (None, docs[0][1]), (None, docs[0][1]), docs[0], docs[1], (0, docs[2][1])]
    docs += [(300 + i, docs[7][1]) for i in range(40)]  # ties beyond the ranks
    items = [(i, join(rng.randint(0, 12))) for i in range(30)] + [(50, None), (51, ""), (52, "!!"), (53, docs[7][1]), (None, "aa x1"), (None, "école"), (3, "ÉCOLE a"), (54, "nowhere"), (55, "A a A")]
    return [(*d, 0.5, "clash") for d in docs], [(*i, 9) for i in items]


@pytest.mark.parametrize("piece, together, size", [(1 << 18, 256, 1 << 20), (40, 3, 60)])
def test_ranks_equal_plain_version(spark, monkeypatch, piece, together, size):
    """The second run cuts texts into short pieces, and items into many blocks."""
    for name, value in (("PIECE", piece), ("DOCUMENTS", together), ("TERM_BYTES", size)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = odd_tables()
    if size < 100:
        items = items[::4] + items[-4:]
    got = lexical.rank(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


def test_query_and_empty_tables(spark):
    docs, items = odd_tables()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, plans.op13_lexical_search(d, i).collect()), key=repr) == plain(docs, items)
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0)), (d.where("text = ''"), i)):
        assert lexical.rank(x, y).count() == 0


def test_pieces_of_a_text_count_alike(monkeypatch):
    rng = random.Random(1)
    terms = [b"a", b"ab", b"abc", "é".encode(), b"c" * 30]
    text = b"".join(rng.choice([*terms, b"zz", b"C" * 30]) + rng.choice([b" ", b"..", b"\n"]) for _ in range(900))
    whole = lexical.Automaton(terms).counts(text)
    words = Counter(text.lower().replace(b".", b" ").split())
    assert whole[0] == sum(words.values()) and dict(zip(whole[1].tolist(), whole[2].tolist())) == {i: words[t] for i, t in enumerate(terms)}
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(lexical, "PIECE", size)
        n, ids, times = lexical.Automaton(terms).counts(text)
        assert n == whole[0] and ids.tolist() == whole[1].tolist() and times.tolist() == whole[2].tolist()
    assert lexical.Automaton(terms).counts(None)[0] == 0
