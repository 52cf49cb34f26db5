"""Weak supervision: quality rules vote, and expectation-maximisation says how far each can be trusted.

Every rule votes good (+1), bad (-1) or abstains (0) from counts of one text. Nobody has labelled the texts: the
model has two hidden classes, and for each rule the chance of its three votes in each class. Documents with
equal votes are alike to it, so all documents are reduced to counts of vote patterns, at most 3 to the power
of the rules whatever the corpus; those go to the driver, where the steps of expectation and maximisation are a
few small matrix products. A document's probability of being good is then a sum of one weight for each vote.

A null text has no words and fails the base rule; so does an empty one. A long text is counted whole. Repeated
rows and ids are judged each. An empty table gives an empty result, and a model that keeps the prior.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from racebook.llm.common import in_blocks, rows

#: Counts of one text. The first five are those of the contract.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_stops", "n_distinct", "n_bars"]
#: Prefix of the columns that are added to a table for a while.
OWN = "__quality_"

#: At most this share of good documents gets a vote against it from any one rule. Without such a bound the classes
#: could part along the most frequent kind of junk and take rarer kinds for good.
FALSE_ALARMS = 0.005

#: Rules: name, ratio, vote bad if the ratio lies outside the outer range, good if inside the inner one.
RULES = [
    ("symbols", ("n_symbols", "n_words"), (None, 0.10), (None, 0.02)),
    ("bars", ("n_bars", "n_words"), (None, 0.10), (None, 0.02)),
    ("repeats", ("n_repeat_words", "n_words"), (None, 0.45), (None, 0.10)),
    ("upper_case", ("n_upper", "n_letters"), (None, 0.40), (None, 0.15)),
    ("shouting", ("n_shouts", "n_words"), (None, 0.20), (None, 0.05)),
    ("equal_lines", ("n_dup_lines", "n_lines"), (None, 0.50), (None, 0.20)),
    ("word_length", ("word_chars", "n_words"), (2.5, 12.0), (3.0, 10.0)),
    ("sentences", ("n_stops", "n_words"), (0.005, 0.50), (0.02, 0.30)),
    ("letters", ("n_letters", "word_chars"), (0.70, None), (0.85, None)),
    ("vocabulary", ("n_distinct", "n_words"), (0.10, None), (0.25, None)),
]


def _class_table() -> np.ndarray:
    """Bits of every byte: 1 white space, 2 inside a character, 4 symbol, 8 letter, 16 capital, 32 shout, 64 bar."""
    table = np.zeros(256, "u1")
    table[list(b" \t\n\x0b\x0c\r")] = 1
    table[0x80:0xC0] = 2
    table[list(b"#*$%&|<>")] = 4
    table[0xC3:0xF5] |= 8  # most characters beyond ASCII that texts hold are letters
    for a, b in ((0x41, 0x5B), (0x61, 0x7B)):
        table[a:b] |= 8
    table[0x41:0x5B] |= 16
    table[ord("!")] |= 32
    table[ord("|")] |= 64
    return table


CLASSES = _class_table()


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_codes: int) -> np.ndarray:
    """Which words lie in a 3-word window that its document holds twice or more. ``doc`` says whose a word is."""
    covered = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return covered
    pair = doc[:-1].astype("i8") * n_codes + codes[:-1]
    if (int(doc[-1]) + 1) * n_codes**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
        pair = np.unique(pair * n_codes + codes[1:], return_inverse=True)[1]
    else:
        pair = pair * n_codes + codes[1:]
    window = pair[:-1] * n_codes + codes[2:]
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    order = whole[np.argsort(window[whole], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for shift in range(3):
        covered[order[twice] + shift] = True
    return covered


def counts_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """COUNTS of every text, a column each."""
    texts = [t or b"" for t in texts]
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], "i8")
    code: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.array([code[w] for words in split for w in words], "i8")
    doc = np.repeat(np.arange(len(texts)), n_words)
    repeated = np.bincount(doc[repeated_words(codes, doc, max(1, len(code)))], minlength=len(texts))
    distinct = np.array([len(set(words)) for words in split], "i8")
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], "i8")
    n_dup = n_lines - np.array([len(set(x)) for x in lines], "i8")
    stops = np.array([sum(t.count(s) for s in (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n")) + t.endswith((b".", b"?", b"!")) for t in texts], "i8")
    raw = CLASSES[np.frombuffer(b"".join(texts), "u1")]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def total(bits: int, of: int) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum((raw & bits) == of, dtype="i8")])
        return ends[at[1:]] - ends[at[:-1]]

    word_chars = total(3, 0)
    return [n_words, word_chars, total(4, 4), n_dup, repeated, n_lines, total(8, 8), total(16, 16), total(32, 32), stops, distinct, total(64, 64)]


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with its COUNTS under names that begin with OWN; with ``keep_text=False`` without the text."""
    kept = docs if keep_text else docs.drop(text_col)
    source = kept.withColumn(f"{OWN}text", docs[text_col].cast("binary")) if keep_text else docs.select(*[docs[c] for c in kept.columns], docs[text_col].cast("binary").alias(f"{OWN}text"))
    out = StructType(kept.schema.fields[:])
    for c in COUNTS:
        out = out.add(f"{OWN}{c}", "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            for block in in_blocks(((t.as_py(),) for t in texts), 0):
                found = counts_of([t for (t,) in block])
                part = batch.slice(at, len(block))
                at += len(block)
                names = [*part.schema.names[:-1], *(f"{OWN}{c}" for c in COUNTS)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in found)], names=names)

    return source.mapInArrow(add, out)


def votes(prefix: str = OWN) -> list[Column]:
    """The vote of every rule; a ratio over nothing abstains."""

    def vote(ratio: tuple[str, str], outer: tuple, inner: tuple) -> Column:
        r = F.col(prefix + ratio[0]) / F.nullif(F.col(prefix + ratio[1]), F.lit(0))

        def within(bounds: tuple) -> Column:
            parts = [r >= bounds[0]] if bounds[0] is not None else []
            parts += [r <= bounds[1]] if bounds[1] is not None else []
            return reduce(Column.__and__, parts)

        return F.when(r.isNull(), 0).when(~within(outer), -1).when(within(inner), 1).otherwise(0)

    return [vote(ratio, outer, inner).alias(name) for name, ratio, outer, inner in RULES]


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Log odds of the prior, and for every rule the log odds of its votes bad, abstain, good.

    ``patterns``: votes, one row a pattern; ``weights``: its documents. The first belief takes a document with a
    vote against it for probably bad; smoothing keeps chances off 0 and 1.
    """
    n_rules = patterns.shape[1] if patterns.ndim == 2 else 0
    if not len(patterns):
        return 0.0, np.zeros((n_rules, 3))
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype("f8")  # pattern, rule, vote
    against = (patterns == -1).sum(1)
    good = np.where(against > 0, 0.2, 0.95)
    prior, odds = 0.0, np.zeros((n_rules, 3))
    for _ in range(rounds):
        chance = []
        for belief in (good, 1 - good):
            mass = np.einsum("p,prv->rv", belief * weights, seen) + 1.0
            chance.append(mass / mass.sum(1, keepdims=True))
        chance[0][:, 0] = np.minimum(chance[0][:, 0], FALSE_ALARMS)
        share = ((good * weights).sum() + 1) / (weights.sum() + 2)
        prior, odds = float(np.log(share / (1 - share))), np.log(chance[0] / chance[1])
        good = 1 / (1 + np.exp(-np.clip(prior + np.einsum("prv,rv->p", seen, odds), -500, 500)))
    return prior, odds


def learned(counted: DataFrame) -> tuple[float, np.ndarray]:
    """The model of a table with counts."""
    found = counted.select(*votes()).groupBy(*[name for name, *_ in RULES]).count().collect()  # at most 3 ** rules rows
    table = np.array([tuple(r) for r in found], "i8").reshape(-1, len(RULES) + 1)
    return fit(table[:, :-1], table[:, -1].astype("f8"))


def base_failed(prefix: str = OWN) -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (again * 100 > n * 50)


def probability(model: tuple[float, np.ndarray]) -> Column:
    """Probability of being good, of a row with counts."""
    prior, odds = model
    total = F.lit(float(prior))
    for vote, row in zip(votes(), odds.tolist(), strict=True):
        total = total + F.when(vote == -1, row[0]).when(vote == 0, row[1]).otherwise(row[2])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judged(counted: DataFrame, model: tuple[float, np.ndarray] | None = None, least: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept`` under names that begin with OWN."""
    chance = probability(model or learned(counted))
    scored = counted.withColumns({f"{OWN}base_failed": base_failed(), f"{OWN}p_good": chance})
    return scored.withColumn(f"{OWN}kept", ~F.col(f"{OWN}base_failed") & (F.col(f"{OWN}p_good") >= least))


def kept_rows(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are counted twice, which is cheaper than to store
    them beside their counts."""
    model = learned(with_counts(docs.select(text_col), text_col, keep_text=False))
    return judged(with_counts(docs, text_col), model, least).where(f"{OWN}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
