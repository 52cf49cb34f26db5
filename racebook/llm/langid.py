"""Language of texts, word by word, with a linear-chain conditional random field.

Every word is labelled with a language. Its emissions are sums of learned weights of hashed features: the word
itself (lexicon), its first and last letters (affixes) and its letter pairs and triples; transitions between
neighbouring words are learned too, so a run of foreign words inside a text is found as such. Forward and
backward passes give each word its chances, and a text the share of each language among its words with letters.

Training takes a bounded sample of labelled rows: for every language an expected ``ROWS`` rows that differ in id or
text, chosen by a hash of both, and ``WORDS`` words of each, or ``CHARACTERS`` characters where these are longer. Runs of words of different rows are joined into short sequences, as in mixed text, so
transitions are learned from changes of language too. All else covers every row and every word.

Words are scored once while a worker remembers them. A chain is cut into stretches that run side by side: the
product of the transfer matrices of a stretch carries the chances over it exactly, so a very long text takes
no longer for its length than many short ones.

A run of more than ``LONG`` bytes without white space is cut into pieces, each a step of the chain like a word, in
training and labelling alike, so every byte of a text without spaces counts.

A null text, and one without a letter, is ``und`` with score 0; so is every text if no row could be learned
from. Ties between languages go to the alphabetically first. Repeated rows and ids are judged each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from racebook.llm.common import in_blocks, rows

#: Expected labelled rows of a language in the training sample, words taken of each, and characters of these at most.
ROWS, WORDS, CHARACTERS = 500, 120, 2160
#: Weights are kept for this many hashed features; the last place is no feature.
FEATURES = 1 << 16
#: Words of a training sequence, made of runs of RUN words on average; passes over the sample; penalty and step.
SEQUENCE, RUN, EPOCHS, PENALTY, STEP = 60, 20, 6, 1e-4, 0.3
#: Words of a stretch, bytes of a word before it is cut and usual features of a word at most, words that a worker remembers.
STRETCH, LONG, MOST, MEMO = 128, 36, 48, 400_000
SIGNS = ".,;:!?\"'()[]#*$%&|<>-"
UNKNOWN = "und"


def pieces(words: list[bytes]) -> list[bytes]:
    """The words, with those of more than LONG bytes cut into pieces of LONG bytes at most between characters; in
    text without spaces a word may be a sentence or a whole document."""
    if max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for word in words:
        at = 0
        while len(word) - at > LONG:
            end = at + LONG
            while end > at + LONG - 4 and word[end] & 0xC0 == 0x80:  # inside a character
                end -= 1
            out.append(word[at:end])
            at = end
        out.append(word[at:])
    return out


def plain(word: bytes) -> bytes:
    """Small letters without signs around them; empty for a word without a letter."""
    text = word.decode("utf-8", "replace")
    if not any(map(str.isalpha, text)):
        return b""
    return text.lower().strip(SIGNS).encode("utf-8", "replace")


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a word's number and the place of one of its features, for plain words: the whole word, its first
    and last one to three bytes, and all three bytes in a row of the word between two marks."""
    sizes = np.array([len(w) for w in words], "i8")
    own = np.flatnonzero(sizes)
    if not len(own):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    flat = np.frombuffer(b"".join([b"^" + w + b"$" for w in words if w]) + b"\0\0", "u1").astype("u8")
    sizes = sizes[own]
    ends = np.cumsum(sizes + 2)
    begins = ends - sizes - 2
    number = np.repeat(own, sizes + 2)
    inside = np.ones(len(number), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    three = flat[at] << 16 | flat[at + 1] << 8 | flat[at + 2]
    pairs = [(number[at], three), (own, np.array([zlib.crc32(w) for w in words if w], "u8") | 1 << 40)]
    for kind, first in ((2, lambda n: begins + 1), (3, lambda n: ends - 1 - n)):
        value = np.zeros(len(own), "u8")
        for n in (1, 2, 3):
            enough = sizes >= n
            place = first(n)[enough]
            value = flat[place]
            for i in range(1, n):
                value = value << 8 | flat[place + i]
            pairs.append((own[enough], value | kind << 40 | n << 44))
    key = np.concatenate([v for _, v in pairs]) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([w for w, _ in pairs]), (key >> np.uint64(40)).astype("i8") % (FEATURES - 1)


def table_of(words: list[bytes]) -> np.ndarray:
    """Feature places of every word in a row of its own, filled up with the place of no feature."""
    number, place = features(words)
    order = np.argsort(number, kind="stable")
    number, place = number[order], place[order]
    # small letters may take more bytes, so a few pieces have more than MOST features
    most = max(MOST, int(np.bincount(number).max())) if len(number) else MOST
    table = np.full((len(words), most), FEATURES - 1, "i8")
    table[number, np.arange(len(number)) - np.searchsorted(number, number)] = place
    return table


class Field:
    """A trained field: languages, emission weights (features by languages) and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Positive scores of plain words, the best of each being 1."""
        number, place = features(words)
        scores = np.stack([np.bincount(number, w[place], len(words)) for w in self.weights.T], 1)
        scores -= scores.max(1, keepdims=True)
        return np.exp(np.maximum(scores, -30)).astype("f4")


def train(sample: list[tuple[str, list[str]]], seed: int = 7) -> Field | None:
    """A field from rows of (language, words): stochastic gradient ascent of the log-likelihood."""
    sample = sorted((lang, pieces([w.encode() for w in words])) for lang, words in sample if words)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    k, rng = len(languages), np.random.default_rng(seed)
    weights = np.zeros((FEATURES, k), "f4")
    transitions = np.zeros((k, k))
    places = {lang: i for i, lang in enumerate(languages)}
    words = sorted({w for _, ws in sample for w in ws})
    code = {w: i for i, w in enumerate(words)}
    table = table_of([plain(w) for w in words])
    runs = []
    for lang, ws in sample:
        own = np.array([code[w] for w in ws])
        cuts = np.cumsum(rng.integers(RUN // 2, RUN * 3 // 2, len(own)))
        runs += [(r, places[lang]) for r in np.split(own, cuts[cuts < len(own)]) if len(r)]
    squares = np.full((FEATURES, k), 1e-6)
    squares_t = np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        flat = np.concatenate([runs[i][0] for i in order])
        truth = np.concatenate([np.full(len(runs[i][0]), runs[i][1]) for i in order])
        n = max(1, len(flat) // SEQUENCE)
        flat, truth = np.resize(flat, (n, SEQUENCE)), np.resize(truth, (n, SEQUENCE))
        for at in range(0, n, 32):
            own, labels = flat[at : at + 32], truth[at : at + 32]
            used = table[own]
            scores = weights[used].sum(2).astype("f8")
            emitted = np.exp(scores - scores.max(2, keepdims=True))
            moves = np.exp(transitions)
            b, t = own.shape
            ahead, behind = np.empty((b, t, k)), np.ones((b, t, k))
            ahead[:, 0] = emitted[:, 0]
            for i in range(t):
                if i:
                    ahead[:, i] = (ahead[:, i - 1] @ moves) * emitted[:, i]
                ahead[:, i] /= ahead[:, i].sum(1, keepdims=True)
            for i in range(t - 2, -1, -1):
                behind[:, i] = (emitted[:, i + 1] * behind[:, i + 1]) @ moves.T
                behind[:, i] /= behind[:, i].sum(1, keepdims=True)
            chance = ahead * behind
            chance /= chance.sum(2, keepdims=True)
            error = -chance
            np.put_along_axis(error, labels[:, :, None], np.take_along_axis(error, labels[:, :, None], 2) + 1, 2)
            both = ahead[:, :-1, :, None] * moves * (emitted * behind)[:, 1:, None, :]
            both /= both.sum((2, 3), keepdims=True)
            slope_t = -both.sum((0, 1))
            np.add.at(slope_t, (labels[:, :-1], labels[:, 1:]), 1)
            slope = np.stack([np.bincount(used.ravel(), np.repeat(error[:, :, j].ravel(), table.shape[1]), FEATURES) for j in range(k)], 1)
            slope[-1] = 0
            touched = np.flatnonzero(slope.any(1))
            slope = slope[touched] - PENALTY * weights[touched]
            squares[touched] += slope**2
            weights[touched] += (STEP * slope / np.sqrt(squares[touched])).astype("f4")
            slope_t -= PENALTY * transitions
            squares_t += slope_t**2
            transitions += STEP * slope_t / np.sqrt(squares_t)
    return Field(languages, weights, transitions)


def chances(emitted: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Chances of every language at every word of several texts in a row. ``emitted``: words by languages."""
    k = emitted.shape[1]
    moves = np.exp(transitions - transitions.max()).astype("f8")
    text_of, begin, size = [], [], []
    at = 0
    for i, n in enumerate(lengths.tolist()):
        for a in range(0, n, STRETCH):
            text_of.append(i)
            begin.append(at + a)
            size.append(min(STRETCH, n - a))
        at += n
    if not begin:
        return np.zeros((0, k))
    text_of, begin, size = np.array(text_of), np.array(begin), np.array(size)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    first = begin[order]
    live = [int(np.searchsorted(-size[order], -t)) for t in range(STRETCH)]  # stretches longer than t
    # matrices that carry chances over whole stretches
    carry = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t, n in enumerate(live):
        if n:
            step = (carry[:n] @ moves) * emitted[first[:n] + t][:, None, :]
            carry[:n] = step / step.sum((1, 2), keepdims=True)
    carry = carry[rank]
    # chances before and after each stretch, a stretch of every text at a time
    number = np.arange(len(begin)) - np.searchsorted(text_of, text_of)
    before, after = np.full((len(begin), k), 1.0 / k), np.ones((len(begin), k))
    by_number = [np.flatnonzero(number == j) for j in range(int(number.max()) + 1)] if number.max() < 64 else np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])
    for own in by_number[1:]:
        found = np.einsum("bi,bij->bj", before[own - 1], carry[own - 1])
        before[own] = found / found.sum(1, keepdims=True)
    for own in reversed(by_number[1:]):
        found = np.einsum("bij,bj->bi", carry[own], after[own])
        after[own - 1] = found / found.sum(1, keepdims=True)
    # and inside
    ahead = np.empty(emitted.shape)
    state = before[order]
    for t, n in enumerate(live):
        if n:
            found = (state[:n] @ moves) * emitted[first[:n] + t]
            state[:n] = found / found.sum(1, keepdims=True)
            ahead[first[:n] + t] = state[:n]
    state = after[order]
    for t in range(STRETCH - 1, -1, -1):
        if n := live[t]:
            place = first[:n] + t
            ahead[place] *= state[:n]
            found = (emitted[place] * state[:n]) @ moves.T
            state[:n] = found / found.sum(1, keepdims=True)
    return ahead / ahead.sum(1, keepdims=True)


class Labeller:
    """Texts to (language, score), with a memory of words."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.scores = np.empty((0, len(self.field.languages)), "f4")
        self.letters = np.empty(0, bool)

    def words(self, raw: list[bytes]) -> np.ndarray:
        """Rows of ``scores`` and ``letters`` that belong to words."""
        found = list(map(self.memo.get, raw))
        if None in found:
            new = list({w for w, i in zip(raw, found, strict=True) if i is None})
            words = [plain(w) for w in new]
            self.memo.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.field.emissions(words)])
            self.letters = np.concatenate([self.letters, np.array([bool(w) for w in words])])
            found = list(map(self.memo.get, raw))
        return np.array(found, "i8")

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if len(self.memo) > MEMO:
            self.forget()
        split = [pieces((t or b"").split()) for t in texts]
        lengths = np.array([len(w) for w in split], "i8")
        row = self.words([w for words in split for w in words])
        letters = self.letters[row]
        chance = chances(self.scores[row], lengths, self.field.transitions) * letters[:, None]
        ends = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, 0)])
        at = np.concatenate([[0], np.cumsum(lengths)])
        mass = ends[at[1:]] - ends[at[:-1]]
        total = mass.sum(1)
        out = []
        for i, m in enumerate(total.tolist()):
            if m < 0.5:  # a word with letters gives 1
                out.append((UNKNOWN, 0.0))
            else:
                best = int(mass[i].argmax())
                out.append((self.field.languages[best], float(min(1.0, mass[i, best] / m))))
        return out


def learned(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS) -> Field | None:
    """Train on a sample of the rows where ``may_learn`` holds and text and language are given."""
    own = docs.select(may_learn.alias("may"), F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("may and text is not null and lang is not null")
    own = own.withColumn("place", F.xxhash64(F.lit("place"), "key", "text"))
    seen = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}  # one row a language
    if not seen:
        return None
    part = F.create_map(*[F.lit(x) for lang, n in sorted(seen.items()) for x in (lang, min(1.0, rows_each / max(1, n)))])[F.col("lang")]
    chosen = own.where(F.pmod(F.xxhash64(F.lit("learn"), "key", "text"), F.lit(1 << 30)) < part * (1 << 30))
    words = F.split(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " ")), " ")
    begin = lambda n, of: (F.pmod("place", F.greatest(F.lit(1), n - of + 1)) + 1).cast("int")
    some = chosen.select("lang", "key", "place", words.alias("words")).select("lang", "key", "place", F.array_join(F.slice("words", begin(F.size("words"), WORDS), F.lit(WORDS)), " ").alias("some"))
    taken = some.select("lang", "key", "place", F.substring("some", begin(F.length("some"), CHARACTERS), F.lit(CHARACTERS)).alias("some")).distinct()
    return train([(r["lang"], [w for w in r["some"].split(" ") if w]) for r in taken.toLocalIterator()])


def labelled(docs: DataFrame, field: Field | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score under the given names, in place of columns that have these
    names already. Nothing but the text counts."""
    docs = docs.drop(*({lang, score} - {text_col}))
    if field is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.transitions))  # size fixed by FEATURES
    out = StructType(docs.schema.fields[:]).add(lang, "string").add(score, "double")
    place = docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Field(*shared.value))
        for batch in batches:
            at = 0
            texts = batch.column(place).cast(pa.binary())
            for block in in_blocks(((t.as_py(),) for t in texts), 0):
                found = labeller.label([t for (t,) in block])
                part = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, lang, score])

    return docs.mapInArrow(label, out)
