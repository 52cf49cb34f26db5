"""Token ids of a public word tokenizer, at the speed of a dictionary.

The tokenizer drops white space and never joins characters across it, so the ids of a text are the
ids of its words in a row. It parts letters, digits and signs too and takes small letters for capitals, so that is
done first and the forms of a word meet. Each worker keeps the ids of the words it has met, up to a bound; the
``tokenizers`` library encodes the words that are new, many at a time.

Strings of the vocabulary's added tokens (``<|endoftext|>``) in a text are ordinary text, or, with
``added_tokens``, those tokens, as in the library's plain call; texts that hold one then go through the library whole.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from racebook.llm.common import give_back

#: Words that a worker keeps; beyond it the older half goes, which changes no result.
MEMO_WORDS = 1_000_000
#: Longer words are encoded each time they come.
MEMO_LENGTH = 64
#: Words in one call of the library.
GROUP = 100
#: ASCII and composed Latin letters, whose small forms are one letter too.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Kinds of bytes; all others, ``|`` among them, which the strings of added tokens hold, are of kind 0.
LETTER, SIGN, APOSTROPHE, DIGIT = 1, 2, 3, 4


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Small forms of ASCII bytes, kinds of bytes, and by ``8 * kind + next kind`` whether the library parts the two bytes."""
    every = [bytes([i]) for i in range(256)]
    kind = np.zeros(256, "u1")
    kind[[i for i, c in enumerate(every) if c.isalpha()]] = LETTER
    kind[[i for i, c in enumerate(every) if 32 < i < 127 and not c.isalnum() and c != b"|"]] = SIGN
    kind[ord("'")] = APOSTROPHE
    kind[[i for i, c in enumerate(every) if c.isdigit()]] = DIGIT
    apart = np.zeros(64, bool)
    for x, others in ((LETTER, (SIGN, APOSTROPHE, DIGIT)), (SIGN, (LETTER, DIGIT)), (DIGIT, (LETTER, SIGN, APOSTROPHE))):
        apart[[8 * x + y for y in others]] = True  # letters after an apostrophe may be one piece with it
    return np.frombuffer(b"".join(c.lower() for c in every), "u1"), kind, apart


SMALL, KIND, APART = tables()


def parted(texts: list[bytes]) -> pa.LargeStringArray:
    """The texts with a blank at their end and where letters, digits and signs meet, capitals of ASCII and composed Latin
    letters as small ones. Their ids are the same, but their words repeat far more often.

    A capital that a mark may follow stays: the two could be one character, whose small form need not be that of its parts.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]) + b" ", "u1")
    data = joined[:-1]
    plain = joined[1:] < 0xC4  # lead bytes of marks are higher
    raw = np.where(plain, SMALL[data], data)
    kind = KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    second = joined[lead + 1]
    lead = lead[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    capital = lead[(joined[lead + 1] < 0x9F) & plain[lead + 1]] + 1
    raw[capital] += 0x20
    at = np.flatnonzero(APART[8 * kind[:-1] + kind[1:]]) + 1
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), "i8", len(texts)))
    offsets = np.concatenate([[0], ends + np.searchsorted(at, ends)])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype("i8")), pa.py_buffer(np.insert(raw, at, 32)))


def in_bytes(strings: pa.LargeStringArray) -> list[bytes]:
    """Strings without nulls as bytes; slices of their buffer cost less than a Python object for each through Arrow."""
    _, offsets, data = strings.buffers()
    edges = np.frombuffer(offsets, "i8")[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@functools.cache
def encoder_of(path: str, memo_words: int = MEMO_WORDS, added_tokens: bool = False) -> WordEncoder:
    """One encoder a worker, which lives on from task to task."""
    return WordEncoder(path, memo_words, added_tokens)


@contextlib.contextmanager
def collector_off() -> Iterator[None]:
    """Encoding makes no cycles, and looking for some among many small objects takes long; what runs after it in
    the same worker finds the collector as it was, and buffers that Arrow holds in reserve given back."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        give_back()


class WordEncoder:
    """Texts as bytes -> their ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a word are ordinary text
        self.added: list[bytes] = []
        if added_tokens:
            self.whole = Tokenizer.from_file(path)
            found = self.whole.get_added_tokens_decoder().values()
            # what is matched after the text was normalised may look different in it: then every text goes whole
            self.added = [b"" if t.normalized else t.content.encode() for t in found]
            self.sign = os.path.commonprefix(self.added)  # a text without it holds none
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.stops = np.array(sorted(i for t, i in vocab.items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?")), "<u4")
        self.memo_words = memo_words
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def sentence_ends(self) -> np.ndarray:
        """Ids after which a sentence may end."""
        return self.stops

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_piece(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words of letters alone, many words in one call. Each ends with a token that ends a word."""
        for at in range(0, len(words), GROUP):
            group = words[at : at + GROUP]
            ids = self._ids([b" ".join(group).decode()])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group):
                raw, begin = ids.tobytes(), 0
                for end in (4 * ends).tolist():
                    yield raw[begin:end]
                    begin = end
            else:
                yield from (x.tobytes() for x in self._ids([w.decode() for w in group]))

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words."""
        seen = list(map(self.older.get, words))
        ids = {w: x for w, x in zip(words, seen, strict=True) if x is not None}
        new = [w for w, x in zip(words, seen, strict=True) if x is None] if ids else words
        letters = [w for w in new if w.isalpha() or LETTERS.fullmatch(w)]
        ids.update(zip(letters, self._one_piece(letters), strict=True))
        if len(letters) < len(new):
            other = [w for w in new if w not in ids]
            ids.update(zip(other, (x.tobytes() for x in self._ids([w.decode("utf-8", "replace") for w in other])), strict=True))
        self.memo.update(ids)
        for w in [w for w in ids if len(w) > MEMO_LENGTH]:
            del self.memo[w]
        return ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        whole = {i: t for i, t in enumerate(texts) if t and self.sign in t and any(a in t for a in self.added)} if self.added else {}
        out = self._by_word([None if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        for i, t in whole.items():
            ids = self.whole.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _by_word(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.memo) > self.memo_words // 2:
            self.memo, self.older = {}, self.memo
        # equal words of the texts meet in a dictionary; a blank at the begin or end of a text leaves an empty word
        split = pc.ascii_split_whitespace(parted([t or b"" for t in texts]))
        coded = split.flatten().dictionary_encode()
        words = in_bytes(coded.dictionary)
        self.memo[b""] = b""
        known = list(map(self.memo.get, words))
        new = [w for w, ids in zip(words, known, strict=True) if ids is None]
        if new:
            learned = self._learn(new)
            known = [learned[w] if ids is None else ids for w, ids in zip(words, known, strict=True)]
        length = np.fromiter(map(len, known), "i8", len(known)) // 4
        begin = np.cumsum(length) - length
        word = coded.indices.to_numpy()
        n = length[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[word] - ends[:-1], n)
        at += np.arange(len(at))
        raw = np.frombuffer(b"".join(known), "<u4")[at].tobytes()
        edges = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
