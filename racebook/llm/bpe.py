"""Byte-level pair merging as a transducer that is made deterministic while it reads.

The merges of a rank file say which token ends a text at each of its places: of all vocabulary tokens that
end there, exactly one may follow the token that ends where it begins. So the encoding of a text is the path
from its end back to its begin, and reading one more byte settles one more place.

What a place can still become depends on little. A place is open while the bytes read since begin some longer
token. A state keeps the bytes since the oldest open place and, for each open place, the tokens on the path to
it from the last place that all paths share. States and steps are made when a text first needs them, kept in
a table and dropped together when the table is full. What all paths share can no longer change and is emitted:
the lookahead is bounded by the longest token.

Two tokens stay apart if, in the order of the ranks, no merge across their border comes before both inner
pieces at the border have grown away from it.

Decoding joins the bytes of tokens in blocks; a small machine holds back the bytes of a character that is not
complete yet, so text comes out character by character whatever the block size.

A null text is empty: no ids. A text is one row of any length; rows that repeat are encoded each; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from racebook.llm.common import batch_of, id_and_text, in_blocks, rows

#: Steps of the transducer, pairs and words that a worker keeps.
MAX_STEPS, MAX_PAIRS, MAX_WORDS = 400_000, 300_000, 250_000
#: White space as the rank library's expressions know it.
SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(text: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the neighbours of lowest rank, the leftmost first, until none is left. For short texts."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge gives the token, or None where merging its bytes does not give it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if parts[at] + parts[at + 1] not in ranks:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Transducer:
    """Bytes of one word in, token bytes out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.never = len(ranks) + 1
        self.begins = {t[:n] for t in ranks for n in range(1, len(t))}
        self.edges: dict[bytes, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state is (bytes since the oldest open place, places); a place is (bytes since, tokens on its path),
        # the path beginning with the token that ends where all paths part
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[bytes, ...]]] = {}  # by state * 256 + byte
        self.start = self._state(b"", ((0, (b"",)),))

    def _state(self, since: bytes, places: tuple) -> int:
        key = (since, places)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _edges(self, token: bytes) -> tuple[list, list] | None:
        """The pieces at the left and at the right border of a token while it grows, each with the rank of the
        merge that takes it in; None where merging the token's bytes does not give it."""
        if token not in self.edges:
            found: tuple[list, list] | None = ([(token, self.never)], [(token, self.never)])
            if len(token) > 1:
                parts = split(token, self.ranks)
                inner = parts and (self._edges(parts[0]), self._edges(parts[1]))
                if inner and all(inner):
                    rank = self.ranks[token]
                    for side in (0, 1):
                        grown = inner[side][side]
                        found[side][:0] = [*grown[:-1], (grown[-1][0], rank)]
                else:
                    found = None
            self.edges[token] = found
        return self.edges[token]

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        if not left:
            return True
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._apart(self._edges(left)[1], self._edges(right)[0])
        return known

    def _apart(self, lefts: list, rights: list) -> bool:
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = lefts[i], rights[j]
            rank = self.ranks.get(x + y, self.never)
            if rank < taken_x and rank <= taken_y and rank < self.never:  # of equal merges the left one comes first
                return False
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1
            if i == len(lefts) or j == len(rights):
                return True

    def _step(self, state: int, byte: int) -> tuple[int, tuple[bytes, ...]]:
        since, places = self.states[state]
        read = since + bytes((byte,))
        here, kept = None, []
        for n, path in places:
            piece = read[-n - 1 :]
            if here is None and piece in self.ranks and self._edges(piece) and self._may_follow(path[-1], piece):
                here = (*path, piece)
            if piece in self.begins:
                kept.append((n + 1, path))
        if here is None:
            raise ValueError(f"the ranks cannot spell byte {byte}")
        if not kept:
            return self._state(b"", ((0, here[-1:]),)), here[1:]
        kept.append((0, here))
        shared, shortest = 1, min([len(path) for _, path in kept])
        while shared < shortest and len({path[shared] for _, path in kept}) == 1:
            shared += 1
        # the token before the parting matters only while a place that ends it is open
        before = here[shared - 1 : shared] if shared == shortest else (b"",)
        after = tuple([(n, before + path[shared:]) for n, path in kept])
        return self._state(read[-kept[0][0] :], after), here[1:shared]

    def tokens(self, word: bytes) -> list[bytes]:
        if len(self.steps) > MAX_STEPS:
            self.reset()
        out: list[bytes] = []
        state, steps = self.start, self.steps
        for byte in word:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.states[state][1][-1][1][1:]
        return out


class Utf8Stream:
    """Text from blocks of bytes that may end inside a character."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_bytes(block: bytes) -> int:
        """Bytes at the end that begin a character without ending it: 0 to 3."""
        for n in range(1, min(3, len(block)) + 1):
            byte = block[-n]
            if byte >= 0xC0:
                return n if n < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
            if byte < 0x80:
                return 0
        return 0

    def push(self, block: bytes) -> str:
        block = self.held + block
        n = self.open_bytes(block)
        self.held = block[len(block) - n :]
        return block[: len(block) - n].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Coder:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.transducer = Transducer(ranks)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        if ids := self.known.get(word):
            return ids
        if ids := self.older.get(word):
            self.known[word] = ids
            return ids
        raw = word.encode("utf-8", "replace")
        if raw in self.ranks:  # a word that is a token is that token
            ids = (self.ranks[raw],)
        else:
            ids = tuple([self.ranks[t] for t in self.transducer.tokens(raw)])
        if len(word) <= 48:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self.known) > MAX_WORDS:
            self.known, self.older = {}, self.known
        words = self.words.findall(text)
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int], block: int = 4096) -> Iterator[str]:
        """Text piece by piece."""
        stream = Utf8Stream()
        for at in range(0, len(ids), block):
            yield stream.push(b"".join(map(self.bytes_of.__getitem__, ids[at : at + block])))
        yield stream.end()


@functools.cache
def coder_of(ranks: str, pattern: str) -> Coder:
    """One coder a worker, which lives on from task to task. It makes no cycles, and looking for some among its
    many small tuples would take most of the time."""
    gc.disable()
    return Coder(load_ranks(ranks), pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        coder = coder_of(ranks, pattern)
        for block in in_blocks(rows(batches), 1):
            yield batch_of(schema, [[k for k, _ in block], [coder.encode((t or b"").decode("utf-8", "replace")) for _, t in block]])

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of ``encoded``; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        coder = coder_of(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, lists = (c.to_pylist() for c in batch.slice(at, 64).columns)
                yield batch_of(schema, [keys, ["".join(coder.decode(x or [])) for x in lists]])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 in one pass."""

    def digest(parts: Iterable[str]) -> str:
        found = hashlib.sha256()
        for p in parts:
            found.update(p.encode())
        return found.hexdigest()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        coder = coder_of(ranks, pattern)
        decimal = {i: str(i) for i in coder.bytes_of}
        for block in in_blocks(rows(batches), 1):
            out = []
            for key, text in block:
                ids = coder.encode((text or b"").decode("utf-8", "replace"))
                out.append((key, len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), digest(coder.decode(ids))))
            yield batch_of(schema, list(zip(*out, strict=True)))

    return id_and_text(docs, id_col, text_col).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
