"""Order-preserving packing of token streams into sequences of a fixed size.

Documents keep the order of their ids. Each shard (a range of ids, dealt by bytes) is one stream of tokens.
Cuts may stand at ends of documents, at ends of sentences, and, where a sentence is longer than a sequence,
inside it. A dynamic programme picks the cuts:

    cost(end) = min over begins of cost(begin) + padding(end - begin) + penalty(end) + overhead

Padding fills a sequence to ``size``; a sequence whose length is a power of two stays as it is. The first kind
of step is a sliding minimum of ``cost(begin) + begin`` over the last ``size`` tokens, kept in a monotone
queue, so a step costs constant time; the second kind looks up one begin for each power of two.

Null and empty texts hold the end id alone. Null document ids come first, repeated ids stay side by side in
the order of their texts. Every id lies in exactly one piece; an empty table gives no piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from racebook.llm.common import batch_of, id_and_text, in_blocks, rows, shard_count
from racebook.llm.tokens import MEMO_WORDS, collector_off, encoder_of

SIZE = 4096
#: Price in tokens of a cut inside a document after a sentence, inside a sentence, and of one more sequence.
SENTENCE, INSIDE, OVERHEAD = 4, 64, 24
#: Bytes of text that are encoded together: words that repeat in them are looked up once.
BLOCK_BYTES = 8 << 20

PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def merged(*places: np.ndarray) -> np.ndarray:
    """All places in order, each once."""
    at = np.sort(np.concatenate([np.asarray(p, "i8") for p in places]))
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may stand, from 0 on, and what each costs."""
    at = merged([0], doc_ends, sentence_ends)
    long = np.flatnonzero(np.diff(at) > size).tolist()  # a long sentence: let cuts stand inside it
    if long:
        at = merged(at, *[np.arange(at[i] + size, at[i + 1], size) for i in long])
    price = np.full(len(at), INSIDE, "i8")
    price[np.searchsorted(at, sentence_ends)] = SENTENCE
    price[np.searchsorted(at, doc_ends)] = 0
    return at, price


def choose_cuts(at: np.ndarray, price: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Places of the cuts of least cost, from 0 to the end of the stream."""
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    jump_ends, jump_begins = [], []
    for p in powers:
        begin = np.searchsorted(at, at - p)
        ends = np.flatnonzero(at[begin] == at - p)
        jump_ends.append(ends)
        jump_begins.append(begin[ends])
    order = np.argsort(np.concatenate(jump_ends), kind="stable")  # by end, of one end the shortest first
    jumps = iter(np.concatenate(jump_begins)[order].tolist())
    count = np.bincount(np.concatenate(jump_ends), minlength=len(at)).tolist()
    places, prices = at.tolist(), (price + OVERHEAD).tolist()
    cost, back = [0] * len(places), [0] * len(places)
    queue = deque([0])  # begins by falling worth; cost + place is the worth of a begin
    worth = [0] * len(places)
    first = size  # the last place that the first begin of the queue reaches
    for i in range(1, len(places)):
        place = places[i]
        while first < place:
            queue.popleft()
            first = places[queue[0]] + size
        best = queue[0]
        least = worth[best] + size - place
        if count[i]:
            for b in islice(jumps, count[i]):
                if cost[b] < least:
                    best, least = b, cost[b]
        cost[i] = least = least + prices[i]
        back[i] = best
        worth[i] = least = least + place
        while queue and worth[queue[-1]] >= least:
            queue.pop()
        if not queue:
            first = place + size
        queue.append(i)
    cuts, i = [places[-1]], len(places) - 1
    while i:
        i = back[i]
        cuts.append(places[i])
    return np.array(cuts[::-1], "i8")


def pieces(doc_ends: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Document, start in it, length, sequence and offset in that of every piece, in order."""
    edges = merged([0], doc_ends, cuts)
    begin, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(doc_ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right") - 1
    doc_begin = np.concatenate([[0], doc_ends[:-1]])
    return [doc, begin - doc_begin[doc], length, sequence, begin - cuts[sequence]]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", memo_words: int = MEMO_WORDS, added_tokens: bool = False) -> DataFrame:
    """One row a piece, with its ids as little-endian unsigned 32-bit integers. Sequence ids hold the shard in
    their upper bits, so no shard waits for the others. A worker remembers ``memo_words`` words, which changes no result."""
    few = id_and_text(docs, id_col, text_col)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer, memo_words, added_tokens)
        stops = np.zeros(max(len(encoder.ends_word), end_id + 1), bool)
        stops[encoder.sentence_ends()] = True
        end = np.array([end_id], "<u4").tobytes()
        keys: list[int | None] = []
        found: list[bytes] = []
        with collector_off():
            for block in in_blocks(rows(batches), 1, BLOCK_BYTES):
                keys += [k for k, _ in block]
                found += [raw + end for raw in encoder.encode([t for _, t in block])]
        if not keys:
            return
        doc_ends = np.cumsum([len(x) // 4 for x in found])
        raw = b"".join(found)
        found.clear()
        ids = np.frombuffer(raw, "<u4")
        cuts = choose_cuts(*cut_points(doc_ends, np.flatnonzero(stops[ids[:-1]]) + 1, size), size)
        doc, start, length, sequence, offset = pieces(doc_ends, cuts)
        sequence = sequence + (TaskContext.get().partitionId() << 32)
        counts = np.diff(doc_ends, prepend=0)
        ends = np.cumsum(length)
        for a in range(0, len(doc), 2048):
            b = a + 2048
            own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[a:b].tolist(), length[a:b].tolist(), strict=True)]
            yield batch_of(PIECE, [[keys[d] for d in doc[a:b].tolist()], start[a:b], length[a:b], counts[doc[a:b]], sequence[a:b], offset[a:b], own])

    shards = few.repartitionByRange(shard_count(few, "text"), "doc_id").sortWithinPartitions("doc_id", "text")
    return shards.mapInArrow(packed, PIECES)
