"""Ranked lexical search by one automaton over the texts, without an index of the documents.

The terms of all items make one Aho-Corasick automaton. Every pattern is a term with a blank on both sides, and every
text is scanned with signs turned into blanks, so a pattern is found just where its term stands as a whole word. One
scan tells which documents hold a term at all, which gives the weights; a second one counts each term's
occurrences in a document, turns them into parts of a score, and adds a part to all items that the term leads
to. A task keeps the best ``k`` documents of every item; a window merges the tasks' lists.

Items come in blocks of bounded size, whose terms are what is broadcast, so any number of items can be asked for, at
two scans a block; an item with more terms than a block may have is a block of its own.
A block of documents scores into one array, documents by items. A long text is scanned in pieces cut at blanks.

Terms are runs of digits, letters a-z and A-Z, and signs beyond ASCII; only A-Z are lower-cased. Null and empty texts
hold no terms, and items without terms get no row. Rows of items that share an id, null ids too, are one item with the terms of
all. Every row of documents is a document of its own, also where ids repeat; null ids come last among equal
scores. Columns beside id and text take no part. Empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racebook.llm.common import batch_of, drop_stored, id_and_text, in_blocks, rows, stored

#: Bytes of terms and number of items of a block.
TERM_BYTES, ITEMS = 1 << 20, 4096
#: Documents of one array of scores, entries of that array, and bytes of a text scanned at once.
DOCUMENTS, SCORES, PIECE = 256, 1 << 20, 1 << 18
BLANK = 0x20
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else BLANK for b in range(256))
#: Keys of the two sums that stand beside the documents of each term.
ALL_DOCUMENTS, ALL_TERMS = -1, -2

HIT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
HITS = "item_id long, doc_id long, score long"
NO_ID = np.iinfo("i8").max


def in_blanks(text: bytes | None) -> bytes:
    """The text with blanks for all that is no term, and one at both ends."""
    return b" " + (text or b"").translate(TABLE) + b" "


class Automaton:
    """Counts of the given terms in texts; a term is known by its place in the list."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.found.add_word(f" {term.decode('latin-1')} ", i)  # bytes as signs: UTF-8 keeps its borders
        self.found.make_automaton()

    def counts(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of all terms of the text, the given ones among them, and how often each of these comes."""
        blanks = in_blanks(text)
        n, at, ids, times = 0, 0, [], []
        while at < len(blanks) - 1:
            end = len(blanks) if len(blanks) - at <= PIECE else blanks.index(b" ", at + PIECE) + 1
            piece = blanks[at:end]
            inside = np.frombuffer(piece, "u1") != BLANK
            n += int(np.count_nonzero(inside[1:] > inside[:-1]))
            met = np.array([i for _, i in self.found.iter(piece.decode("latin-1"))], "i8")
            some, often = np.unique(met, return_counts=True)
            ids.append(some)
            times.append(often)
            at = end - 1  # the blank that ends a piece begins the next
        if len(ids) == 1:
            return n, ids[0], times[0]
        some, place = np.unique(np.concatenate([np.zeros(0, "i8"), *ids]), return_inverse=True)
        often = np.zeros(len(some), "i8")
        np.add.at(often, place, np.concatenate([np.zeros(0, "i8"), *times]))
        return n, some, often


#: The automaton of the block of items at hand, by the block's key.
_BUILT: dict[str, Automaton] = {}


def automaton_of(key: str, shared) -> Automaton:
    """Built once a worker, which lives on from task to task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value)
    return _BUILT[key]


class Best:
    """The best ``k`` documents of every item so far, by falling score and rising id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((k, items), "i8")
        self.id = np.full((k, items), NO_ID)
        self.missing = np.ones((k, items), bool)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        top = scores.max(0, initial=0)
        some = np.flatnonzero((top > 0) & (top >= self.score[-1]))
        if not len(some):
            return
        own = np.array([NO_ID if i is None else i for i in ids], "i8")
        none = np.array([i is None for i in ids], bool)
        shape = (len(ids), len(some))
        score = np.concatenate([self.score[:, some], scores[:, some]])
        key = np.concatenate([self.id[:, some], np.broadcast_to(own[:, None], shape)])
        missing = np.concatenate([self.missing[:, some], np.broadcast_to(none[:, None], shape)])
        order = np.lexsort((key, missing, -score), axis=0)[: self.k]
        self.score[:, some], self.id[:, some], self.missing[:, some] = (np.take_along_axis(x, order, 0) for x in (score, key, missing))


def items_with_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and its distinct terms, for items that have some."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])
        for key, text in rows(batches):
            terms = sorted(set(in_blanks(text).split()))
            yield batch_of(schema, [[key] * len(terms), terms])

    own = id_and_text(items, id_col, text_col).mapInArrow(make, "item_id long, term binary").distinct()
    return own.groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def in_item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Blocks of items within the bounds, or one larger item; the driver holds one block at a time."""
    block: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for item_id, terms in items.toLocalIterator():
        own = [bytes(t) for t in terms]
        length = sum(map(len, own))
        if block and (size + length > TERM_BYTES or len(block) >= ITEMS):
            yield block
            block, size = [], 0
        block.append((item_id, own))
        size += length
    if block:
        yield block


def documents_by_term(docs: DataFrame, key: str, terms, count: int) -> dict[int, int]:
    """How many documents hold each term of the block, how many hold any term at all, and the length of all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(key, terms)
        held = np.zeros(count, "i8")
        documents = length = 0
        for _, text in rows(batches):
            n, some, _ = automaton.counts(text)
            held[some] += 1
            documents += n > 0
            length += n
        known = np.flatnonzero(held)
        yield batch_of(pa.schema([("term", pa.int64()), ("n", pa.int64())]), [[ALL_DOCUMENTS, ALL_TERMS, *known.tolist()], [documents, length, *held[known].tolist()]])

    found = docs.mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.collect()}  # one row a term of the block


def best_documents(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """For every item of the block, the best documents of each task: item_id, doc_id, score."""
    spark = docs.sparkSession
    terms = sorted({t for _, own in block for t in own})
    place = {t: i for i, t in enumerate(terms)}
    pairs = sorted((place[t], j) for j, (_, own) in enumerate(block) for t in own)
    item_of = np.array([j for _, j in pairs], "i8")
    begin = np.searchsorted([t for t, _ in pairs], np.arange(len(terms) + 1))
    item_ids = [i for i, _ in block]
    shared, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex
    held = documents_by_term(docs, key, shared, len(terms))
    n_docs, length = held.get(ALL_DOCUMENTS, 0), held.get(ALL_TERMS, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(terms))], "i8")
    together = max(1, min(DOCUMENTS, SCORES // len(block)))

    def scored(batch: list[tuple], automaton: Automaton, best: Best) -> None:
        doc, term, times, long = [], [], [], []
        for i, (_, text) in enumerate(batch):
            n, some, often = automaton.counts(text)
            if len(some):
                doc.append(np.full(len(some), i))
                term.append(some)
                times.append(often)
                long.append(np.full(len(some), 8 * (10 + 90 * n * n_docs // length)))
        if not doc:
            return
        d, t, tf, m = (np.concatenate(x) for x in (doc, term, times, long))
        part = weight[t] * (1_000_000_000 * tf // (1000 * tf + m))
        fan = begin[t + 1] - begin[t]  # a term leads to all its items
        ends = np.cumsum(fan)
        at = np.arange(ends[-1]) + np.repeat(begin[t] - ends + fan, fan)
        scores = np.zeros((len(batch), len(block)), "i8")
        np.add.at(scores, (np.repeat(d, fan), item_of[at]), np.repeat(part, fan))
        best.add(scores, [i for i, _ in batch])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best = automaton_of(key, shared), Best(len(block), k)
        for some in in_blocks(rows(batches), 1):
            for a in range(0, len(some), together):
                scored(some[a : a + together], automaton, best)
        rank, item = np.nonzero(best.score)
        ids = [None if m else i for i, m in zip(best.id[rank, item].tolist(), best.missing[rank, item].tolist(), strict=True)]
        yield batch_of(HIT, [[item_ids[j] for j in item.tolist()], ids, best.score[rank, item]])

    return docs.mapInArrow(search, HITS)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest scores above 0 of every item."""
    few = id_and_text(docs, id_col, text_col)
    asked = stored(items_with_terms(items, item_col, item_text), "lexical-items")
    found = [stored(best_documents(few, block, k), "lexical-hits") for block in in_item_blocks(asked)]
    drop_stored(asked)
    hits = functools.reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], HITS)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
