"""Exact removal of repeated byte strings with suffix arrays.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts earlier (in a document with a smaller id,
or in the same one), all judged on the input. Matches never cross documents.

1. Marks. Each string of LENGTH bytes has a mark: the least hash of the ``GRAM``-byte strings in it. Equal strings
   have equal marks, and neighbours mostly share one, so a text has a mark for about 35 bytes. Marks met once
   in the whole corpus rule out most of the text. They meet sorted by value, as runs of rows.
2. Shards. Documents are dealt into shards by id. Over the parts of a shard whose marks were met twice a suffix array
   is built by refinement of ranks after Larsson and Sadakane: groups of equal prefixes of 8, 16, 32, 64 and 100
   bytes, of which only those with several members are sorted again. Common prefixes of neighbours in the array
   follow after Kasai, each from the one before. Of equal strings all but the first of the shard are covered.
3. Merge. What is left, the first of each string in its shard, goes to the task of its mark if other shards have that
   mark too, as stretches of bytes. There each shard's strings look up, by binary search among all sorted
   fingerprints, the first document that has them; hits are compared byte by byte.
4. Covered stretches of both kinds return to their shard and are cut out.

Marks that very many rows have are dealt on by a second mark, so passages that a third of all documents share
spread as well. Nothing is sampled, capped or sent through the driver.

A null text is empty; texts shorter than LENGTH stay. Rows that share an id count as documents in the order of
their texts, so of two equal rows the second goes. Rows without an id come after all others, in a fixed order.
An empty table gives an empty result. A long text is one document of a larger shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from racebook.llm.common import drop_stored, give_back, in_blocks, rows, shard_count, stored

LENGTH, GRAM = 100, 32
#: Bytes of text of a shard; rows of a mark beyond which it is dealt on; bytes that a task of marks gathers.
SHARD, HOT, GATHER = 4 << 20, 512, 32 << 20
#: Places whose hashes, or bytes that, are held side by side.
BLOCK = 1 << 20
#: Names of the columns that a table gets for a while.
OWN = "__suffix_"
NO_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(20240101)
BYTES = _RANDOM.integers(0, 1 << 63, (2, 256), dtype="u8") * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
REGION = "kind int, shard int, mark long, doc int, at long, size long, doc_id long, part binary"


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all strings of ``n`` bytes, put together from strings whose lengths are powers of two."""
    h, size = BYTES[seed][data], 1
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out = h
            else:
                tail = h[done:]
                out = out[: len(tail)] * power(size) + tail
            done += size
        if done == n:
            break
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` values in a row."""
    best, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def marks_of(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """The mark of every string of LENGTH bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, "u8")
    return sliding(gram_hashes(data, GRAM, seed), LENGTH - GRAM + 1, True)


def marking(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the short strings that are the mark of a string from ``starts``, and their hashes."""
    if not len(starts):
        return starts, np.zeros(0, "u8")
    width = LENGTH - GRAM + 1
    grams = gram_hashes(data, GRAM)
    marks = sliding(grams, width, True)
    padded = np.zeros(len(grams) + width - 1, "u8")
    padded[width - 1 + starts] = marks[starts]
    places = np.flatnonzero(sliding(padded, width, False) == grams)
    return places, grams[places]


def joined_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, where each text begins, and the starts of strings that stay inside a text."""
    data = np.frombuffer(b"".join(texts), "u1")
    begins = np.cumsum([0, *map(len, texts)])
    inside = np.ones(max(0, len(data) - LENGTH + 1), bool)
    for end in begins[1:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    return data, begins, np.flatnonzero(inside)


def dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with order key, text bytes and shard under names that begin with OWN."""
    n = shard_count(docs, text_col, SHARD)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.col(id_col).cast("long")
    place = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    return docs.withColumns({f"{OWN}id": F.coalesce(key, F.lit(NO_ID)), f"{OWN}text": text, f"{OWN}shard": F.pmod(place, F.lit(n)).cast("int")})


def repeated_marks(texts: DataFrame) -> DataFrame:
    """shard, mark, cross (other shards have it), hot of the marks that the corpus holds twice or more. A row may come
    more than once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            mark, shard = np.concatenate([m for m, _ in held]), np.concatenate([s for _, s in held])
            order = np.lexsort((shard, mark))
            mark, shard = mark[order], shard[order]
            first = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (shard[1:] != shard[:-1])]))
            n = np.diff(np.append(first, len(mark)))
            return pa.RecordBatch.from_arrays([pa.array(mark[first].view("i8")), pa.array(shard[first].astype("i4")), pa.array(n)], names=["mark", "shard", "n"])

        for block in in_blocks(rows(batches), 1):
            data, begins, starts = joined_texts([t for _, t in block])
            places, mark = marking(data, starts)
            if len(mark):
                held.append((mark, np.array([s for s, _ in block])[np.searchsorted(begins, places, "right") - 1]))
            size += len(data)
            if held and size >= GATHER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held.clear()
        give_back()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i8"))

        def out(mark: np.ndarray, shard: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = np.concatenate([[True], mark[1:] != mark[:-1]])
            run, begin = np.cumsum(first) - 1, np.flatnonzero(first)
            cross = (np.minimum.reduceat(shard, begin) != np.maximum.reduceat(shard, begin))[run]
            total = np.add.reduceat(n, begin)[run]
            keep = total > 1
            return pa.RecordBatch.from_arrays([pa.array(shard[keep]), pa.array(mark[keep]), pa.array(cross[keep]), pa.array((total > HOT)[keep])], names=["shard", "mark", "cross", "hot"])

        for part in batches:
            mark, shard, n = (np.concatenate([h, part.column(i).to_numpy()]) for i, h in enumerate(held))
            if not len(mark):
                continue
            at = int(np.searchsorted(mark, mark[-1]))  # rows of the last mark may go on
            if at:
                yield out(mark[:at], shard[:at], n[:at])
            own, place = np.unique(shard[at:], return_inverse=True)
            held = (np.full(len(own), mark[-1]), own, np.bincount(place, n[at:]).astype("i8"))
        if len(held[0]):
            yield out(*held)

    met = texts.select(f"{OWN}shard", f"{OWN}text").mapInArrow(make, "mark long, shard int, n long")
    n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(n, "mark").sortWithinPartitions("mark", "shard").mapInArrow(runs, "shard int, mark long, cross boolean, hot boolean")


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, "u1")])
    out = np.zeros(len(data), "u8")
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(data)]
    return out


def suffix_array(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the LENGTH bytes from them, equal ones by place.

    ``words``: from words_at. Ranks are kept for all places; each refinement sorts only the members of groups
    that are still of several, by the rank a step further on.
    """
    n = len(words)
    order = np.argsort(words, kind="stable").astype("i4")
    sorted_words = words[order]
    first = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    del sorted_words
    begin = np.flatnonzero(first)
    rank = np.empty(n, "i4")
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n))).astype("i4")
    for depth, step in ((8, 8), (16, 16), (32, 32), (64, LENGTH - 64)):
        group = rank[order]
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), n))
        several = np.flatnonzero(np.repeat(size > 1, size))
        if not len(several):
            break
        own = order[several].astype("i8")
        ahead = own + step
        beyond = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = group[several].astype("i8") << 32 | beyond
        within = np.argsort(key, kind="stable")
        key, own = key[within], own[within]
        order[several] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(first)
        # a group's rank is the place of its first member; new groups begin inside old ones
        fresh = several[begin]
        rank[own] = np.repeat(fresh, np.diff(np.append(begin, len(own)))).astype("i4")
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(words: np.ndarray, suffixes: np.ndarray, lane: int = 64) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before, LENGTH at most. After Kasai: a place shares at
    most one byte less than the place before it did. Lanes of neighbouring places go side by side. The array is sorted
    by LENGTH bytes only, so of a full match this holds just where its followers stand in the same order, and nothing
    is taken over across places left out."""
    n = len(words)
    before = np.full(n + 1, -1, "i4")
    before[suffixes[1:]] = suffixes[:-1]
    stands = np.full(n + 1, -1, "i4")
    stands[suffixes] = np.arange(len(suffixes))
    out = np.zeros(n, "i2")
    starts = np.arange(0, n, lane)
    shared, other = np.zeros(len(starts), "i8"), np.full(len(starts), n - 1)
    for j in range(lane):
        place = np.minimum(starts + j, n)
        follower = stands[other + 1]
        goes_on = (other >= 0) & (follower >= 0) & ((shared < LENGTH) | (follower < stands[place]))
        shared = np.where(goes_on, np.maximum(shared - 1, 0), 0)
        other = before[place].astype("i8")
        shared[other < 0] = 0
        todo = np.flatnonzero(other >= 0)
        while len(todo):
            a, b = place[todo] + shared[todo], other[todo] + shared[todo]
            ok = (a < n) & (b < n)
            todo, differ = todo[ok], words[a[ok]] ^ words[b[ok]]
            alike = differ == 0
            last, rest = todo[~alike], differ[~alike]
            for bits in range(8, 64, 8):
                shared[last] += rest < np.uint64(1 << bits)
            todo = todo[alike]
            shared[todo] += 8
            todo = todo[shared[todo] < LENGTH]
        shared = np.minimum(shared, LENGTH)
        live = place < n
        out[place[live]] = shared[live]
    return out[suffixes]


def stretches(places: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of neighbouring places, cut where ``split`` changes."""
    if not len(places):
        return places, places
    cut = places[1:] != places[:-1] + 1
    if split is not None:
        cut |= split[1:] != split[:-1]
    begin = np.flatnonzero(np.concatenate([[True], cut]))
    return places[begin], places[np.append(begin[1:], len(places)) - 1]


def shard_regions(texts: list[bytes], ids: list[int], marks: np.ndarray, cross: np.ndarray, hot: np.ndarray) -> list[tuple]:
    """Rows of REGION without shard: kind 0 covers (at, bytes) of a document, kind 1 is a stretch to merge.
    ``marks`` are sorted."""
    data, begins, starts = joined_texts(texts)
    starts = starts.astype("i4")
    held: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(starts), BLOCK):  # hashes take 8 bytes for each place, so few places at a time
        some = starts[at : at + BLOCK]
        a, b = int(some[0]), int(some[-1]) + LENGTH
        mark = marks_of(data[a:b])[some - a]
        place = np.minimum(np.searchsorted(marks, mark), len(marks) - 1)
        known = marks[place] == mark
        mark, place, some = mark[known], place[known].astype("i4"), some[known]
        far = hot[place]
        if far.any():
            second = marks_of(data[a:b], 1)[some[far] - a]
            mark[far] = (mark[far] ^ (second >> np.uint64(7))) * np.uint64(BASE)
        held.append((some, cross[place], mark))
    del starts
    chosen, merges, route = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, "i4")] * 3
    held.clear()
    if not len(chosen):
        return []
    # the bytes of the chosen strings, side by side; a string never spans a gap since a stretch holds it whole
    begin, end = stretches(chosen)
    merged = np.flatnonzero(np.concatenate([[True], begin[1:] >= end[:-1] + LENGTH]))
    begin, end = begin[merged], np.append(end[merged[1:] - 1], end[-1]) + LENGTH
    size = end - begin
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = int(size.sum())
    words = words_at(np.concatenate([data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))
    piece = np.searchsorted(begin, chosen, "right") - 1
    local = chosen - begin[piece] + base[piece]
    order = suffix_array(words, local)
    equal = common_prefixes(words, order) >= LENGTH
    # of equal strings the first place stays: the array has them side by side, in order of place
    group = np.flatnonzero(~equal)
    first = np.repeat(np.minimum.reduceat(order, group), np.diff(np.append(group, len(order))))
    del words, equal
    covered = np.zeros(n, bool)
    covered[order[first != order]] = True
    gone = covered[local]
    del order, first, covered, local, piece
    out: list[tuple] = []
    a, b = stretches(chosen[gone])
    doc_of = np.searchsorted(begins, a, "right") - 1
    for d, x, y in zip(doc_of.tolist(), a.tolist(), b.tolist(), strict=True):
        out.append((0, None, d, x - int(begins[d]), y - x + LENGTH, ids[d], None))
    left = ~gone & merges
    places, keys = chosen[left], route[left].view("i8")
    a, b = stretches(places, keys)
    key_of = keys[np.searchsorted(places, a)]
    doc_of = np.searchsorted(begins, a, "right") - 1
    raw = data.tobytes()
    for k, d, x, y in zip(key_of.tolist(), doc_of.tolist(), a.tolist(), b.tolist(), strict=True):
        out.append((1, k, d, x - int(begins[d]), y - x + LENGTH, ids[d], raw[x : y + LENGTH]))
    return out


def _by_order(table: pa.Table) -> pa.Table:
    return table.sort_by([(f"{OWN}id", "ascending"), (f"{OWN}text", "ascending")])


def local_regions(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """REGION rows of every shard."""
    names = ["kind", "mark", "doc", "at", "size", "doc_id", "part"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        shard = 0
        if left.num_rows and right.num_rows:
            shard = left.column(f"{OWN}shard")[0].as_py()
            left = _by_order(left)
            mark, order = np.unique(right.column("mark").to_numpy().view("u8"), return_index=True)
            cross, hot = (right.column(c).to_numpy()[order] for c in ("cross", "hot"))
            found = shard_regions(left.column(f"{OWN}text").to_pylist(), left.column(f"{OWN}id").to_pylist(), mark, cross, hot)
        columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
        table = pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})
        del left, right, columns
        found, n_found = [], len(found)
        give_back()
        return table.add_column(1, "shard", pa.array([shard] * n_found, pa.int32()))

    own = texts.select(f"{OWN}id", f"{OWN}text", f"{OWN}shard")
    return own.groupBy(f"{OWN}shard").cogroup(marks.groupBy("shard")).applyInArrow(work, REGION)


def same_strings(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes from each place of ``left`` and ``right`` are equal. Neighbours on both sides share
    most of their bytes, which are compared once for each run of them."""
    cut = (left[1:] != left[:-1] + 1) | (right[1:] != right[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], cut]))
    count = np.diff(np.append(first, len(left)))
    out = np.empty(len(left), bool)
    a = 0
    while a < len(first):  # runs of about BLOCK bytes at a time, or one longer run
        b = max(a + 1, int(np.searchsorted(np.cumsum(count[a:] + LENGTH - 1), BLOCK)) + a)
        size = count[a:b] + LENGTH - 1
        base = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype="i8")
        differ = data[at + np.repeat(left[first[a:b]] - base, size)] != data[at + np.repeat(right[first[a:b]] - base, size)]
        upto = np.concatenate([[0], np.cumsum(differ, dtype="i4")])
        lo, hi = int(first[a]), int(first[b - 1] + count[b - 1])
        place = np.arange(hi - lo) + np.repeat(base - (first[a:b] - lo), count[a:b])
        out[lo:hi] = upto[place + LENGTH] == upto[place]
        a = b
    return out


def merged_cover(keys: np.ndarray, rank: np.ndarray, parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(stretch, first, last) of strings that a stretch of lower rank has too, among stretches of equal key."""
    by_rank = np.argsort(rank)
    keys, rank, parts = keys[by_rank], rank[by_rank], [parts[i] for i in by_rank.tolist()]
    sizes = np.array([len(p) for p in parts], "i8")
    data = np.frombuffer(b"".join(parts), "u1")
    begins = np.cumsum(sizes) - sizes
    n_strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(parts)), n_strings)
    place = np.arange(int(n_strings.sum())) + np.repeat(begins - np.cumsum(n_strings) + n_strings, n_strings)
    print_ = (gram_hashes(data, LENGTH)[place] ^ keys.view("u8")[owner]) * np.uint64(BASE)
    covered = np.zeros(len(owner), bool)
    todo = np.arange(len(owner))
    while len(todo):  # once, but for strings whose fingerprint another string has
        own = print_[todo]
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        heads = todo[np.minimum.reduceat(order, first)]  # strings stand in the order of their stretches' ranks
        head = np.empty(len(todo), "i8")
        head[order] = heads[np.searchsorted(own[first], own)]  # binary search among the sorted fingerprints of all shards
        own = np.flatnonzero(head != todo)
        a, b = todo[own], head[own]
        same = (keys[owner[a]] == keys[owner[b]]) & same_strings(data, place[a], place[b])
        covered[a] = same & (rank[owner[a]] > rank[owner[b]])
        todo = a[~same]
    hit = np.flatnonzero(covered)
    a, b = stretches(hit, owner[hit])
    own = owner[a]
    return sorted(zip(by_rank[own].tolist(), (place[a] - begins[own]).tolist(), (place[b] - begins[own]).tolist(), strict=True))


def cross_regions(regions: DataFrame) -> DataFrame:
    """shard, doc, at, size of stretches that an earlier document of another shard has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(group: list[tuple]) -> pa.RecordBatch:
            keys = np.array([g[0] for g in group], "i8")
            order = sorted(range(len(group)), key=lambda i: (group[i][1], group[i][2], group[i][3], group[i][4]))
            rank = np.empty(len(group), "i8")
            rank[order] = np.arange(len(group))
            found = merged_cover(keys, rank, [g[5] for g in group])
            columns = [[group[i][2] for i, _, _ in found], [group[i][3] for i, _, _ in found], [group[i][4] + a for i, a, _ in found], [b - a + LENGTH for _, a, b in found]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "doc", "at", "size"])

        for row in rows(batches):
            if size > 4 << 20 and row[0] != held[-1][0]:
                yield out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
        if held:
            yield out(held)
        held.clear()
        give_back()

    parts = regions.where("kind = 1").select("mark", "doc_id", "shard", "doc", "at", "part")
    n = max(1, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(n, "mark").sortWithinPartitions("mark").mapInArrow(merge, "shard int, doc int, at long, size long")


def cut(texts: list[bytes], doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[tuple[bytes, int, int]]:
    """What is left of every text, bytes removed, and removed stretches."""
    out = []
    order = np.argsort(doc, kind="stable")
    doc, at, size = doc[order], at[order], size[order]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        a, b = edges[i], edges[i + 1]
        if a == b:
            out.append((text, 0, 0))
            continue
        steps = np.zeros(len(text) + 1, "i4")
        np.add.at(steps, at[a:b], 1)
        np.add.at(steps, at[a:b] + size[a:b], -1)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((np.frombuffer(text, "u1")[~gone].tobytes(), int(gone.sum()), spans))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and ``{OWN}kept`` (the text left, without characters cut in two, or with
    ``digest`` the SHA-256 of all bytes left), ``{OWN}n_bytes``, ``{OWN}n_removed`` and ``{OWN}n_spans``."""
    texts = dealt(docs, id_col, text_col)
    marks = stored(repeated_marks(texts), "marks")
    regions = stored(local_regions(texts, marks), "regions")
    drop_stored(marks)
    cover = stored(regions.where("kind = 0").select("shard", "doc", "at", "size").union(cross_regions(regions)), "cover")
    drop_stored(regions)
    whole = texts.drop(text_col)
    schema = StructType(whole.drop(f"{OWN}text", f"{OWN}shard", f"{OWN}id").schema.fields[:])
    schema = schema.add(f"{OWN}kept", "string").add(f"{OWN}n_bytes", "long").add(f"{OWN}n_removed", "long").add(f"{OWN}n_spans", "long")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _by_order(left)
        own = left.column(f"{OWN}text").to_pylist()
        found = cut(own, *(right.column(c).to_numpy() for c in ("doc", "at", "size")))
        left = left.drop_columns([f"{OWN}text", f"{OWN}shard", f"{OWN}id"])
        parts = [hashlib.sha256(f[0]).hexdigest() if digest else f[0].decode("utf-8", "ignore") for f in found]
        for name, column in (("kept", pa.array(parts, pa.string())), ("n_bytes", pa.array([len(t) for t in own], pa.int64())), ("n_removed", pa.array([f[1] for f in found], pa.int64())), ("n_spans", pa.array([f[2] for f in found], pa.int64()))):
            left = left.append_column(OWN + name, column)
        del own, found, parts
        give_back()
        return left

    return whole.groupBy(f"{OWN}shard").cogroup(cover.groupBy("shard")).applyInArrow(work, schema)
