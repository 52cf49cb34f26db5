"""Similarity join of documents on word shingles, and the groups that its links make.

Two documents link when the sizes of the intersection and the union of their shingle sets satisfy
``100 * both >= percent * either``. The join follows prefix filtering with token combinations:

* Equal sets are one class; its smallest id stands for it from here on.
* Shingles are 64-bit hashes in one global order: those of the lowest quarter that few documents hold (rare), then
  the frequent ones of that quarter, then all others. Frequencies are counted over all classes; the list of the
  frequent ones is at most ``LIST`` long; where it would be longer, its threshold rises.
* Of a set of n shingles at most D = n - ceil(t n) are missing in a linked one. So in the first D + K of each, two
  linked sets share K (the prefix, extended). Rare ones are indexed one by one, and a pair must share K of them
  if the prefix of either side is all rare. A set whose links may share fewer than K goes by combinations too.
* A document whose prefix reaches frequent shingles also indexes combinations of two neighbours in that order, over
  a prefix extended so far that foreign shingles cannot part all neighbours that two linked sets share.
* A key of few documents gives its pairs, a key of many a star around its smallest document; components of these
  candidates are clusters. Texts of clusters are read again and every cluster is verified on whole sets,
  in tiles of bounded size, inside tasks. Tiles emit no pairs, only a spanning forest of the links found.
* A line that many texts hold makes one large cluster of texts that are not linked. So documents of clusters larger
  than a tile are indexed once more, now with whole sets in the order of frequencies inside their cluster, where such
  a line comes last; the candidates of that index part the cluster.
* Blocks of a cluster that is still large are first verified each for itself, with pivots that all of them share; only
  what that leaves outside the largest component meets the whole cluster.

So work grows with the sizes of groups of near copies, not with their squares, and no candidate is capped. A cluster
of texts that share most of their rarest shingles and are yet not linked costs the product of its size and of what
stays apart.

Null texts and texts without words have an empty set and link with nothing. A text with fewer words than a
shingle has its whole sequence as its one shingle. Repeated rows and repeated ids with equal sets fall into one
class; rows that share an id share its component and each keep their size. Rows without an id get no component
unless their class or cluster has one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook.llm.common import drop_stored, id_and_text, in_blocks, rows, stored
from racebook.llm.graph import components

#: Least shared tokens of extended prefixes; documents of a rare token and of a key that gives pairs.
K, FEW = 8, 32
#: Shingles below this bound form the lowest quarter of all.
LOW = -(1 << 62)
#: Entries of the broadcast list of frequent shingles at most: 8 MB.
LIST = 1 << 20
#: Shingles of one side of a tile; pairs and terms that are counted at a time.
TILE, PAIRS, TERMS = 1 << 18, 1 << 22, 4096
#: All blocks of a cluster share pivots of the size of a block divided by this.
SHARE = 8
#: Hashes of words that a worker remembers.
MEMO = 300_000
#: Bits of the map that keeps texts out of a shuffle whose id is in no cluster: 1 MB.
BITS = 1 << 23
#: Equal sets meet in so many turns, so that what is shuffled lies on disk for one of them at a time.
PARTS = 4


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}
        self.factors = [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(words + 1)]

    def _hash(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=8).digest()
        if len(word) <= 64:
            self.memo[word] = found
        return found

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = []
        for text in texts:
            words = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII white space parts
            found = list(map(self.memo.get, words))
            if None in found:
                found = [x or self._hash(w) for w, x in zip(words, found, strict=True)]
            h = np.frombuffer(b"".join(found), "<u8")
            k = min(self.words, len(h))
            if not k:
                out.append(np.zeros(0, "i8"))
                continue
            n = len(h) - k + 1
            mixed = np.full(n, self.factors[self.words] * k & (2**64 - 1), "u8")
            for i in range(k):
                mixed += h[i : i + n] * np.uint64(self.factors[i])
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            out.append(np.unique((mixed ^ (mixed >> np.uint64(31))).view("i8")))
        return out


def missing(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def reach(n: int, percent: int) -> int:
    """Length of the prefix in which linked sets share two neighbours: 2 D + D' + 2, D' being what the other,
    at most n / t long, may have beside."""
    return 2 * missing(n, percent) + (100 * n // percent - n) + 2


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, and its lowest shingles in order, as many as any prefix needs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for block in in_blocks(rows(batches), 1):
            sets = shingler.sets([t for _, t in block])
            n = [len(s) for s in sets]
            low = [s[: max(int(np.searchsorted(s, LOW)), min(len(s), max(reach(len(s), percent), missing(len(s), percent) + K)))] for s in sets]
            ends = np.cumsum([0, *map(len, low)]).astype("i4")
            mixed = [(s ^ (s >> 29)) * np.int64(0x2545F4914F6CDD1D) for s in sets]
            columns = [
                pa.array([k for k, _ in block], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([int(s.sum()) for s in sets], pa.int64()),
                pa.array([int(np.bitwise_xor.reduce(m)) if len(m) else 0 for m in mixed], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.zeros(0, "i8"))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "c1", "c2", "low"])

    return docs.mapInArrow(make, "doc_id long, n long, c1 long, c2 long, low array<long>")


def keys_of(low: np.ndarray, edge: int, n: int, frequent: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Single keys (rare shingles of the extended prefix) and combined keys of one set, whose first ``edge`` shingles
    were counted. ``frequent``: sorted; ``level``: their classes of frequency, in which they are ordered."""
    counted = low[:edge]
    often, known = np.zeros(edge, bool), np.zeros(edge, "i8")
    if len(frequent):
        known = np.minimum(np.searchsorted(frequent, counted), len(frequent) - 1)
        often = frequent[known] == counted
    rare = counted[~often]
    prefix = min(n, missing(n, percent) + K)
    if len(rare) >= prefix and n - missing(n, percent) >= K:
        return rare[:prefix], np.zeros(0, "i8")
    if n == 1:  # no neighbours: equal ones meet by their shingle
        return rare, low
    hot = counted[often][np.argsort(level[known[often]], kind="stable")]
    ordered = np.concatenate([rare, hot, low[edge:]])[: reach(n, percent)]
    both = (ordered[:-1] * np.int64(0x5851F42D4C957F2D) + ordered[1:]) * np.int64(0x369DEA0F31A53F85)
    return rare, both ^ (both >> 31)


def listed(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of token, count, sorted, and their classes of frequency."""
    level = F.ceil(F.log2("count")).cast("byte").alias("level")
    found = counted.where(F.col("count") > few_limit(counted)).select("token", level).toPandas().sort_values("token")
    return found["token"].to_numpy("i8"), found["level"].to_numpy("i1")


def index_rows(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, whole: bool = False) -> DataFrame:
    """key, combined, doc_id, n of every class that may link with another one. ``whole``: all its shingles were
    counted, not those of the lowest quarter alone."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, ns = part.column(0).to_numpy(), part.column(1).to_numpy()
                lows = [x.values.to_numpy() for x in part.column(2)]
                edges = [len(low) if whole else int(np.searchsorted(low, LOW)) for low in lows]
                found = [keys_of(low, edge, n, *shared.value, percent) for low, edge, n in zip(lows, edges, ns.tolist(), strict=True)]
                for kind in (0, 1):
                    sizes = [len(f[kind]) for f in found]
                    if sum(sizes):
                        keys = np.concatenate([f[kind] for f in found])
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), kind, "i4")), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(ns, sizes))], names=["key", "combined", "doc_id", "n"])

    return classes.select("doc_id", "n", "low").mapInArrow(emit, "key long, combined int, doc_id long, n long")


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that share enough keys. Keys arrive sorted, so a group is a run of rows and is never held whole:
    a run of more than FEW rows becomes a star."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), "i8")  # rows of the last run, which may go on; of a star its centre alone
        in_star = False

        def found(table: np.ndarray, last: bool) -> pa.RecordBatch:
            nonlocal held, in_star
            starts = np.flatnonzero(np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(1)]))
            sizes = np.diff(np.append(starts, len(table)))
            star = sizes > FEW
            star[0] |= in_star
            whole = len(starts) - (not last)
            edges = [np.zeros((0, 3), "i8")]
            for begin, size in zip(starts[star].tolist(), sizes[star].tolist(), strict=True):
                ids = table[begin : begin + size, 2]
                edges.append(np.stack([np.full(size, ids[0]), ids, np.ones(size, "i8")], 1))
            for size in np.unique(sizes[:whole][~star[:whole]]).tolist():
                i, j = np.triu_indices(size, 1)
                begin = starts[:whole][(sizes[:whole] == size) & ~star[:whole]][:, None]
                x, y = (begin + i).ravel(), (begin + j).ravel()
                near = 100 * np.minimum(table[x, 3], table[y, 3]) >= percent * np.maximum(table[x, 3], table[y, 3])
                x, y = x[near], y[near]
                edges.append(np.stack([table[x, 2], table[y, 2], table[x, 1]], 1))
            in_star = not last and bool(star[-1])
            held = table[:0] if last else table[starts[-1] : starts[-1] + 1 if in_star else None].copy()
            out = np.concatenate(edges)
            out = out[out[:, 0] != out[:, 1]]
            low, high = np.minimum(out[:, 0], out[:, 1]), np.maximum(out[:, 0], out[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(out[:, 2].astype("i4"))], names=["a", "b", "combined"])

        for part in batches:
            if part.num_rows:
                yield found(np.concatenate([held, np.stack([part.column(i).to_numpy().astype("i8") for i in range(4)], 1)]), False)
        if len(held):
            yield found(held, True)

    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = index.repartition(n, "key").sortWithinPartitions("key", "combined", "doc_id")
    met = sorted_rows.mapInArrow(pairs, "a long, b long, combined int").groupBy("a", "b").agg(F.count(F.when(F.col("combined") == 0, 1)).alias("singles"), F.max("combined").alias("combined"))
    return met.where((F.col("combined") == 1) | (F.col("singles") >= K)).select("a", "b")


def links_of(first: list[np.ndarray], second: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets of one list, or between two lists, found by counting shared shingles term by term."""
    sets = first + (second or [])
    sizes = np.array([len(s) for s in sets], "i8")
    term = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    counts = np.diff(np.append(begins, len(term)))
    common = np.repeat(counts > 1, counts)
    number = np.repeat(np.cumsum(counts > 1) - 1, counts)[common]
    owner = owner[common]
    width = int((counts > 1).sum())
    half = len(first)
    high = max(1, PAIRS // max(1, len(sets)))
    edges = np.searchsorted(number, range(0, width + TERMS, TERMS))
    for at in range(0, width and len(sets), high):  # a strip of rows against all: counts in dense blocks of terms
        strip = min(high, len(sets) - at)
        both = np.zeros((strip, len(sets)), "f4")
        for base, a, b in zip(range(0, width, TERMS), edges, edges[1:], strict=False):
            matrix = np.zeros((len(sets), min(TERMS, width - base)), "f4")
            matrix[owner[a:b], number[a:b] - base] = 1
            both += matrix[at : at + strip] @ matrix.T
        either = sizes[at : at + strip, None] + sizes[None, :] - both
        i, j = np.nonzero((100 * both >= percent * either) & (either > 0))
        i += at
        keep = (i < j) if second is None else (i < half) & (j >= half)
        yield from zip(i[keep].tolist(), j[keep].tolist(), strict=True)


def forest(n: int, links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join what was apart."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def few_limit(counted: DataFrame) -> int:
    """Documents of a rare token at most: FEW, or more where the list of the others would be longer than LIST."""
    power = F.ceil(F.log2("count")).cast("int")
    sizes = dict(counted.groupBy(power.alias("power")).count().collect())  # at most 64 rows
    power, longer = 64, 0
    while power > FEW.bit_length() - 1 and longer + sizes.get(power, 0) <= LIST:
        longer += sizes.get(power, 0)
        power -= 1
    return 1 << power


def texts_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of ``docs`` joined to ``few`` by doc_id. A map of bits first keeps nearly all other texts out of the shuffle;
    with many more ids than BITS it lets them pass, at no other cost."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}) % 64 AS INT))").alias("bit")
    taken = few.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    near = docs.select("*", word, bit).join(F.broadcast(taken), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return near.select(docs.columns).join(few, "doc_id")


def tiled_links(docs: DataFrame, dealt: DataFrame, words: int, percent: int, diagonal: bool) -> DataFrame:
    """a, b: a spanning forest of the true links in every tile. ``dealt``: doc_id, cluster, block, first, last; a row
    goes to the tiles of its block with the blocks first to last, or, if ``diagonal``, to these blocks alone."""
    texts = texts_of(docs, dealt)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for block in in_blocks(rows(batches), 1):
            found = shingler.sets([r[1] for r in block])
            ends = np.cumsum([0, *map(len, found)]).astype("i4")
            keys = [pa.array([r[i] for r in block], t) for i, t in ((0, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["doc_id", "cluster", "block", "first", "last", "tokens"])

    whole = texts.select("doc_id", "text", "cluster", "block", "first", "last").mapInArrow(sets, "doc_id long, cluster long, block int, first int, last int, tokens array<long>")
    spread = whole.withColumn("other", F.explode(F.sequence("first", "last")))
    if diagonal:
        spread = spread.withColumn("block", F.col("other"))
    tiles = spread.select("doc_id", "cluster", "block", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def tile(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by("doc_id")
        ids, block = table.column("doc_id").to_numpy(), table.column("block").to_numpy()
        tokens = [x.values.to_numpy() for c in table.column("tokens").chunks for x in c]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        order = left if i == j else np.concatenate([left, right])
        sides = [tokens[p] for p in left], None if i == j else [tokens[p] for p in right]
        found = forest(len(order), links_of(*sides, percent))
        return pa.table({"a": pa.array([int(ids[order[x]]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[order[y]]) for _, y in found], pa.int64())})

    return tiles.groupBy("cluster", "i", "j").applyInArrow(tile, "a long, b long")


def parted(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """``clusters`` (doc_id, cluster, n) with those larger than a tile parted by candidates among their own documents.

    The shingles are mixed with the cluster, so frequencies are those inside it. All shingles are counted and ordered,
    so an index key is as rare as the set allows. Linked documents stay together.
    """
    larger = clusters.groupBy("cluster").agg(F.sum("n").alias("size")).where(F.col("size") > TILE).select("cluster")
    own = stored(clusters.join(larger, "cluster", "left_semi").select("doc_id", "cluster", "n"), "larger-clusters")
    if own.isEmpty():
        drop_stored(own)
        return clusters

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for block in in_blocks(rows(batches), 1):
            salt = np.array([r[2] for r in block], "i8") * np.int64(0x2545F4914F6CDD1D)
            found = [np.sort(s ^ x) for s, x in zip(shingler.sets([r[1] for r in block]), salt, strict=True)]
            ends = np.cumsum([0, *map(len, found)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array(np.diff(ends).astype("i8")), lists], names=["doc_id", "n", "low"])

    texts = texts_of(docs, own.select("doc_id", "cluster").distinct())
    whole = stored(texts.select("doc_id", "text", "cluster").mapInArrow(sets, "doc_id long, n long, low array<long>").where("n > 0"), "local-sets")
    counted = stored(whole.select(F.explode("low").alias("token")).groupBy("token").count().where("count > 1"), "local-frequencies")
    found = stored(candidates(index_rows(whole, listed(counted), percent, whole=True), percent), "local-candidates")
    drop_stored(whole, counted)
    near = components(found)
    again = own.select("doc_id", "n").join(near.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    out = stored(clusters.join(larger, "cluster", "left_anti").select("doc_id", "cluster", "n").union(again.select("doc_id", "cluster", "n")), "parted-clusters")
    drop_stored(own, found, near)
    return out


def dealt_to(salt: str, blocks: Column) -> Column:
    """Block of a document, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), blocks).cast("int")


def verified(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component: what the true links inside clusters (doc_id, cluster, n) join.

    Every block of a cluster is verified in itself, together with pivots that all blocks of the cluster share: its
    smallest id and, by hash, the SHARE-th part of a block. That joins a group of near copies at a cost in
    proportion to its size. What its largest component does not hold is then verified against the whole cluster.
    """
    clusters = parted(docs, clusters, words, percent)
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    own = clusters.join(sizes, "cluster").withColumn("block", dealt_to("block", F.col("blocks")))
    pivot = (F.col("doc_id") == F.col("cluster")) | (dealt_to("pivot", F.col("blocks") * SHARE) == 0)
    last = F.when(pivot, F.col("blocks") - 1).otherwise(F.col("block"))
    near = own.withColumns({"first": F.when(pivot, F.lit(0)).otherwise(F.col("block")), "last": last})
    found = stored(tiled_links(docs, near, words, percent, diagonal=True), "block-links")
    joined = components(found)
    label = joined.select(F.col("node").alias("doc_id"), "component")
    several = own.where("blocks > 1").join(label, "doc_id", "left").select("doc_id", "cluster", "n", F.coalesce("component", "doc_id").alias("component"))
    several = stored(several, "large-clusters")
    parts = several.groupBy("cluster", "component").agg(F.sum("n").alias("size"))
    core = parts.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("core"), F.max("size").alias("most"), F.sum("size").alias("whole"))
    core = core.where("whole > most").select("cluster", "core", F.ceil(F.col("most") / TILE).cast("int").alias("inner"), F.ceil((F.col("whole") - F.col("most")) / TILE).cast("int").alias("outer"))
    inside = F.col("component") == F.col("core")
    block = F.when(inside, dealt_to("core", F.col("inner"))).otherwise(F.col("inner") + dealt_to("rest", F.col("outer")))
    rest = several.join(core, "cluster").select("doc_id", "cluster", block.alias("block"), F.when(inside, F.col("inner")).otherwise(0).alias("first"), (F.col("inner") + F.col("outer") - 1).alias("last"))
    if rest.isEmpty():
        drop_stored(found, several)
        return joined
    more = stored(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tiled_links(docs, rest, words, percent, diagonal=False)), "true-links")
    drop_stored(found, several, joined)
    out = components(more)
    drop_stored(more)
    return out


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row. ``percent`` is 67 or more: below, foreign shingles can part all
    neighbours that small linked sets share."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must lie between 67 and 100")
    few = id_and_text(docs, id_col, text_col)
    table = stored(shingle_table(few, words, percent), "shingles")
    sets = table.where("n > 0 and doc_id is not null")
    each = [sets.where(F.pmod("c1", F.lit(PARTS)) == i).groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.first("low").alias("low")) for i in range(PARTS)]
    parts = [stored(x, "classes") for x in each]
    classes = reduce(DataFrame.unionAll, parts)
    members = stored(table.select("doc_id", "n", "c1", "c2"), "members")
    drop_stored(table)
    least = 100 // (100 - percent) if percent < 100 else 1 << 62  # smaller sets link with equal ones only
    indexed = classes.where(F.col("n") >= max(2, least - 1))
    low = indexed.select(F.explode(F.filter("low", lambda x: x < LOW)).alias("token"))
    counted = stored(low.groupBy("token").count().where("count > 1"), "frequencies")
    found = stored(candidates(index_rows(indexed, listed(counted), percent), percent), "candidates")
    drop_stored(counted)
    cluster = components(found)
    sized = classes.select("doc_id", "n").join(cluster.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    joined = verified(few.where("doc_id is not null"), sized, words, percent)
    named = classes.select("n", "c1", "c2", "doc_id").join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    named = stored(named.select("n", "c1", "c2", F.coalesce("component", "doc_id").alias("component_id")), "named-classes")
    drop_stored(*parts, found, cluster, joined)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return members.join(named, ["n", "c1", "c2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component)
