"""Exact top-k by inner product, term at a time.

Vectors are rows of small integers, mostly with many zeros or few; a term is a dimension. Candidates are dealt into
blocks; a block keeps, for every term, the list of its rows with a weight there (the postings). A block of
queries goes through its terms one by one: a term scatters ``query weight * posting weight`` into a dense array of
scores, queries by candidates. From the finished scores a partial selection takes the best k of the block, and
a window merges the blocks' lists by query.

All queries meet all candidates, block by block: that is what the search asks for. Blocks of queries are keys of
an equi-join, so neither side is broadcast or gathered on the driver, and a task holds two blocks.

Null vectors and those with null or non-finite components take no part. Components beyond the end of the shorter
vector count as zero; an empty vector scores 0 with all. A query is not its own candidate; rows that repeat its
id aren't either. Ties go to the smaller id. Repeated candidate rows stand in the list each. Rows with null ids
take no part. Empty tables give an empty result. Scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racebook.llm.common import batch_of

#: Candidates and queries of one block. The scores of a pair of blocks take 8 bytes for each of their pairs.
CANDIDATES, QUERIES = 4096, 512
#: Queries whose scores grow side by side.
TOGETHER = 16

HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, weight: Column | None = None) -> DataFrame:
    """vec_id and integer weights ``floor(64 * x)`` of the rows that take part."""
    v = F.col(vector_col)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(~bad & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * 64)).alias("weights"),
    )


def postings(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and weight of all weights but zeros, sorted by term."""
    sizes = np.array([len(v) for v in vectors], "i8")
    weight = np.concatenate(vectors) if vectors else np.zeros(0, "i8")
    row = np.repeat(np.arange(len(vectors)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    given = np.flatnonzero(weight)
    order = given[np.argsort(term[given], kind="stable")]
    return term[order], row[order], weight[order]


def score_block(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Scores, queries by candidates. A few queries go at a time, so that their scores stay in the cache while term
    after term adds to them."""
    c_term, c_row, c_weight = postings(candidates)
    q_lists = [postings(queries[at : at + TOGETHER]) for at in range(0, len(queries), TOGETHER)]
    largest = [int(np.abs(w).max()) if len(w) else 0 for w in (c_weight, np.concatenate([q[2] for q in q_lists]))]
    terms = max(map(len, queries), default=0)
    kind = "i4" if largest[0] * largest[1] * max(1, terms) < 1 << 31 else "i8"
    scores = np.zeros((len(queries), len(candidates)), kind)
    c_weight = c_weight.astype(kind)
    lists = dict(term_lists(c_term, c_row, c_weight.astype(kind), len(candidates)))
    for at, (q_term, q_row, q_weight) in zip(range(0, len(queries), TOGETHER), q_lists, strict=True):
        own = scores[at : at + TOGETHER]
        for term, (q_rows, q_weights) in term_lists(q_term, q_row, q_weight.astype(kind), len(own)):
            if term not in lists:
                continue
            rows, weights = lists[term]
            added = np.multiply.outer(q_weights, weights)
            if rows is None and q_rows is None:
                own += added
            elif rows is None:
                own[q_rows] += added
            elif q_rows is None:
                own[:, rows] += added
            else:
                own[q_rows[:, None], rows] += added
    return scores


def term_lists(term: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> Iterator[tuple[int, tuple[np.ndarray | None, np.ndarray]]]:
    """Every term with its rows and weights. A list of a quarter of all rows or more is written out: rows are None
    and the weights, zeros among them, stand for all rows."""
    ends = (np.append(np.flatnonzero(np.diff(term)) + 1, len(term)) if len(term) else np.zeros(0, "i8")).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        if 4 * (b - a) >= n:
            full = np.zeros(n, weight.dtype)
            full[row[a:b]] = weight[a:b]
            yield int(term[a]), (None, full)
        else:
            yield int(term[a]), (row[a:b], weight[a:b])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """block (from 0 on, without gaps), ids and weights (an array of arrays)."""
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n)).cast("int"))
    lists = dealt.groupBy("block").agg(F.collect_list(F.struct("vec_id", "weights")).alias("rows"))
    return lists.select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.weights").alias("weights"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query. ``is_query`` is a condition
    on ``vec_id``; every row is a candidate."""
    rows = usable(vectors, id_col, vector_col)
    queries = blocks(rows.where(is_query), QUERIES).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"))
    n_queries = queries.agg(F.coalesce(F.max("q_block") + 1, F.lit(0)).alias("n")).first()["n"]
    if n_queries == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = blocks(rows, CANDIDATES).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    pairs = candidates.join(queries, "q_block").select("ids", "weights", "q_ids", "q_weights")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, weights, q_ids, q_weights = (batch.column(i)[at].values for i in range(4))
                ids, q_ids = ids.to_numpy(), q_ids.to_numpy()
                sides = [[x.values.to_numpy() for x in side] for side in (q_weights, weights)]
                scores = score_block(*sides)
                out = []
                for q, own in enumerate(q_ids.tolist()):
                    top = best(scores[q], ids, k + int((ids == own).sum()))
                    top = top[ids[top] != own][:k]
                    out.append((np.full(len(top), own), ids[top], scores[q][top].astype("i8")))
                yield batch_of(HIT, [np.concatenate(c) for c in zip(*out, strict=True)])

    found = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(hits, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
