"""Whitening of embeddings on their leading principal components.

Components are made whole numbers, ``x = floor(scale * component)``, so equal vectors are equal bytes. The fit list holds
every distinct x-vector once: vectors are packed into few bytes and made distinct by Spark, with map-side
combination, so a vector that a third of all rows share is one row a task. Three passes over the stored list follow, each of which
a task turns into one small sum: number and sums per dimension (whole numbers, exact); the covariance of ``x - S/n``
(centred before multiplying); the covariance of the whitened list, which should be the identity. Only such sums reach
the driver: at most a square of the dimension, whatever the number of rows. There ``spectrum`` slices the covariance.

Rows whose vector is null, or holds null, non-finite or unrepresentable entries (``scale * component`` beyond 62 bits) are left out. Shorter
vectors, empty ones among them, count as filled up with zeros. Rows with a null id, repeated ids and repeated vectors are
rows like all others; the fit list counts a vector once. Components without variance have no whitened value and are left
out; so with one distinct vector, or none, the result is empty. Columns beside id and vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racebook.llm.common import drop_stored, stored
from racebook.llm.spectrum import leading

#: Vectors worked on at once, by entries.
ENTRIES = 1 << 20
WIDTHS = {b"2": "<i2", b"4": "<i4", b"8": "<i8"}
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all usable vectors in a row as whole numbers, the vectors' ends, and which rows are usable."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype("i8")
    flat = column.flatten()  # of rows that are not null
    values = flat.to_numpy(zero_copy_only=False).astype("f8") * scale
    with np.errstate(invalid="ignore"):
        fine = np.isfinite(values) & (np.abs(values) < 2.0**62)
    if flat.null_count:
        fine &= flat.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    kept = np.repeat(usable, lengths)
    return np.floor(values[kept]).astype("i8"), np.cumsum(lengths[usable]), usable


def matrix(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    lengths = np.diff(ends, prepend=0)
    d = int(lengths.max(initial=0))
    if (lengths == d).all():
        return flat.reshape(len(ends), d)
    out = np.zeros((len(ends), d), "i8")
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Equal vectors become equal bytes: no zeros at the end, the least width that holds all entries."""
    largest = np.abs(x).max(1, initial=0)
    lengths = np.where(x != 0, np.arange(1, x.shape[1] + 1), 0).max(1, initial=0)
    tags = [b"2" if v < 1 << 15 else b"4" if v < 1 << 31 else b"8" for v in largest.tolist()]
    return [t + row[:n].astype(WIDTHS[t]).tobytes() for t, row, n in zip(tags, x, lengths.tolist(), strict=True)]


def unpack(raw: list[bytes], d: int | None = None) -> np.ndarray:
    rows = [np.frombuffer(r, WIDTHS[r[:1]], offset=1) for r in raw]
    x = matrix(np.concatenate([np.zeros(0, "i8"), *rows]), np.cumsum([len(r) for r in rows], dtype="i8"))
    return x if d is None else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def _in_parts(batch: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, ENTRIES // max(1, d))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def fit_list(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """Every distinct x-vector once, packed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends, _ = whole_numbers(batch.column(0), scale)
            yield pa.RecordBatch.from_arrays([pa.array(pack(matrix(flat, ends)), pa.binary())], ["x"])

    return vectors.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(make, "x binary").distinct()


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sums per dimension."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, "i8"), np.zeros(0, "i8")
        for batch in batches:
            x = unpack(batch.column(0).to_pylist())
            d = max(len(high), x.shape[1])
            high, low = np.pad(high, (0, d - len(high))), np.pad(low, (0, d - len(low)))
            high[: x.shape[1]] += (x >> 31).sum(0)  # in halves, whose sums stay within 64 bits
            low[: x.shape[1]] += (x & 0x7FFFFFFF).sum(0)
            n += len(x)
        dims = np.arange(-1, len(high))
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(np.append([0], high)), pa.array(np.append([n], low))], ["dim", "high", "low"])

    parts = fit.mapInArrow(make, "dim long, high long, low long")
    sums = parts.groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    both = {r.dim: (int(r.high) << 31) + int(r.low) for r in sums.collect()}  # one row a dimension
    n = both.pop(-1, 0)
    return n, [both[i] for i in range(len(both))]


def covariance(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> np.ndarray:
    """Covariance over the list, divisor ``n``, of the centred vectors times ``weights``."""
    d, mean = len(sums), np.array([s / n for s in sums])
    upper = np.triu_indices(weights.shape[1])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((weights.shape[1],) * 2)
        for batch in batches:
            for part in _in_parts(batch, d):
                z = (unpack(part.column(0).to_pylist(), d) - mean) @ weights
                square += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(square[upper])], ["i", "j", "s"])

    out = np.zeros((weights.shape[1],) * 2)
    for r in fit.mapInArrow(make, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # a square of the dimension
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """Exact sums over the dimensions of ``(n x - S)²``, 38 digits at most."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound * bound * max(1, len(sums)) < 1 << 63:
        found = ((n * x - np.array(sums, "i8")) ** 2).sum(1).tolist()
    else:
        found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    with localcontext() as exact:
        exact.prec = 38
        return [Decimal(v) for v in found]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """One row a usable vector and component: vec_id, component, n (size of the fit list), deviation, whitened,
    explained (share of the trace), identity_error (how far the fit list is from white, the same in all rows)."""
    spark = vectors.sparkSession
    fit = stored(fit_list(vectors, vec_col, scale), "whitening-fit")
    n, sums = totals(fit)
    if not sums:
        drop_stored(fit)
        return spark.createDataFrame([], SCHEMA)
    v = covariance(fit, n, sums, np.eye(len(sums)))
    values, axes = leading(v, k)
    if not len(values):
        drop_stored(fit)
        return spark.createDataFrame([], SCHEMA)
    weights = axes / np.sqrt(values)
    error = float(np.abs(covariance(fit, n, sums, weights) - np.eye(len(values))).max())
    drop_stored(fit)
    explained = values / np.trace(v)
    d, mean, m = len(sums), np.array([s / n for s in sums]), len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch, d):
                flat, ends, usable = whole_numbers(part.column(1), scale)
                x = matrix(flat, ends)
                x = np.pad(x[:, :d], ((0, 0), (0, max(0, d - x.shape[1]))))  # beyond d all entries are zero
                ids = part.column(0).filter(pa.array(usable))
                each = np.repeat(np.arange(len(x)), m)
                columns = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype="i4"), len(x))),
                    pa.array(np.full(len(each), n, "i8")),
                    pa.array(deviations(x, n, sums), pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(((x - mean) @ weights).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    few = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return few.mapInArrow(project, SCHEMA)
