"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.session import fresh_path

#: Bytes of text that one shard should hold; the number of shards follows the input.
SHARD_BYTES = 8 << 20


#: While this is on, the shuffle files of a query go as it ends. Else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the session, once; Spark serves the archive from the driver.

    Needed only where the package is neither installed on the executors nor given with ``--py-files``.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not root.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shard_count(df: DataFrame, col: str, per_shard: int = SHARD_BYTES) -> int:
    """Shards for the bytes of ``col``, one at least. One pass that reads this column only."""
    total = df.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / per_shard))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (UTF-8 bytes, null kept); all others go, so no name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The lineage ends here: a lost executor costs the tasks that ran on it, not the steps before. What was shuffled
    for the table goes once it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads; the shared folder then holds one step at a time."""
    for table in tables:
        files, inner = file_system(table.stored_path)
        files.delete_dir(inner)


def made_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared store, for files that Spark has no writer for."""
    path = fresh_path(spark, name)
    files, inner = file_system(path)
    files.create_dir(inner, recursive=True)
    return path


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder of the shared store, and the path inside it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def put(uri: str, data: bytes) -> None:
    """Write under a temporary name, then move: a reader sees the whole file or none.

    Two attempts of one task never share a temporary name, and moving is what commits.
    """
    files, path = file_system(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(tmp, compression=None) as out:
        out.write(data)
    files.move(tmp, path)


def mapped(uri: str) -> pa.Buffer:
    """The bytes of a file: memory-mapped where the store is a mounted folder, else read."""
    files, path = file_system(uri)
    if isinstance(files, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return pa.py_buffer(b"")
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with files.open_input_file(path) as source:
        return source.read_buffer()


def give_back() -> None:
    """Hand memory that this worker holds in reserve back to the system: workers live on, and other stages share
    the machine with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do this by themselves
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time: a row may hold a very long text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def in_blocks(it: Iterator[tuple], col: int, limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Lists of rows whose ``col`` holds ``limit`` bytes in all, or one longer row."""
    block: list[tuple] = []
    size = 0
    for row in it:
        block.append(row)
        size += len(row[col] or b"")
        if size >= limit or len(block) >= 4096:
            yield block
            block, size = [], 0
    if block:
        yield block


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def has_letter(col: str | Column) -> Column:
    """Whether a text holds a letter of any script."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).rlike(r"\p{L}")
