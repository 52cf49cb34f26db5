"""Token ids as flat binary files beside 64-bit document offsets.

Documents are dealt into shards by ranges of their id, so that the shards in order hold the documents in
order. One task writes one shard: ``<shard>.ids`` holds unsigned integers, two bytes each where every id
fits, else four; ``<shard>.idx`` says where each document begins. A shard counts from zero; its place in the
whole is the sum of the shards before it, one small row each in the manifest.

Files are written under temporary names and moved. Names hold the attempt, and only the attempt that Spark
counts reaches the manifest, so a lost or repeated task leaves nothing that a reader would see.

Null texts hold the end id alone. Null document ids come first. Rows that repeat an id stay side by side, in
the order of their texts. A long text is one document like any other; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racebook.llm.common import batch_of, id_and_text, in_blocks, made_folder, mapped, put, rows, shard_count, stored
from racebook.llm.tokens import collector_off, encoder_of

MAGIC = b"TOKIDX01"
HEADER = struct.Struct("<8sIIQ")  # magic, bytes an id, 0, documents
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shard(path: str, doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> None:
    offsets = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=offsets[1:])
    missing = np.array([d is None for d in doc_ids], "u1")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    put(f"{path}.ids", b"".join(ids))
    put(f"{path}.idx", HEADER.pack(MAGIC, width, 0, len(lengths)) + offsets.tobytes() + keys.tobytes() + missing.tobytes())


def read_shard(path: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, offsets and token ids; the last are views of the mapped file."""
    idx = mapped(f"{path}.idx")
    magic, width, _, n = HEADER.unpack(idx.slice(0, HEADER.size).to_pybytes())
    if magic != MAGIC:
        raise ValueError(f"{path}.idx is no offset file")
    at = HEADER.size
    offsets = np.frombuffer(idx, "<u8", n + 1, at)
    keys = np.frombuffer(idx, "<i8", n, at + 8 * (n + 1))
    missing = np.frombuffer(idx, "u1", n, at + 8 * (2 * n + 1))
    ids = np.frombuffer(mapped(f"{path}.ids"), f"<u{width}")
    return [None if m else k for k, m in zip(keys.tolist(), missing.tolist(), strict=True)], offsets, ids


def write_binary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Encode and write; the manifest has one row a shard: shard, path, n_docs, n_tokens, base (ids before it)."""
    spark = docs.sparkSession
    folder = made_folder(spark, "token-ids")
    few = id_and_text(docs, id_col, text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer, added_tokens=added_tokens)
        width = 2 if max(len(encoder.ends_word) - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        keys, lengths, ids = [], [], []
        with collector_off():
            for block in in_blocks(rows(batches), 1):
                for (key, _), raw in zip(block, encoder.encode([t for _, t in block]), strict=True):
                    own = np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes() + end
                    keys.append(key)
                    lengths.append(len(own) // width)
                    ids.append(own)
        if keys:
            path = f"{folder}/{shard:07d}-{uuid.uuid4().hex}"
            write_shard(path, keys, lengths, ids, width)
            yield batch_of(pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]), [[shard], [path], [len(keys)], [sum(lengths)]])

    parts = few.repartitionByRange(shard_count(few, "text"), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(parts.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_binary(manifest: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, base in rows(batches):
            keys, offsets, ids = read_shard(path)
            ends = offsets.tolist()
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends, ends[1:], strict=False)]
            yield batch_of(DOCUMENT, [keys, offsets[:-1].astype("i8") + base, np.diff(offsets.astype("i8")), crc])

    files = manifest.select("path", "base").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
