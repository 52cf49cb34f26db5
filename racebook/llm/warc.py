"""Deterministic sharded WARC archives.

Records are sorted by key into ranges; one task writes the files of one range and begins a new file when the
compressed bytes reach a limit. Every record is a gzip member of its own without time stamps, and headers,
record ids and digests are made anew from key, address and payload, so the same table gives the same bytes.
Files appear under their name by a move; the manifest, written after all, names the files that count.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest key holds the payload
and the others are revisits that name it. Payloads meet by digest in a map-side aggregate; only digests that
occur twice join back, and that join Spark can split at a hot digest.

A null payload is empty and a null address leaves its header out. Rows that repeat a key and a payload are
written each and share the kind of their key. A null key comes first in the archive, has no key header, and is
a response unless an equal payload has a key. An empty table gives no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racebook.llm.common import batch_of, file_system, made_folder, put, rows, shard_count, stored

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16 << 20
#: Date of all records; a parameter, since a clock would make every run differ.
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

FILE = pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
MANIFEST = "shard int, file int, path string, n_records long, n_bytes long, sha256 string"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def member(headers: dict[str, object], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    whole = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0)


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    own, size = digest(payload), len(payload)
    head = HTTP_HEAD.format(size).encode()
    block = head + (b"" if refers_to is not None else payload)
    return member(
        {
            "WARC-Type": "response" if refers_to is None else "revisit",
            "WARC-Record-ID": record_id("record", key, own),
            "WARC-Date": date,
            "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"),
            "Content-Type": "application/http;msgtype=response",
            "WARC-Payload-Digest": f"sha1:{own}",
            "WARC-Block-Digest": f"sha1:{digest(block)}",
            "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
            "WARC-Refers-To": None if refers_to is None else record_id("record", refers_to, own),
            "X-Key": key,
            "X-Refers-To-Key": refers_to,
            "X-Payload-Length": size,
        },
        block,
    )


def with_first(records: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``refers_to``: the smallest key among equal payloads where the record's own key is another."""
    keyed = records.withColumn("same", F.sha2("payload", 256))
    seen = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n"))
    repeated = stored(seen.where("n > 1 and first_key is not null").select("same", "first_key"), "warc-repeated")
    other = F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return keyed.join(repeated, "same", "left").select("key", "url", "payload", F.when(other, F.col("first_key")).alias("refers_to"))


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives and return their manifest, one row a file."""
    folder = made_folder(pages.sparkSession, "warc")
    records = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    ordered = with_first(records, min_bytes).repartitionByRange(shard_count(records, "payload", 4 * roll_bytes // 8), "key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{shard:07d}-{number:05d}.warc.gz"
            info = member({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", shard, number), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            data = info + b"".join(held)
            put(path, data)
            return batch_of(FILE, [[shard], [number], [path], [n], [len(data)], [hashlib.sha256(data).hexdigest()]])

        for k, u, p, refers_to in rows(batches):
            held.append(record(k, u, p, refers_to, date))
            n, size = n + 1, size + len(held[-1])
            if size >= roll_bytes:
                yield close()
                number, held, n, size = number + 1, [], 0, 0
        if held:
            yield close()

    return stored(ordered.sortWithinPartitions("key", "url", "refers_to", "payload").mapInArrow(write, MANIFEST), "warc-manifest")


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as archive:
        while line := archive.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no record begins with {line[:40]!r}")
            headers = {}
            while (line := archive.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            block = archive.read(int(headers["Content-Length"]))
            if archive.read(4) != b"\r\n\r\n":
                raise ValueError("a record has no end")
            yield headers, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row a response or revisit; digests of what is stored are checked. Revisits have no payload."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path,) in rows(batches):
            files, inner = file_system(path)
            with files.open_input_stream(inner, compression=None) as stream:
                out, size = [], 0
                for headers, block in parse(stream):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"{path}: a block differs from its digest")
                    own, payload = headers["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if digest(payload) != own or len(payload) != int(headers["X-Payload-Length"]):
                            raise ValueError(f"{path}: a payload differs from its headers")
                    out.append((number(headers.get("X-Key")), headers.get("WARC-Target-URI"), int(headers["X-Payload-Length"]), own, kind, number(headers.get("X-Refers-To-Key")), payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(RECORD, list(zip(*out, strict=True)))
                        out, size = [], 0
                if out:
                    yield batch_of(RECORD, list(zip(*out, strict=True)))

    files = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return files.mapInArrow(read, RECORDS)
