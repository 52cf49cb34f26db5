"""Stored tables that change in place for their readers.

Rows lie in buckets of their key. A change reads and rewrites the buckets it touches and no others; new files go into a new folder, and
a small manifest says which folders make up each bucket. Publishing the manifest of the next
version is the switch: it is moved into place and never replaces one that is there, so a reader sees the old version
or the new one, and of two writers one has to look again. A lost executor or a failed job leaves files that no manifest names.

A bucket that a busy key makes large is written by several tasks: Spark rebalances the rows by bucket and splits what
is too large. What reaches the driver is one row a touched bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from racebook.operators.joins import first_per_key, last_per_key

BUCKET = "store_bucket"
#: Folders of one bucket before ``append`` calls for ``compact``.
FOLDERS = 8


class VersionConflict(Exception):
    """Another writer published this version first."""


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under a temporary name and move it into place; False if there is one already."""
    place, files = _file_system(spark, path)
    jvm = spark.sparkContext._jvm
    tmp, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(tmp, place, no_overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        files.delete(tmp, False)
        return False
    return True


class Table:
    """A stored table with a key; ``notes`` are small facts that a writer publishes with its change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, root: str, keys: list[str], buckets: int = 16) -> Table:
        table = cls(rows.sparkSession, root)
        start = {"schema": rows.schema.json(), "keys": keys, "buckets": buckets, "folders": {}, "notes": {}}
        if not table._publish(0, start | {"folders": {b: [f] for b, f in table._written(rows, start).items()}}):
            raise VersionConflict(root)
        return table

    # --- manifests

    def _path(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def _publish(self, version: int, manifest: dict) -> bool:
        return publish(self.spark, self._path(version), json.dumps(manifest))

    def version(self) -> int:
        place, files = _file_system(self.spark, f"{self.root}/versions")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return max((int(n[:12]) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        path = self._path(self.version() if version is None else version)
        return json.loads(self.spark.read.text(path, wholetext=True).first().value)

    def notes(self) -> dict:
        return self.manifest()["notes"]

    def row_counts(self, version: int | None = None) -> dict[str, int]:
        return {b: sum(n for _, n in folders) for b, folders in self.manifest(version)["folders"].items()}

    # --- rows

    @staticmethod
    def _bucket(m: dict) -> Column:
        return F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"])).cast("int")

    def _written(self, rows: DataFrame, m: dict) -> dict[str, list]:
        """Bucket -> its new folder and the rows in it."""
        out = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(m)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(out)
        schema = StructType.fromJson(json.loads(m["schema"])).add(BUCKET, IntegerType())
        counts = self.spark.read.schema(schema).parquet(out).groupBy(BUCKET).count().collect()  # one row a bucket
        return {str(r[BUCKET]): [f"{out}/{BUCKET}={r[BUCKET]}", r["count"]] for r in counts}

    def _rows(self, m: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m["schema"]))
        chosen = m["folders"] if buckets is None else {b: m["folders"].get(b, []) for b in buckets}
        paths = [p for folders in chosen.values() for p, _ in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _touched(self, keyed: DataFrame, m: dict) -> list[str]:
        return [str(r.b) for r in keyed.select(self._bucket(m).alias("b")).distinct().collect()]

    def _change(self, keyed: DataFrame, rewrite: Callable[[DataFrame], DataFrame], notes: dict | None, at: int | None = None) -> int:
        """Rewrite the buckets of the keys of ``keyed``; rows taken away (below zero: added). Folders that came after
        version ``at`` stay as they are."""
        base = self.version()
        m = self.manifest(base)
        seen = m if at is None else self.manifest(at)
        touched = [b for b in self._touched(keyed, m) if at is None or b in seen["folders"]]
        gone = {b: [p for p, _ in seen["folders"].get(b, [])] for b in touched}
        if any(p not in [x for x, _ in m["folders"].get(b, [])] for b, paths in gone.items() for p in paths):
            raise VersionConflict(f"{self.root}: buckets of version {at} have been rewritten since")
        new = self._written(rewrite(self._rows(seen, touched)), m) if touched else {}
        folders = {b: f for b, f in m["folders"].items() if b not in touched}
        for b in touched:
            folders[b] = [f for f in m["folders"].get(b, []) if f[0] not in gone[b]] + ([new[b]] if b in new else [])
        for b in set(new) - set(touched):
            raise ValueError(f"a rewritten row moved to bucket {b}")
        self._commit(base, m | {"folders": {b: f for b, f in folders.items() if f}, "notes": m["notes"] | (notes or {})})
        before = sum(n for b in touched for p, n in m["folders"].get(b, []) if p in gone[b])
        return before - sum(n for _, n in new.values())

    def _commit(self, base: int, manifest: dict) -> None:
        if not self._publish(base + 1, manifest):
            raise VersionConflict(f"{self.root}: version {base + 1}")

    # --- changes

    def note(self, **notes) -> None:
        """Publish facts without a change of rows."""
        base = self.version()
        m = self.manifest(base)
        self._commit(base, m | {"notes": m["notes"] | notes})

    def append(self, rows: DataFrame, notes: dict | None = None, after: int | None = None) -> None:
        """Add rows as they are; files that are there stay. The files are written once, also where another writer comes
        first. With ``after``, nobody may have come after that version."""
        base = self.version() if after is None else after
        m = self.manifest(base)
        new = self._written(rows, m)
        while True:
            folders = {b: list(f) for b, f in m["folders"].items()}
            for b, folder in new.items():
                folders.setdefault(b, []).append(folder)
            if self._publish(base + 1, m | {"folders": folders, "notes": m["notes"] | (notes or {})}):
                return
            if after is not None:
                raise VersionConflict(f"{self.root}: version {base + 1}")
            base = self.version()
            m = self.manifest(base)

    def compact(self) -> None:
        """Rewrite buckets of many folders as one each, so reading never depends on the number of appends."""
        base = self.version()
        m = self.manifest(base)
        many = [b for b, f in m["folders"].items() if len(f) >= FOLDERS]
        if many:
            new = self._written(self._rows(m, many), m)
            self._commit(base, m | {"folders": {b: [new[b]] if b in new else f for b, f in m["folders"].items()}})

    def upsert(self, changes: DataFrame, order: str, notes: dict | None = None) -> int:
        """The row with the highest ``order`` stays per key; rows added."""
        keys = self.manifest()["keys"]
        return -self._change(changes, lambda old: last_per_key(old.unionByName(changes), keys, [order]), notes)

    def merge(self, changes: DataFrame, merged: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> int:
        """Old and new rows of the touched buckets, combined by ``merged``; rows added."""
        return -self._change(changes, lambda old: merged(old.unionByName(changes)), notes)

    def insert_if_absent(self, rows: DataFrame, order: list[str], notes: dict | None = None) -> None:
        """The first row in ``order`` of every key that the table does not hold; reads the keys of touched buckets alone."""
        base = self.version()
        m = self.manifest(base)
        first = first_per_key(rows, m["keys"], order).select(*StructType.fromJson(json.loads(m["schema"])).names).persist()
        held = self._rows(m, self._touched(first, m)).select(*[F.col(k).alias(f"held_{k}") for k in m["keys"]])
        same = [F.col(k).eqNullSafe(F.col(f"held_{k}")) for k in m["keys"]]
        self.append(first.join(held, same, "left_anti"), notes, after=base)
        first.unpersist()
        self.compact()

    def delete(self, gone: DataFrame, on: list[str] | None = None, notes: dict | None = None, at: int | None = None) -> int:
        """Rows of the keys in ``gone`` go, or those they match in ``on`` (which must hold the key); rows taken away.

        With ``at``, only rows that the table held in that version."""
        keys = on or self.manifest()["keys"]
        gone = gone.select(*keys).distinct()
        return self._change(gone, lambda old: old.join(gone, keys, "left_anti"), notes, at)

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the last ``keep`` and the folders that only those named."""
        last = self.version()
        older = range(max(0, last - keep + 1))
        named = {p for v in range(max(0, last - keep + 1), last + 1) for f in self.manifest(v)["folders"].values() for p, _ in f}
        for v in older:
            place, files = _file_system(self.spark, self._path(v))
            if files.exists(place):
                for p in {p for f in self.manifest(v)["folders"].values() for p, _ in f} - named:
                    files.delete(_file_system(self.spark, p)[0], True)
                files.delete(place, False)
