"""A stream into two stored tables: what can be used, and what is held for another try.

In every micro-batch a race with any unusable row is held whole, with the reason; the other races go on. Each table
notes the last batch it took, so a batch that runs again adds nothing to either. Held races are replayed after a
repair: those that are usable now move over, the others stay held. The move is two commits, first in, then out, and
the note of the first lets the next replay finish a move that ended in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.operators.joins import salted_join
from racebook.sources.versioned import Table
from racebook.streaming.odds import drain_batches

NO_RACE = "no race"


class Intake:
    """``stored`` and ``held`` below one folder. ``reason`` is null for a usable row, else says what is wrong."""

    def __init__(self, spark: SparkSession, root: str, reason: Column, spread: str = "arrival"):
        self.spark, self.root, self.spread = spark, root.rstrip("/"), spread
        self.reason = F.when(F.col("race_key").isNull(), NO_RACE).otherwise(reason)
        self.stored, self.held = Table(spark, f"{self.root}/stored"), Table(spark, f"{self.root}/held")

    def _ready(self, rows: DataFrame) -> None:
        none = rows.limit(0)
        for table, empty in ((self.stored, none.withColumn("replayed", F.lit(False))), (self.held, none.withColumns({"reason": F.lit(""), "batch": F.lit(0).cast("long")}))):
            if table.version() < 0:
                Table.create(empty, table.root, ["race_key"])

    def _divided(self, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of groups without an unusable one, and all others with the least reason of their group."""
        judged = rows.withColumn("reason", self.reason)
        bad = judged.filter("reason IS NOT NULL AND race_key IS NOT NULL").groupBy(*by).agg(F.min("reason").alias("why"))
        good = salted_join(rows.filter("race_key IS NOT NULL"), bad.select(*by), by, "left_anti", self.spread)
        held = salted_join(rows.filter("race_key IS NOT NULL"), bad, by, "inner", self.spread).withColumnRenamed("why", "reason")
        lost = rows.filter("race_key IS NULL").withColumn("reason", F.lit(NO_RACE))
        return good, held.unionByName(lost)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch into both tables, each of them once."""
        self._ready(batch)
        good, bad = self._divided(batch, ["race_key"])
        if self.stored.notes().get("batch", -1) < batch_id:
            self.stored.append(good.withColumn("replayed", F.lit(False)), {"batch": batch_id})
        if self.held.notes().get("batch", -1) < batch_id:
            self.held.append(bad.withColumn("batch", F.lit(batch_id).cast("long")), {"batch": batch_id})

    def run(self, stream: DataFrame) -> None:
        """Everything the stream has now; a later call, with the same folder, goes on from there."""
        drain_batches(stream, "intake", "append", self.take, f"{self.root}/progress")

    def replay(self, repair: Callable[[DataFrame], DataFrame]) -> None:
        """Try held races again. ``repair`` gives the rows as they should be, with the same columns."""
        self._finish()
        version = self.held.version()
        rows = repair(self.held.read(version))
        good, _ = self._divided(rows.drop("reason"), ["race_key", "batch"])
        moved = f"{self.root}/moved/{version}"
        good.select("race_key", "batch").distinct().write.mode("overwrite").parquet(moved)
        self.stored.append(good.drop("batch").withColumn("replayed", F.lit(True)), {"moved": moved, "moved_version": version})
        self._finish()

    def _finish(self) -> None:
        """Take races out of the held table that the stored one has."""
        notes = self.stored.notes()
        if "moved" in notes and self.held.notes().get("moved") != notes["moved"]:
            gone = self.spark.read.parquet(notes["moved"])
            self.held.delete(gone, ["race_key", "batch"], {"moved": notes["moved"]}, at=notes["moved_version"])
