"""Raw odds samples and what is kept of them: roll up, then prune, without losing a sample.

Two stored tables: the samples, and one mergeable state per (race, combination) of interest. A run takes finished races whose newest
sample is older than the retention period, with all their samples. Their states are merged into those of earlier
runs, so samples that come after a race was rolled up are added to its summary and never replace it.

A run commits twice. The manifest of the states names the version of the samples they were made from and the races;
only then the samples of that version go. A run that ended in between leaves that note, and the next one first prunes what
it names: no sample counts twice and none is lost, also where new samples have been added meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.operators.joins import salted_join
from racebook.operators.odds import KEY, merged_states, outdated_races, series_state, summary_rows, target_combos
from racebook.sources.versioned import Table


class OddsArchive:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.samples, self.states = Table(spark, f"{self.root}/samples"), Table(spark, f"{self.root}/states")

    @classmethod
    def create(cls, samples: DataFrame, root: str, buckets: int = 16) -> OddsArchive:
        """``samples``: race_key, combo, odds, fetched_at, arrival."""
        archive = cls(samples.sparkSession, root)
        Table.create(samples, archive.samples.root, ["race_key"], buckets)
        Table.create(series_state(samples.limit(0)), archive.states.root, ["race_key"], buckets)
        return archive

    def add(self, samples: DataFrame) -> None:
        self.samples.append(samples)

    def summary(self, tickets: DataFrame, results: DataFrame) -> DataFrame:
        return summary_rows(self.states.read(), tickets, results)

    def roll_up(self, tickets: DataFrame, results: DataFrame, as_of: str, days: int = 7) -> int:
        """Roll up and prune what is due; rows of samples that went. Samples without a time go with their race: they
        count and have a price, and are neither first nor last."""
        freed = self._prune()
        version = self.samples.version()
        raw = self.samples.read(version)
        races = f"{self.root}/due/{uuid.uuid4().hex}"
        outdated_races(raw, results, as_of, days).distinct().write.parquet(races)
        due = self.spark.read.parquet(races)
        if due.isEmpty():
            return freed
        wanted = target_combos(tickets, results).select(*KEY)
        kept = salted_join(salted_join(raw, due, "race_key", "left_semi", "arrival"), wanted, KEY, "left_semi", "arrival")
        self.states.merge(series_state(kept), merged_states, {"samples_version": version, "races": races, "pruned": False})
        return freed + self._prune()

    def _prune(self) -> int:
        """Take away the samples that the states hold and the samples table still does."""
        notes = self.states.notes()
        if notes.get("pruned", True):
            return 0
        freed = 0
        if self.samples.notes().get("pruned_for") != notes["races"]:  # else only the last note is missing
            races = self.spark.read.parquet(notes["races"])
            freed = self.samples.delete(races, ["race_key"], {"pruned_for": notes["races"]}, at=notes["samples_version"])
        self.states.note(pruned=True)
        return freed
