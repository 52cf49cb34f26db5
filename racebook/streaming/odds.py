"""Streams of odds samples: ingest, bars, lifecycle, first-wins and result joins.

Every stream reads the sample folder as it grows and runs until what is there has been
processed; on a cluster the trigger is a matter of deployment. State is kept under the shared
checkpoint folder, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.scalars import instant
from racebook.operators.joins import first_per_key, last_per_key, salted_join
from racebook.operators.odds import sample_order, valid_odds
from racebook.session import fresh_path
from racebook.sources.versioned import Table


def sample_stream(spark: SparkSession, path: str) -> DataFrame:
    """Samples as they arrive, with event time ``fetched_at``.

    The pattern makes one file and a folder of files equally good sources.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*").select(
        F.col("user_id").alias("race_key"),
        F.col("event_type").alias("combo"),
        F.col("value").alias("odds"),
        instant(F.col("ts")).alias("fetched_at"),
        F.col("event_id").alias("arrival"),
    )


def drain(stream: DataFrame, name: str, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Run the stream over all available input into Parquet and return what was written."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .partitionBy(*(partition_by or []))
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, name + "-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(
    stream: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int], None], progress: str | None = None
) -> None:
    """Run the stream and hand every micro-batch to ``write``; with a ``progress`` folder a later run goes on from there."""
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", progress or fresh_path(stream.sparkSession, name + "-state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def before_deadline(samples: DataFrame, watch: DataFrame) -> DataFrame:
    """Valid samples of watched races taken before the deadline; later ones are not stored."""
    active = watch.filter("active").select("race_key", "deadline")
    rows = salted_join(valid_odds(samples), active, "race_key", "inner", "arrival")
    return rows.filter(F.col("fetched_at") < F.col("deadline")).drop("deadline")


def bars(
    samples: DataFrame, width: str = "5 minutes", wait: str = "10 minutes", tie: str | None = "arrival"
) -> DataFrame:
    """Open, high, low, close per closed window; samples later than ``wait`` are dropped."""
    order = sample_order(tie)
    return (
        valid_odds(samples)
        .withWatermark("fetched_at", wait)
        .groupBy("race_key", "combo", F.window("fetched_at", width))
        .agg(
            F.min_by("odds", order).alias("open"),
            F.max("odds").alias("high"),
            F.min("odds").alias("low"),
            F.max_by("odds", order).alias("close"),
            F.count("odds").alias("n"),
        )
        .select("race_key", "combo", F.col("window.start").alias("window_start"), "open", "high", "low", "close", "n")
    )


def lifecycle_facts(samples: DataFrame, snapshot: str, result: str) -> DataFrame:
    """What decides the state of a race, as a running aggregate.

    The state itself follows from these facts, the deadline and the clock. Keeping facts rather
    than a per-race routine lets Spark combine on the map side, so a busy race costs one row.
    """
    at = lambda kind: F.when(F.col("combo") == kind, F.col("fetched_at"))
    return samples.groupBy("race_key").agg(
        F.min("fetched_at").alias("created_at"),
        F.max("fetched_at").alias("last_seen"),
        F.min(at(snapshot)).alias("snapshot_at"),
        F.max(at(result)).alias("result_at"),
    )


def run_lifecycle(samples: DataFrame, snapshot: str, result: str) -> DataFrame:
    """Facts per race after all input, one version per micro-batch; the last version counts."""
    facts = lifecycle_facts(samples, snapshot, result)
    spark, out = facts.sparkSession, fresh_path(facts.sparkSession, "lifecycle")

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a repeated batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    drain_batches(facts, "lifecycle", "update", write)
    return last_per_key(spark.read.parquet(out), ["race_key"], ["version"]).drop("version")


def run_first_wins(samples: DataFrame, keys: list[str], root: str | None = None, buckets: int = 16) -> DataFrame:
    """First sample per key; a key that is stored already stays as it is.

    A micro-batch is first reduced to one row per key, then meets the keys stored in the buckets it touches and
    adds a folder to those it has something new for; buckets of many folders are compacted. So the work of a batch follows
    from its keys and their buckets, not from the number of batches before. The table notes the batch it took last:
    a batch that is run again, and a job that starts again with the same ``root``, add nothing twice.
    """
    spark = samples.sparkSession
    root = root or fresh_path(spark, "first-wins")
    table = Table(spark, f"{root}/table")

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.version() < 0:
            Table.create(batch.limit(0), table.root, keys, buckets)
        if table.notes().get("batch", -1) < batch_id:
            table.insert_if_absent(batch, ["fetched_at", "arrival"], {"batch": batch_id})

    drain_batches(samples, "first-wins", "append", write, f"{root}/progress")
    return table.read() if table.version() >= 0 else spark.createDataFrame([], samples.schema)


def first_within(samples: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One sample per key where copies come at most ``delay`` apart: the state forgets a key after that time, so it
    is bounded by the rate of keys. The first copy that is met stays."""
    return samples.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(keys)


def results_in_time(snapshots: DataFrame, results: DataFrame, minutes: int = K.RESULT_WAIT_MINUTES) -> DataFrame:
    """Frozen predictions joined to results at most ``minutes`` later, for tables and streams.

    Rows meet on the race and a time cell as wide as the wait; a snapshot stands in its own cell
    and the next. A race with very many rows spreads over its cells.
    """
    width = minutes * 60
    cell = lambda c: F.floor(F.unix_seconds(c) / width)
    left = snapshots.withColumn("cell", F.explode(F.array(cell(F.col("saved_at")), cell(F.col("saved_at")) + 1)))
    right = results.withColumnRenamed("race_key", "result_race").withColumn("result_cell", cell(F.col("result_ts")))
    on = (
        (F.col("race_key") == F.col("result_race"))
        & (F.col("cell") == F.col("result_cell"))
        & (F.col("result_ts") >= F.col("saved_at"))
        & (F.col("result_ts") <= F.col("saved_at") + F.make_dt_interval(mins=F.lit(minutes)))
    )
    return left.join(right, on).drop("cell", "result_cell", "result_race")
