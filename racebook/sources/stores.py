"""Table writes as set operations: upsert, insert-if-absent, delete, roll-up before prune.

These work on any DataFrame and give a new one. ``versioned`` has the same changes for stored tables, which rewrite
only what they touch, and ``archive`` the roll-up of a stored table of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.operators.joins import first_per_key, last_per_key
from racebook.operators.odds import added_summaries, of_races, outdated_races, rollup, without_races
from racebook.session import fresh_path


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a fresh shared path and return the stored table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str]) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both; the one with the highest ``order`` stays per key."""
    return last_per_key(table.unionByName(changes), keys, [order])


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table plus, for every key it does not hold, the first row of ``new`` in ``order`` (all columns by default)."""
    first = first_per_key(new, keys, order or [c for c in new.columns if c not in keys])
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def delete_by_key(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def deactivate(watch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Switch the flag off for finished keys."""
    flagged = done.select(*keys).distinct().withColumn("_done", F.lit(True))
    return watch.join(flagged, keys, "left").withColumn(
        "active", F.col("active") & F.col("_done").isNull()
    ).drop("_done")


def rollup_then_prune(
    samples: DataFrame,
    tickets: DataFrame,
    results: DataFrame,
    as_of: str,
    days: int = 7,
    summary: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stored summary and the remaining raw samples, for tables that are no ``OddsArchive``.

    Finished races whose newest sample is older than the retention period are rolled up and pruned
    as a whole, samples without a time among them; a race with later samples waits. Rows are added to those of an
    earlier ``summary`` with the same race and combination. Raw rows go only after the summary has been written; a
    failed write leaves them for the next run. A finished race without any target is pruned as well.
    """
    races = outdated_races(samples, results, as_of, days)
    due, left = of_races(samples, races), without_races(samples, races)
    new = rollup(due, tickets, results)
    if summary is not None:
        new = added_summaries(summary, new)
    return store(new, "odds_summary"), left


def freed(before: DataFrame, after: DataFrame) -> int:
    """Raw rows that a pruning run took away."""
    return before.count() - after.count()


# --- fixed values: display names of the ticket export
TICKET_HEADER = {
    "combo": "買い目",
    "prob": "的中確率",
    "odds": "オッズ",
    "expected_return": "期待値",
    "group": "区分",
    "stake": "購入額",
    "stake_reason": "配分理由",
}
BOM = "﻿"


def export_tickets(tickets: DataFrame, path: str) -> None:
    """CSV for spreadsheets: byte order mark, display names, combinations kept as text."""
    cols = [c for c in tickets.columns if c in TICKET_HEADER]
    rest = [c for c in tickets.columns if c not in TICKET_HEADER]
    text = tickets.withColumn("combo", F.concat(F.lit("'"), F.col("combo"))).select(*cols, *rest)
    names = [TICKET_HEADER[c] for c in cols] + rest
    names[0] = BOM + names[0]
    text.toDF(*names).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header and a fixed schema; rows that do not fit give NULLs."""
    return spark.read.schema(ddl).option("header", True).option("mode", "PERMISSIVE").csv(path)


REJECT = "_reject"


def scan_csv(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV with a header that fit the schema, and the rejects: the raw text of all other lines.

    The text is parsed once into a stored table, from which both are read, so no line can be in both or in none. A line
    with a value that does not fit its type, or with more or fewer fields than the schema, is a reject.
    """
    parsed = (
        spark.read.schema(f"{ddl}, {REJECT} STRING")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECT)
        .csv(path)
    )
    both = store(parsed, "csv-scan")
    rejected = F.col(REJECT).isNotNull()
    return both.filter(~rejected).drop(REJECT), both.filter(rejected).select(F.col(REJECT).alias("line"))
