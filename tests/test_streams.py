"""Streams over several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from racebook.operators import odds
from racebook.sources.adapters import Source
from racebook.streaming import odds as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Source(spark, SF)


@pytest.fixture(scope="module")
def folder(spark, t, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    t.events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ingest_from_a_folder(spark, t, folder):
    watch = t.watchlist.withColumn("deadline", F.col("deadline").cast("timestamp"))
    got = stream.drain(stream.before_deadline(stream.sample_stream(spark, folder), watch), "t-ingest")
    batch = t.odds_samples.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    want = stream.before_deadline(batch, watch)
    assert same(got.select("arrival", "odds"), want.select("arrival", "odds"))


def test_closed_bars_equal_batch_bars(spark, t, folder):
    got = stream.drain(stream.bars(stream.sample_stream(spark, folder)), "t-bars")
    valid = odds.valid_odds(t.odds_samples)
    end = valid.agg((F.max("fetched_at") - F.make_dt_interval(mins=F.lit(10))).alias("e")).first().e
    want = odds.bars(valid).filter(F.col("window_start") + F.make_dt_interval(mins=F.lit(5)) <= F.lit(end))
    cols = ["race_key", "combo", "open", "high", "low", "close", "n"]
    assert same(got.select(*cols), want.select(*cols))


def test_lifecycle_facts_over_micro_batches(spark, t, folder):
    samples = stream.sample_stream(spark, folder)
    got = stream.run_lifecycle(samples, "purchase", "error")
    batch = t.odds_samples.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    want = stream.lifecycle_facts(batch, "purchase", "error")
    assert same(got.select(*want.columns), want)


def test_first_wins_over_micro_batches(spark, t, folder):
    got = stream.run_first_wins(stream.sample_stream(spark, folder), ["race_key", "combo"])
    assert got.count() == t.odds_samples.select("race_key", "combo").distinct().count()
    assert got.count() == got.select("race_key", "combo").distinct().count()


def test_results_in_time_as_a_table(spark):
    f = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 10:00:00'), (2, TIMESTAMP '2024-01-01 11:59:00') AS v(race_key, saved_at)"
    )
    r = spark.sql(
        """SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 12:00:00'), (1, TIMESTAMP '2024-01-01 12:00:01'),
        (1, TIMESTAMP '2024-01-01 09:59:59'), (2, TIMESTAMP '2024-01-01 13:59:00') AS v(race_key, result_ts)"""
    )
    got = sorted((x.race_key, str(x.result_ts)) for x in stream.results_in_time(f, r).collect())
    assert got == [(1, "2024-01-01 12:00:00"), (2, "2024-01-01 13:59:00")]
