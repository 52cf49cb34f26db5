"""Stored tables that change by bucket, and the archive of samples on top of them."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from racebook import session
from racebook.operators import odds
from racebook.sources import archive as archives
from racebook.sources import stores
from racebook.sources.archive import OddsArchive
from racebook.sources.versioned import FOLDERS, Table, VersionConflict, publish

SAMPLES = "race_key LONG, combo STRING, odds DOUBLE, fetched_at TIMESTAMP_NTZ, arrival LONG"
BETS = "race_key LONG, combo STRING, stake INT, ticket_group STRING, ai_prob DOUBLE"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def numbers(spark, keys, value, seq=1):
    return spark.createDataFrame([(k, value, seq) for k in keys], "k LONG, v STRING, seq INT")


def test_upsert_rewrites_touched_buckets_alone(spark, root):
    table = Table.create(numbers(spark, range(100), "old"), root, ["k"], buckets=8)
    before = table.manifest()["folders"]
    assert table.upsert(numbers(spark, [3, 1000, None], "new", 2), "seq") == 2
    after = table.manifest()["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and all(after[b] == before[b] for b in before if b not in changed)
    assert all(os.path.isdir(p) for f in before.values() for p, _ in f)  # files of the version before are still there
    want = {k: "old" for k in range(100)} | {3: "new", 1000: "new", None: "new"}
    assert {r.k: r.v for r in table.read().collect()} == want
    assert {r.v for r in table.read(version=0).collect()} == {"old"}
    assert table.upsert(numbers(spark, [3], "stale", 1), "seq") == 0
    assert {r.k: r.v for r in table.read().collect()} == want
    assert sum(table.row_counts().values()) == 102


def test_delete_counts_rows(spark, root):
    table = Table.create(numbers(spark, [1, 1, 2, 3, None], "x"), root, ["k"], buckets=4)
    assert table.delete(numbers(spark, [1, 1, 9], "")) == 2
    assert table.delete(numbers(spark, [1, 9], "")) == 0
    assert [r[0] for r in rows_of(table)] == [2, 3, None]
    assert table.delete(numbers(spark, [2, 3], "")) == 2
    assert table.delete(numbers(spark, [], "")) == 0
    empty = Table.create(numbers(spark, [], "x"), root + "-empty", ["k"])
    assert empty.read().count() == 0 and empty.delete(numbers(spark, [1], "")) == 0
    empty.append(numbers(spark, [5], "y"))
    assert rows_of(empty) == [(5, "y", 1)]


def test_first_wins_and_files_that_stay(spark, root):
    table = Table.create(numbers(spark, range(20), "first"), root, ["k"], buckets=4)
    for i in range(2 * FOLDERS):
        table.insert_if_absent(numbers(spark, [5, 100 + i], "later", 9).unionByName(numbers(spark, [100 + i], "sooner", 8)), ["seq"])
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {k: "first" for k in range(20)} | {100 + i: "sooner" for i in range(2 * FOLDERS)}
    assert max(len(f) for f in table.manifest()["folders"].values()) < FOLDERS + 1
    table.vacuum(keep=1)
    assert {r.k for r in table.read().collect()} == set(got)
    kept = {p for f in table.manifest()["folders"].values() for p, _ in f}
    assert all(os.path.isdir(p) for p in kept)


def test_two_writers(spark, root):
    assert publish(spark, root + "/versions/000000000000.json", "{}") and not publish(spark, root + "/versions/000000000000.json", "[]")
    table = Table.create(numbers(spark, [1], "a"), root + "-t", ["k"], buckets=2)
    with pytest.raises(VersionConflict):
        Table.create(numbers(spark, [1], "b"), root + "-t", ["k"])

    def meanwhile(old):
        Table(spark, table.root).append(numbers(spark, [2], "other"))
        return old.withColumn("v", F.lit("mine"))

    with pytest.raises(VersionConflict):
        table._change(numbers(spark, [1], ""), meanwhile, None)
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "a"), (2, "other")}
    table.append(numbers(spark, [3], "late"))
    assert not [n for n in os.listdir(table.root + "/versions") if n.endswith(".tmp")]


def test_states_merge_in_any_division(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), rng.choice("ab"), rng.choice([0.5, 1.5, 2.0, 8.0]), dt.datetime(2024, 1, rng.randint(1, 3)), i) for i in range(200)]
    whole = odds.series_state(spark.createDataFrame(rows, SAMPLES))
    rng.shuffle(rows)
    parts = [odds.series_state(spark.createDataFrame(rows[a:b], SAMPLES)) for a, b in ((0, 1), (1, 90), (90, 200))]
    merged = odds.merged_states(odds.merged_states(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def day(d, h=0):
    return dt.datetime(2024, 1, d, h)


def tables(spark):
    bets = spark.createDataFrame([(k, "1-2-3", 100, "本線", 0.2) for k in (1, 2, 3)], BETS)
    done = spark.createDataFrame([(1, "1-2-3"), (3, "6-5-4")], "race_key LONG, actual_combo STRING")
    return bets, done


FIRST = [(1, "1-2-3", 10.0, day(10), 1), (1, "1-2-3", 8.0, day(16), 2), (2, "1-2-3", 5.0, day(10), 3), (3, "1-2-3", 4.0, day(9), 4), (3, "6-5-4", 7.0, day(9), 6), (3, "9-9-9", 7.0, day(9), 8), (3, "1-2-3", 6.0, None, 5)]


def test_late_samples_are_added(spark, root):
    bets, done = tables(spark)
    archive = OddsArchive.create(spark.createDataFrame(FIRST, SAMPLES), root, buckets=3)
    assert archive.roll_up(bets, done, "2024-01-20") == 4  # race 3 whole, its sample without a time included
    assert sorted(r.arrival for r in archive.samples.read().collect()) == [1, 2, 3]
    late = [(3, "1-2-3", 9.0, day(8), 20), (3, "1-2-3", 2.0, day(9), 21), (1, "1-2-3", 8.5, day(17, 5), 22)]
    archive.add(spark.createDataFrame(late, SAMPLES))
    assert archive.roll_up(bets, done, "2024-01-25") == 5
    assert archive.roll_up(bets, done, "2024-01-25") == 0
    assert [r.arrival for r in archive.samples.read().collect()] == [3]
    every = odds.rollup(spark.createDataFrame(FIRST + late, SAMPLES), bets, done)
    got = archive.summary(bets, done)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect())) and got.count() == 3


@pytest.mark.parametrize("fails", ["delete", "note"])
def test_a_run_that_ends_between_its_commits(spark, root, monkeypatch, fails):
    bets, done = tables(spark)
    archive = OddsArchive.create(spark.createDataFrame(FIRST, SAMPLES), root, buckets=2)
    with monkeypatch.context() as m:
        def lost(self, *a, **k):
            raise RuntimeError("lost")
        m.setattr(archives.Table, fails, lost)
        with pytest.raises(RuntimeError):
            archive.roll_up(bets, done, "2024-01-30")
    again = OddsArchive(spark, root)
    late = [(1, "1-2-3", 3.0, day(15), 30)]
    again.add(spark.createDataFrame(late, SAMPLES))
    again.roll_up(bets, done, "2024-01-30")
    assert [r.arrival for r in again.samples.read().collect()] == [3]
    every = odds.rollup(spark.createDataFrame(FIRST + late, SAMPLES), bets, done)
    got = again.summary(bets, done)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select(got.columns).collect()))


def test_a_race_on_both_sides_of_the_cutoff(spark):
    """Through the store without an archive as well: two runs give the summary of all samples."""
    bets, done = tables(spark)
    samples = spark.createDataFrame([r for r in FIRST if r[3]], SAMPLES)
    first, left = stores.rollup_then_prune(samples, bets, done, "2024-01-20")
    late = spark.createDataFrame([(3, "1-2-3", 9.0, day(8), 20)], SAMPLES)
    second, left = stores.rollup_then_prune(left.unionByName(late), bets, done, "2024-01-25", summary=first)
    every = odds.rollup(samples.unionByName(late), bets, done)
    assert sorted(map(str, second.collect())) == sorted(map(str, every.select(second.columns).collect()))


def test_a_race_with_a_third_of_all_samples(spark, root):
    samples = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("race_key"), F.lit("1-2-3").alias("combo"),
        (F.col("id") % 50 + 1).cast("double").alias("odds"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("fetched_at"), F.col("id").alias("arrival"))
    done = samples.select("race_key").distinct().withColumn("actual_combo", F.lit("1-2-3"))
    archive = OddsArchive.create(samples, root, buckets=4)
    bets = spark.createDataFrame([], BETS)
    assert archive.roll_up(bets, done, "2024-01-30") == 60_000
    assert archive.summary(bets, done).agg(F.sum("n_samples")).first()[0] == 60_000


def test_shared_folder_without_a_setting(spark, monkeypatch):
    """A local session whose defaults name no folder gets one of its own, again the same; a cluster has to name one."""

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = "file:" + path + "/x"

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), Context(master)

    for master in ("local", "local[2]"):
        s = Session(master)
        assert session.shared_dir(s) == session.shared_dir(s) != ""
    for master in ("yarn", "spark://host:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(Session(master))
    assert isinstance(spark, SparkSession) and session.shared_dir(spark)


def test_lines_that_do_not_fit_are_rejects(spark, tmp_path):
    lines = ["combo,odds", "1-2-3,12.5", "1-2-4,n/a", "1-3-2", "2-1-3,4.0,extra", "", "3-2-1,", '"4-5-6",7', "5-4-6,1e2"]
    (tmp_path / "odds.csv").write_text("\n".join(lines) + "\n")
    rows, rejects = stores.scan_csv(spark, str(tmp_path / "odds.csv"), "combo STRING, odds DOUBLE")
    assert sorted(map(tuple, rows.collect()), key=str) == [("1-2-3", 12.5), ("3-2-1", None), ("4-5-6", 7.0), ("5-4-6", 100.0)]
    assert sorted(r.line for r in rejects.collect()) == ["1-2-4,n/a", "1-3-2", "2-1-3,4.0,extra"]
    (tmp_path / "none.csv").write_text("combo,odds\n")
    rows, rejects = stores.scan_csv(spark, str(tmp_path / "none.csv"), "combo STRING, odds DOUBLE")
    assert rows.count() == rejects.count() == 0
