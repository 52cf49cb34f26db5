"""Streams that keep state: lifecycles by timers, held races, first samples in a store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from racebook.streaming import lifecycle, quarantine
from racebook.streaming import odds as stream
from racebook.streaming.quarantine import Intake

SAMPLES = "race_key LONG, combo STRING, odds DOUBLE, fetched_at TIMESTAMP, arrival LONG"
NO_DEADLINE = "race_key LONG, deadline TIMESTAMP"


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def write(spark, path, rows):
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(path)


def plain_moves(rows, deadlines, wait, longest, late):
    """Transitions by going through each race once, up to the watermark."""
    out, mark = [], max(t for _, _, t in rows) - late
    for race, deadline in deadlines.items():
        own = sorted((t, c) for r, c, t in rows if r == race and (deadline is None or t <= deadline + wait))
        if not own:
            continue
        created = own[0][0]
        moves = [("ACTIVE", created)]
        if deadline is None:
            moves.append(("TIMEOUT", created + longest))
        elif not any(c == "freeze" and t <= deadline for t, c in own):
            moves.append(("DONE", max(deadline, created)))
        else:
            moves.append(("WAIT_RESULT", deadline))
            result = min((t for t, c in own if c == "result" and t >= deadline), default=None)
            moves.append(("DONE", result) if result is not None else ("TIMEOUT", deadline + wait))
        out += [(race, s, t) for s, t in moves if t <= mark]
    return sorted(out)


@pytest.fixture(scope="module")
def races():
    rng = random.Random(12)
    deadlines = {k: (None if k % 7 == 0 else rng.randint(50, 700)) for k in range(1, 41)}
    rows = []
    for k, d in deadlines.items():
        first = rng.randint(0, 900) if d is None else max(0, d - rng.randint(0, 300))
        for t in range(first, (first + 150) if d is None else d + rng.randint(0, 150), rng.randint(5, 40)):
            rows.append((k, rng.choice(["1-2-3", "1-2-3", "freeze", "result"]), t))
    rows += [(99, "freeze", 5), (3, "result", 1000), (99, "1-2-3", 1000)]  # not watched; long after its end; the clock
    return deadlines, sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("files", [1, 6])
def test_transitions_do_not_depend_on_batches(spark, tmp_path, races, files):
    deadlines, rows = races
    folder, step = str(tmp_path / "in"), -(-len(rows) // files)
    for i in range(0, len(rows), step):
        write(spark, folder, [(k, c, 1.0, at(t), i + j) for j, (k, c, t) in enumerate(rows[i : i + step])])
    watch = spark.createDataFrame([(k, None if d is None else at(d)) for k, d in deadlines.items()], NO_DEADLINE)
    moves = lifecycle.transitions(source(spark, folder), watch, "freeze", "result")
    q = moves.writeStream.format("memory").queryName(f"moves{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.race_key, r.state, round((r.at.astimezone(dt.timezone.utc) - at(0)).total_seconds() / 60)) for r in spark.table(f"moves{files}").collect())
    assert got == plain_moves(rows, deadlines, 120, 180, 10)
    mark = max(r[2] for r in rows) - 10
    # of watched races, only those are kept that may still change
    held = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    born = {r[0]: min(t for k, _, t in rows if k == r[0]) for r in rows}
    may_change = [k for k, d in deadlines.items() if k in born and (born[k] + 180 + 1440 if d is None else d + 120) > mark]
    assert held <= len(may_change) < len(deadlines)


def test_rules_of_a_race():
    moves, timer, forgotten = lifecycle.machine(120, 180, keep=60)
    m = lifecycle.MINUTE
    race, out = moves((None, 10 * m, None, None, 0), 189 * m)
    assert out == [("ACTIVE", 10 * m)] and timer(race) == 190 * m
    race, out = moves(race, 190 * m)
    assert out == [("TIMEOUT", 190 * m)] and timer(race) == forgotten(race) == 250 * m
    race, out = moves((100 * m, 10 * m, 20 * m, None, 0), 150 * m)
    assert [s for s, _ in out] == ["ACTIVE", "WAIT_RESULT"] and timer(race) == 220 * m
    assert moves(race, 219 * m)[1] == [] and moves(race, 220 * m)[1] == [("TIMEOUT", 220 * m)]
    assert moves((*race[:3], 160 * m, 2), 170 * m)[1] == [("DONE", 160 * m)]
    assert moves((*race[:3], 230 * m, 2), 240 * m)[1] == [("TIMEOUT", 220 * m)]  # the result came after the wait
    assert moves((100 * m, 10 * m, 101 * m, None, 1), 100 * m)[1] == [("DONE", 100 * m)]  # frozen too late
    assert moves((100 * m, None, None, None, 0), 900 * m) == ((100 * m, None, None, None, 0), [])


def price():
    return F.when(F.col("odds") >= 1, None).otherwise("odds below 1")


def keys(table):
    return sorted((r.race_key, r.arrival) for r in table.read().collect())


def test_a_bad_race_is_held_and_replayed(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, "a", 5.0, at(0), 1), (2, "a", 0.5, at(0), 2), (2, "b", 4.0, at(0), 3), (None, "a", 2.0, at(0), 4), (3, "a", None, at(0), 5)])
    intake = Intake(spark, str(tmp_path / "tables"), price())
    intake.run(source(spark, folder))
    assert keys(intake.stored) == [(1, 1)]
    assert sorted((r.arrival, r.reason, r.batch) for r in intake.held.read().collect()) == [(2, "odds below 1", 0), (3, "odds below 1", 0), (4, quarantine.NO_RACE, 0), (5, "odds below 1", 0)]
    write(spark, folder, [(2, "a", 6.0, at(9), 6), (1, "a", 0.1, at(9), 7)])
    intake = Intake(spark, str(tmp_path / "tables"), price())  # the job starts again
    intake.run(source(spark, folder))
    assert keys(intake.stored) == [(1, 1), (2, 6)]
    again = spark.createDataFrame([(2, "a", 6.0, at(9), 6), (1, "a", 0.1, at(9), 7)], SAMPLES)
    intake.take(again, 1)  # a batch that is run again adds nothing
    assert keys(intake.stored) == [(1, 1), (2, 6)] and intake.held.read().count() == 5
    intake.replay(lambda rows: rows.withColumn("odds", F.when(F.col("arrival") == 2, 1.5).otherwise(F.col("odds"))))
    assert keys(intake.stored) == [(1, 1), (2, 2), (2, 3), (2, 6)]
    assert sorted(r.arrival for r in intake.held.read().collect()) == [4, 5, 7]
    assert {r.arrival for r in intake.stored.read().filter("replayed").collect()} == {2, 3}
    intake.replay(lambda rows: rows)
    assert intake.held.read().count() == 3 and intake.stored.read().count() == 4


def test_a_replay_that_ends_between_its_commits(spark, tmp_path, monkeypatch):
    intake = Intake(spark, str(tmp_path / "tables"), price())
    intake.take(spark.createDataFrame([(1, "a", 0.5, at(0), 1), (2, "a", 0.5, at(0), 2)], SAMPLES), 0)
    repair = lambda rows: rows.withColumn("odds", F.greatest("odds", F.lit(1.0)))
    with monkeypatch.context() as m:
        def lost(*a, **k):
            raise RuntimeError("lost")
        m.setattr(quarantine.Table, "delete", lost)
        with pytest.raises(RuntimeError):
            intake.replay(repair)
    intake.replay(repair)
    assert keys(intake.stored) == [(1, 1), (2, 2)] and intake.held.read().count() == 0


def test_a_batch_that_reached_one_table_only(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([(1, "a", 2.0, at(0), 1), (2, "a", 0.5, at(0), 2)], SAMPLES)
    intake = Intake(spark, str(tmp_path / "tables"), price())
    intake.take(batch.limit(0), 0)
    with monkeypatch.context() as m:
        def lost(*a, **k):
            raise RuntimeError("lost")
        m.setattr(intake.held, "append", lost)
        with pytest.raises(RuntimeError):
            intake.take(batch, 1)
    intake.take(batch, 1)
    assert keys(intake.stored) == [(1, 1)] and keys(intake.held) == [(2, 2)]


def test_first_samples_across_restarts(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    for i in range(5):
        write(spark, folder, [(k, "a", 10.0 * i + k, at(i), 10 * i + k) for k in range(i, i + 3)] + [(None, "a", 1.0, at(i), 100 + i)])
        got = stream.run_first_wins(source(spark, folder), ["race_key", "combo"], root, buckets=3)
        assert {r.race_key: r.arrival for r in got.collect()} == {k: 10 * max(0, k - 2) + k for k in range(i + 3)} | {None: 100}
    again = stream.run_first_wins(source(spark, folder), ["race_key", "combo"], root)
    assert again.count() == 8


def test_copies_within_a_delay(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(k % 4, "a", 1.0, at(k % 3), k) for k in range(40)])
    out = stream.drain(stream.first_within(source(spark, folder), ["race_key"], "10 minutes"), "t-within")
    assert sorted(r.race_key for r in out.collect()) == [0, 1, 2, 3]
