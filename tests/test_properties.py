"""What must hold for any data: totals, idempotence, skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from racebook.operators import features, joins, model, odds, tickets, trifecta
from racebook.plans.race import card
from racebook.plans.tickets import priced
from racebook.sources import stores
from racebook.sources.adapters import Source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Source(spark, SF)


def test_probabilities_sum_to_one(t):
    off = lambda d, *k: d.groupBy(*k).agg(F.sum("p_first").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9).count()
    assert off(features.win_probability(card(t)), "race_key") == 0
    assert off(features.variants(card(t)), "race_key", "variant") == 0
    tri = trifecta.trifecta(t.win_probs).groupBy("race_key").agg(F.sum("prob").alias("s"))
    assert tri.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_ticket_groups_do_not_overlap(t):
    d = tickets.rank_tickets(priced(t))
    assert d.count() == d.select("race_key", "combo").distinct().count()
    sizes = d.groupBy("race_key").agg(*[F.count_if(F.col("group") == g).alias(n) for g, n in [("本線", "m"), ("抑え", "c"), ("穴", "l")]])
    assert sizes.filter("m <> 3 OR c > 3 OR l > 2").count() == 0


def skewed_samples(spark, n=30000, seed=3):
    """A third of all samples belongs to one race."""
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (0 if i % 3 == 0 else 1 + i % 400, rnd.choice(["1-2-3", "2-1-3", "3-1-2"]), rnd.uniform(0.5, 300), start + dt.timedelta(seconds=rnd.randint(0, 400000)), i)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "race_key INT, combo STRING, odds DOUBLE, fetched_at TIMESTAMP_NTZ, arrival INT")


def test_hot_race(spark):
    rows, d = skewed_samples(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        locks = d.groupBy("race_key").agg((F.min("fetched_at") + F.make_dt_interval(days=F.lit(1))).alias("saved_at"))
        got = {(r.race_key, r.combo): r for r in odds.asof_lock(d, locks).collect()}
        gone = locks.filter("race_key < 100")
        assert odds.prune(d, gone, "2030-01-01").count() == sum(r[0] >= 100 for r in rows)
        assert odds.prune(d, gone, "2000-01-01").count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    mine = sorted((r[3], r[4], r[2]) for r in rows if r[0] == 0 and r[1] == "1-2-3" and r[2] >= 1)
    lock = min(r[3] for r in rows if r[0] == 0) + dt.timedelta(days=1)
    known = [x for x in mine if x[0] <= lock]
    assert got[(0, "1-2-3")].odds_at_lock == mine[0][2]
    assert got[(0, "1-2-3")].odds_asof_lock == known[-1][2]
    assert got[(0, "1-2-3")].n_before_lock == len(known)


def test_sessions_equal_a_plain_scan(spark):
    rows, d = skewed_samples(spark)
    want = []
    for race in {r[0] for r in rows}:
        times = sorted(r[3] for r in rows if r[0] == race)
        first = last = times[0]
        n = 1
        for x in times[1:]:
            if x - last > dt.timedelta(minutes=30):
                want.append((race, first, last, n))
                first, n = x, 0
            last = x
            n += 1
        want.append((race, first, last, n))
    got = sorted((r.race_key, r.started_at, r.ended_at, r.n) for r in odds.sessions(d).collect())
    assert got == sorted(want)


def test_first_and_last_stay_between_extremes(t):
    d = odds.summarise_series(odds.valid_odds(t.odds_samples))
    assert d.filter("odds_min > least(odds_at_lock, odds_final) OR odds_max < greatest(odds_at_lock, odds_final)").count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_sample_times_are_unique_per_race(spark, sf):
    d = Source(spark, f"/root/testdata/sf{sf}").odds_samples
    assert d.groupBy("race_key", "fetched_at").count().filter("count > 1").count() == 0


def test_repeated_times_keep_arrival_order(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "1-2-3", 5.0, at, 3), (1, "1-2-3", 7.0, at, 1), (1, "1-2-3", 6.0, at, 2)]
    d = spark.createDataFrame(rows, "race_key INT, combo STRING, odds DOUBLE, fetched_at TIMESTAMP_NTZ, arrival INT")
    r = odds.summarise_series(d).first()
    assert (r.odds_at_lock, r.odds_final) == (7.0, 5.0)


def test_upsert_twice_is_upsert_once(t):
    table = t.results_rows.select("race_key", "payout", F.lit(1).alias("seq"))
    changes = table.filter("payout > 0").withColumns({"payout": F.col("payout") * 2, "seq": F.lit(2)})
    once = stores.upsert(table, changes, ["race_key"], "seq")
    twice = stores.upsert(once, changes, ["race_key"], "seq")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.count() == table.count()
    same = stores.insert_if_absent(once, table, ["race_key"])
    assert same.count() == once.count()
    fresh = once.limit(1).withColumn("race_key", F.lit(-1).cast("long"))
    both = stores.insert_if_absent(once, fresh.withColumn("seq", F.lit(9)).unionByName(fresh.withColumn("seq", F.lit(8))), ["race_key"], ["seq"])
    assert [r.seq for r in both.filter("race_key = -1").collect()] == [8]


def test_prune_keeps_every_unfinished_race(t):
    summary, left = stores.rollup_then_prune(t.odds_samples, t.odds_tickets, t.odds_results, "2030-01-01")
    unfinished = odds.tracked_races(t.odds_samples).join(t.odds_results, "race_key", "left_anti")
    assert left.select("race_key").distinct().count() == unfinished.count()
    assert left.count() == t.odds_samples.join(unfinished, "race_key").count()
    assert summary.join(left.select("race_key").distinct(), "race_key").count() == 0
    assert stores.freed(t.odds_samples, left) == t.odds_samples.join(t.odds_results, "race_key", "left_semi").count()


def test_prune_keeps_the_retention_period(t):
    _, left = stores.rollup_then_prune(t.odds_samples, t.odds_tickets, t.odds_results, "2024-01-25")
    recent = "fetched_at >= TIMESTAMP_NTZ '2024-01-18'"
    assert left.filter(recent).count() == t.odds_samples.filter(recent).count() > 0


def test_preparation_of_constant_and_fine_columns(spark):
    d = spark.createDataFrame([(i / 1000, 0.1, "01") for i in range(6)], "a DOUBLE, b DOUBLE, venue STRING")
    d = d.select(*[F.col("b" if c == "avg_st" else "a").alias(c) for c in model.NUMERIC], "venue", F.lit(1).alias("finish"))
    prep = model.Preparation.fit(d)
    assert prep.medians["motor_2ren"] == pytest.approx(0.0025) and prep.means["motor_2ren"] == pytest.approx(0.0025)
    assert prep.deviations["avg_st"] == 0
    assert [r.z_avg_st for r in prep.transform(d).collect()] == pytest.approx([0.0] * 6, abs=1e-12)


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "raw")
    d = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "race_date STRING, v INT")
    stores.append(d, path, ["race_date"])
    stores.replace_partitions(spark.createDataFrame([("2024-01-02", 9)], "race_date STRING, v INT"), path, ["race_date"])
    assert sorted((str(r.race_date), r.v) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 9)]


def test_deactivate(spark):
    watch = spark.createDataFrame([(1, True), (2, True), (3, False)], "race_key INT, active BOOLEAN")
    done = spark.createDataFrame([(2,), (2,)], "race_key INT")
    got = {r.race_key: r.active for r in stores.deactivate(watch, done, ["race_key"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_retention_limit_takes_the_oldest(t):
    few = odds.retention_candidates(t.odds_samples, "2024-01-25", limit=5).collect()
    every = sorted((r.race_date, r.race_key) for r in odds.retention_candidates(t.odds_samples, "2024-01-25").collect())
    assert sorted((r.race_date, r.race_key) for r in few) == every[:5]


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        a = joins.salted_join(rows, keyed, "k", how, "id").select("k", "id")
        b = rows.join(keyed, "k", how).select("k", "id")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_model_learns_and_scores(t):
    fitted = model.train(t.race_entries, iterations=3)
    d = fitted.score(t.race_entries)
    assert d.count() == t.race_entries.count()
    assert d.filter("raw_prob < 0 OR raw_prob > 1 OR raw_prob IS NULL").count() == 0
    unknown = t.race_entries.withColumn("venue", F.lit("99"))
    assert fitted.score(unknown).filter("raw_prob IS NULL").count() == 0


def test_preparation_median_is_exact(spark):
    rows = [(float(i % 7), i % 5 / 100 if i % 4 else None, f"{i % 3:02d}") for i in range(50)]
    names = [c for c in model.NUMERIC]
    d = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, venue STRING")
    d = d.select(*[F.col("b" if c == "avg_st" else "a").alias(c) for c in names], "venue", F.lit(1).alias("finish"))
    prep = model.Preparation.fit(d)
    some = sorted(r[1] for r in rows if r[1] is not None)
    n = len(some)
    assert prep.medians["avg_st"] == pytest.approx((some[(n - 1) // 2] + some[n // 2]) / 2)
    filled = [r[1] if r[1] is not None else prep.medians["avg_st"] for r in rows]
    mean = sum(filled) / 50
    assert prep.means["avg_st"] == pytest.approx(mean)
    assert prep.deviations["avg_st"] == pytest.approx((sum((x - mean) ** 2 for x in filled) / 50) ** 0.5)
    assert prep.usual_venue == "00"
