"""Queries that run a stream over the whole sample table."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook.functions.scalars import instant, utc
from racebook.operators import odds
from racebook.plans.registry import query
from racebook.session import fresh_path
from racebook.streaming import lifecycle
from racebook.streaming import odds as stream
from racebook.streaming.quarantine import Intake


def samples(t):
    return stream.sample_stream(t.spark, f"{t.sf_dir.rstrip('/')}/events.parquet")


def at(name: str):
    return utc(F.col(name)).alias(name)


@query(
    "stream_odds_ingest",
    """SELECT s.race_key, s.combo, s.odds, s.fetched_at FROM {odds_samples} s JOIN {watchlist} w ON w.race_key = s.race_key
WHERE s.odds >= 1 AND w.active AND s.fetched_at < w.deadline""",
)
def stream_odds_ingest(t):
    watch = t.watchlist.withColumn("deadline", instant(F.col("deadline")))
    rows = stream.before_deadline(samples(t), watch).withColumn("race_date", utc(F.col("fetched_at")).cast("date"))
    stored = stream.drain(rows, "odds-raw", partition_by=["race_date"])
    return stored.select("race_key", "combo", "odds", at("fetched_at"))


@query(
    "stream_odds_bars",
    """SELECT race_key, combo, window_start, open, high, low, close, n FROM (
  SELECT race_key, combo, time_bucket(INTERVAL 5 MINUTE, fetched_at) AS window_start, arg_min(odds, (fetched_at, arrival)) AS open,
    max(odds) AS high, min(odds) AS low, arg_max(odds, (fetched_at, arrival)) AS close, count(*) AS n
  FROM {odds_samples} WHERE odds >= 1 GROUP BY ALL)
WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(fetched_at) - INTERVAL 10 MINUTE FROM {odds_samples} WHERE odds >= 1)""",
)
def stream_odds_bars(t):
    out = stream.drain(stream.bars(samples(t)), "odds-bars")
    return out.select("race_key", "combo", at("window_start"), "open", "high", "low", "close", "n")


@query(
    "stream_race_lifecycle",
    """WITH f AS (SELECT race_key, min(fetched_at) AS created_at, min(fetched_at) FILTER (WHERE combo = 'purchase') AS snapshot_at,
    max(fetched_at) FILTER (WHERE combo = 'error') AS result_at FROM {odds_samples} GROUP BY race_key)
SELECT race_key, created_at, CASE
  WHEN TIMESTAMP '2024-01-28 23:00:00' >= deadline THEN CASE WHEN coalesce(result_at >= deadline, false) OR snapshot_at IS NULL THEN 'DONE'
    WHEN TIMESTAMP '2024-01-28 23:00:00' >= deadline + INTERVAL 120 MINUTE THEN 'TIMEOUT' ELSE 'WAIT_RESULT' END
  ELSE 'ACTIVE' END AS state
FROM f JOIN (SELECT race_key AS r, deadline FROM {watchlist}) w ON r = race_key""",
)
def stream_race_lifecycle(t):
    facts = stream.run_lifecycle(samples(t), "purchase", "error")
    facts = facts.select("race_key", at("created_at"), at("snapshot_at"), at("result_at"))
    d = facts.join(t.watchlist.select("race_key", "deadline"), "race_key").withColumns(
        {
            "has_snapshot": F.col("snapshot_at").isNotNull(),
            "has_result": F.coalesce(F.col("result_at") >= F.col("deadline"), F.lit(False)),
        }
    )
    return odds.race_state(d, "2024-01-28 23:00:00").select("race_key", "created_at", "state")


@query(
    "stream_dedup",
    """SELECT race_key, combo, arg_min(odds, (fetched_at, arrival)) AS odds, min(fetched_at) AS fetched_at, arg_min(arrival, (fetched_at, arrival)) AS arrival
FROM {odds_samples} GROUP BY race_key, combo""",
)
def stream_dedup(t):
    out = stream.run_first_wins(samples(t), ["race_key", "combo"])
    return out.select("race_key", "combo", "odds", at("fetched_at"), "arrival")


@query(
    "stream_result_join",
    """SELECT s.race_key, s.fetched_at AS saved_at, r.fetched_at AS result_ts FROM {odds_samples} s JOIN {odds_samples} r
ON r.race_key = s.race_key AND r.fetched_at BETWEEN s.fetched_at AND s.fetched_at + INTERVAL 120 MINUTE
WHERE s.combo = 'purchase' AND r.combo = 'error'""",
)
def stream_result_join(t):
    frozen = samples(t).filter("combo = 'purchase'").select("race_key", F.col("fetched_at").alias("saved_at"))
    results = samples(t).filter("combo = 'error'").select("race_key", F.col("fetched_at").alias("result_ts"))
    joined = stream.results_in_time(frozen.withWatermark("saved_at", "10 minutes"), results.withWatermark("result_ts", "10 minutes"))
    out = stream.drain(joined, "results-in-time")
    return out.select("race_key", at("saved_at"), at("result_ts"))


@query(
    "stream_lifecycle_timers",
    """WITH w AS (SELECT race_key, deadline, deadline + INTERVAL 120 MINUTE AS wait_end FROM {watchlist}),
f AS (SELECT w.race_key, deadline, wait_end, min(fetched_at) AS created_at, min(fetched_at) FILTER (WHERE combo = 'purchase') AS snapshot_at,
    min(fetched_at) FILTER (WHERE combo = 'error' AND fetched_at >= deadline) AS result_at
  FROM {odds_samples} s JOIN w ON w.race_key = s.race_key WHERE fetched_at <= wait_end GROUP BY ALL),
m AS (SELECT race_key, 'ACTIVE' AS state, created_at AS moved_at FROM f
  UNION ALL SELECT race_key, CASE WHEN coalesce(snapshot_at <= deadline, false) THEN 'WAIT_RESULT' ELSE 'DONE' END, greatest(deadline, created_at) FROM f
  UNION ALL SELECT race_key, CASE WHEN result_at <= wait_end THEN 'DONE' ELSE 'TIMEOUT' END, least(wait_end, coalesce(result_at, wait_end))
    FROM f WHERE snapshot_at <= deadline)
SELECT race_key, state, moved_at FROM m WHERE moved_at <= (SELECT max(s.fetched_at) - INTERVAL 10 MINUTE FROM {odds_samples} s JOIN w ON w.race_key = s.race_key)""",
)
def stream_lifecycle_timers(t):
    watch = t.watchlist.select("race_key", instant(F.col("deadline")).alias("deadline"))
    out = stream.drain(lifecycle.transitions(samples(t), watch, "purchase", "error"), "lifecycle-moves")
    return out.select("race_key", "state", at("at").alias("moved_at"))


@query(
    "stream_quarantine",
    """SELECT race_key, combo, greatest(odds, 1) AS odds, fetched_at, bool_or(odds < 1) OVER (PARTITION BY race_key) AS replayed,
  (SELECT count(*) FROM {odds_samples} WHERE race_key IN (SELECT race_key FROM {odds_samples} WHERE odds < 1)) AS n_held
FROM {odds_samples}""",
)
def stream_quarantine(t):
    """Races with an impossible price are held while the others are stored, then replayed with the price raised to 1."""
    price = F.when(F.col("odds") >= 1, None).otherwise("odds below 1")
    intake = Intake(t.spark, fresh_path(t.spark, "intake"), price)
    intake.run(samples(t))
    held = sum(intake.held.row_counts().values())
    intake.replay(lambda rows: rows.withColumn("odds", F.greatest("odds", F.lit(1.0))))
    out = intake.stored.read().select("race_key", "combo", "odds", at("fetched_at"), "replayed")
    return out.withColumn("n_held", F.lit(held).cast("long"))
