"""Queries over the odds time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook.operators import joins, odds
from racebook.plans.registry import R6, query, r6, rounded

SERIES_SQL = """
series AS (SELECT race_key, combo, arg_min(odds, (fetched_at, arrival)) AS odds_at_lock,
    arg_max(odds, (fetched_at, arrival)) AS odds_final, min(odds) AS odds_min, max(odds) AS odds_max,
    count(*) AS n_samples, min(fetched_at) AS first_at, max(fetched_at) AS last_at
  FROM {odds_samples} WHERE odds >= 1 GROUP BY race_key, combo)"""

TARGETS_SQL = """
targets AS (SELECT race_key, combo, stake > 0 AS was_purchased, stake, ticket_group, ai_prob FROM {odds_tickets}
  UNION ALL
  SELECT race_key, actual_combo, false, 0, '', NULL FROM {odds_results} r
  WHERE NOT EXISTS (SELECT 1 FROM {odds_tickets} t WHERE t.race_key = r.race_key AND t.combo = r.actual_combo))"""


@query(
    "odds_rollup",
    f"""WITH {SERIES_SQL}, {TARGETS_SQL}
SELECT s.race_key, s.combo, t.was_purchased, t.stake, t.ticket_group, s.combo = r.actual_combo AS is_hit,
  t.ai_prob, s.odds_at_lock, s.odds_final, s.odds_min, s.odds_max,
  {R6('s.odds_final / s.odds_at_lock')} AS odds_drift, {R6('t.ai_prob * s.odds_at_lock')} AS ev_at_lock,
  {R6('t.ai_prob * s.odds_final')} AS ev_final, s.n_samples, s.first_at, s.last_at
FROM series s JOIN targets t ON s.race_key = t.race_key AND s.combo = t.combo
JOIN {{odds_results}} r ON r.race_key = s.race_key""".replace("{{", "{").replace("}}", "}"),
)
def odds_rollup(t):
    out = odds.rollup(t.odds_samples, t.odds_tickets, t.odds_results)
    return rounded(out, "odds_drift", "ev_at_lock", "ev_final")


@query("target_combo_union", f"WITH {TARGETS_SQL} SELECT * FROM targets")
def target_combo_union(t):
    return odds.target_combos(t.odds_tickets, t.odds_results)


@query("valid_odds_filter", "SELECT race_key, combo, odds, fetched_at FROM {odds_samples} WHERE odds >= 1 AND trim(combo) <> ''")
def valid_odds_filter(t):
    return odds.valid_odds(t.odds_samples).select("race_key", "combo", "odds", "fetched_at")


@query(
    "odds_asof_lock",
    """SELECT s.race_key, s.combo, arg_min(s.odds, (s.fetched_at, s.arrival)) AS odds_at_lock,
  arg_max(s.odds, (s.fetched_at, s.arrival)) FILTER (WHERE s.fetched_at <= l.saved_at) AS odds_asof_lock,
  count(*) FILTER (WHERE s.fetched_at <= l.saved_at) AS n_before_lock
FROM {odds_samples} s JOIN {odds_locks} l ON s.race_key = l.race_key WHERE s.odds >= 1
GROUP BY s.race_key, s.combo""",
)
def odds_asof_lock(t):
    return odds.asof_lock(t.odds_samples, t.odds_locks)


@query("odds_history", "SELECT race_key, combo, odds, fetched_at FROM {odds_samples}")
def odds_history(t):
    return t.odds_samples.select("race_key", "combo", "odds", "fetched_at").orderBy("race_key", "fetched_at")


@query("odds_timepoints", "SELECT race_key, count(DISTINCT fetched_at) AS timepoints FROM {odds_samples} GROUP BY race_key")
def odds_timepoints(t):
    return odds.timepoints(t.odds_samples)


@query(
    "odds_5min_bars",
    """SELECT race_key, combo, time_bucket(INTERVAL 5 MINUTE, fetched_at) AS window_start,
  arg_min(odds, (fetched_at, arrival)) AS open, max(odds) AS high, min(odds) AS low,
  arg_max(odds, (fetched_at, arrival)) AS close, count(*) AS n
FROM {odds_samples} WHERE odds >= 1 GROUP BY ALL""",
)
def odds_5min_bars(t):
    return odds.bars(odds.valid_odds(t.odds_samples))


@query(
    "odds_sliding_change",
    """SELECT race_key, combo, window_start, arg_min(odds, (fetched_at, arrival)) AS first_odds,
  arg_max(odds, (fetched_at, arrival)) AS last_odds, count(*) AS n, """
    + R6("arg_max(odds, (fetched_at, arrival)) - arg_min(odds, (fetched_at, arrival))")
    + """ AS change
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, fetched_at) - INTERVAL (k * 5) MINUTE AS window_start
      FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM {odds_samples} WHERE odds >= 1)) GROUP BY ALL""",
)
def odds_sliding_change(t):
    return rounded(odds.sliding_change(odds.valid_odds(t.odds_samples)), "change")


@query(
    "odds_sessions",
    """SELECT race_key, min(fetched_at) AS started_at, max(fetched_at) AS ended_at, count(*) AS n FROM (
  SELECT *, sum(o) OVER (PARTITION BY race_key ORDER BY fetched_at, arrival) AS island FROM (
    SELECT *, CASE WHEN fetched_at - lag(fetched_at) OVER (PARTITION BY race_key ORDER BY fetched_at, arrival)
        <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM {odds_samples}))
GROUP BY race_key, island""",
)
def odds_sessions(t):
    return odds.sessions(t.odds_samples)


@query(
    "gap_islands",
    """SELECT race_key, lo, hi, n FROM (SELECT race_key, island, min(x) AS lo, max(x) AS hi, count(*) AS n FROM (
  SELECT race_key, x, sum(o) OVER (PARTITION BY race_key ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT race_key, x, CASE WHEN x - lag(x) OVER (PARTITION BY race_key ORDER BY x) <= 25 THEN 0 ELSE 1 END AS o
    FROM (SELECT race_key, odds AS x FROM {odds_samples})))
GROUP BY race_key, island)""",
)
def gap_islands(t):
    return odds.gap_groups(t.odds_samples, "race_key", F.col("odds"), 25).select("race_key", "lo", "hi", "n")


@query(
    "top_movers",
    f"""WITH cell AS (SELECT race_key, combo, fetched_at, avg(odds) AS odds FROM {{odds_samples}} GROUP BY ALL),
ends AS (SELECT race_key, min(fetched_at) AS t0, max(fetched_at) AS t1 FROM cell GROUP BY race_key),
combos AS (SELECT DISTINCT race_key, combo FROM cell),
chg AS (SELECT c.race_key, c.combo, z.odds - a.odds AS change FROM combos c JOIN ends e ON e.race_key = c.race_key
  LEFT JOIN cell a ON a.race_key = c.race_key AND a.combo = c.combo AND a.fetched_at = e.t0
  LEFT JOIN cell z ON z.race_key = c.race_key AND z.combo = c.combo AND z.fetched_at = e.t1)
SELECT race_key, combo, {R6('change')} AS change, place FROM (
  SELECT *, row_number() OVER (PARTITION BY race_key ORDER BY change ASC NULLS LAST, combo) AS place FROM chg)
WHERE place <= 5""",
)
def top_movers(t):
    return rounded(odds.movements(t.odds_samples), "change")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "odds_pivot",
    "SELECT race_key, fetched_at, "
    + ", ".join(f"{R6(f'avg(odds) FILTER (WHERE combo = {chr(39)}{c}{chr(39)})')} AS {c}" for c in EVENT_TYPES)
    + " FROM {odds_samples} GROUP BY race_key, fetched_at",
)
def odds_pivot(t):
    return rounded(odds.wide_series(t.odds_samples, EVENT_TYPES), *EVENT_TYPES)


@query(
    "retention_candidates",
    """SELECT DISTINCT race_key, CAST(fetched_at AS DATE) AS race_date FROM {odds_samples}
WHERE CAST(fetched_at AS DATE) < DATE '2024-01-25' - 7""",
)
def retention_candidates(t):
    return odds.retention_candidates(t.odds_samples, "2024-01-25")


@query(
    "rollup_finished_semi",
    """SELECT DISTINCT s.race_key, r.actual_combo FROM {odds_samples} s JOIN {odds_results} r ON r.race_key = s.race_key""",
)
def rollup_finished_semi(t):
    return odds.tracked_races(t.odds_samples).join(t.odds_results, "race_key")


@query(
    "rollup_unfinished_anti",
    "SELECT DISTINCT race_key FROM {odds_samples} WHERE race_key NOT IN (SELECT race_key FROM {odds_results})",
)
def rollup_unfinished_anti(t):
    return odds.tracked_races(t.odds_samples).join(t.odds_results, "race_key", "left_anti")


@query(
    "races_intersect",
    "SELECT race_key FROM {odds_samples} INTERSECT SELECT race_key FROM {odds_results}",
)
def races_intersect(t):
    # distinct first: the set operation alone would shuffle every sample of a race
    return odds.tracked_races(t.odds_samples).intersect(t.odds_results.select("race_key"))


@query(
    "late_samples",
    """SELECT s.race_key, count(*) FILTER (WHERE fetched_at < deadline) AS stored,
  count(*) FILTER (WHERE fetched_at >= deadline) AS refused
FROM {odds_samples} s JOIN {watchlist} w ON s.race_key = w.race_key WHERE s.odds >= 1 GROUP BY s.race_key""",
)
def late_samples(t):
    return odds.late_samples(t.odds_samples, t.watchlist)


WATCH_SQL = """SELECT race_key, created_at, CASE WHEN race_key % 7 = 0 THEN NULL ELSE deadline END AS deadline,
  race_key % 3 = 0 AS has_result, race_key % 4 <> 0 AS has_snapshot FROM {watchlist}"""


@query(
    "deadline_state",
    f"""SELECT race_key, deadline, CASE
  WHEN deadline IS NOT NULL AND now >= deadline THEN CASE
    WHEN has_result OR NOT has_snapshot THEN 'DONE'
    WHEN now >= deadline + INTERVAL 120 MINUTE THEN 'TIMEOUT' ELSE 'WAIT_RESULT' END
  WHEN deadline IS NULL AND now - created_at > INTERVAL 180 MINUTE THEN 'TIMEOUT' ELSE 'ACTIVE' END AS state
FROM (SELECT *, TIMESTAMP '2024-01-28 23:00:00' AS now FROM ({WATCH_SQL}))""",
)
def deadline_state(t):
    watch = t.watchlist.select(
        "race_key",
        "created_at",
        F.when(F.col("race_key") % 7 != 0, F.col("deadline")).alias("deadline"),
        (F.col("race_key") % 3 == 0).alias("has_result"),
        (F.col("race_key") % 4 != 0).alias("has_snapshot"),
    )
    return odds.race_state(watch, "2024-01-28 23:00:00").select("race_key", "deadline", "state")


@query(
    "watchlist_active",
    "SELECT race_key, created_at, deadline FROM {watchlist} WHERE active",
)
def watchlist_active(t):
    return t.watchlist.filter("active").select("race_key", "created_at", "deadline").orderBy("created_at")


@query(
    "snapshot_result_interval_join",
    """SELECT race_key, saved_at, result_ts FROM {odds_locks}
WHERE result_ts BETWEEN saved_at AND saved_at + INTERVAL 120 MINUTE""",
)
def snapshot_result_interval_join(t):
    return odds.within_wait(t.odds_locks.select("race_key", "saved_at"), t.odds_locks.select("race_key", "result_ts"))
