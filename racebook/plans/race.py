"""Queries over the race card: ranks, features, probabilities, risk and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions import ranks
from racebook.operators import features
from racebook.plans.registry import R6, query, r6, rounded

P = "PARTITION BY race_key"


def Z(col: str) -> str:
    """Centred average rank, lower is better, from its textbook definition."""
    n = f"count({col}) OVER ({P})"
    avg = f"(rank() OVER ({P} ORDER BY {col} NULLS LAST) + (count(*) OVER (PARTITION BY race_key, {col}) - 1) / 2e0)"
    return f"CASE WHEN {col} IS NULL OR {n} < 2 THEN 0e0 ELSE (({n} + 1) / 2e0 - {avg}) / (({n} - 1) / 2e0) END"


Z_COLUMNS = ", ".join(f"{Z(c)} AS z_{c}, count({c}) OVER ({P}) AS n_{c}" for c in features.RANKED)

FEATURE_SQL = f"""
card AS (SELECT *, racer_win_rate / 2e1 AS raw_prob,
  CASE racer_class WHEN 'A1' THEN 3 WHEN 'A2' THEN 2 WHEN 'B1' THEN 1 WHEN 'B2' THEN 0 END AS class_score,
  max(CASE WHEN lane = 1 THEN venue_course_1st END) OVER ({P}) AS lane1 FROM {{race_entries}}),
zs AS (SELECT *, {Z_COLUMNS} FROM card),
feat AS (SELECT *, least(current_meet_races / 6e0, 1) AS rel,
  (z_current_meet_avg_finish * 0.45e0 - z_current_meet_top2_rate * 0.35e0 + z_current_meet_avg_st * 0.2e0)
    * least(current_meet_races / 6e0, 1) AS f_meet,
  greatest(-1, least(1, -z_course_top3_rate * 0.55e0 + z_course_avg_st * 0.3e0 + z_course_start_rank * 0.15e0)) AS f_course,
  -z_class_score AS f_class, -z_venue_course_1st AS f_venue,
  CASE WHEN lane1 < 45 AND venue_kimarite_makuri >= 30 AND lane IN (3, 4) THEN 0.06e0 ELSE 0e0 END AS f_bonus,
  z_exhibition_time AS f_time,
  CASE WHEN n_original_straight >= 4 THEN z_original_straight ELSE 0 END AS f_straight,
  CASE WHEN n_original_turn >= 4 THEN z_original_turn ELSE 0 END AS f_turn,
  CASE WHEN n_original_lap >= 4 THEN z_original_lap ELSE 0 END AS f_lap,
  coalesce(wind_speed, 0) >= 5 OR coalesce(wave_height, 0) >= 3 AS rough,
  CASE WHEN coalesce(wind_speed, 0) >= 5 OR coalesce(wave_height, 0) >= 3 THEN -1e0 * greatest(lane - 3, 0) ELSE 0e0 END AS f_weather
  FROM zs)"""


def adj_sql(w: features.Weights) -> str:
    return (
        f"(f_meet * {w.meet!r} + f_course * {w.course!r} + f_class * {w.klass!r} + f_venue * {w.venue!r} + f_bonus"
        f" + f_time * {w.display!r} + (f_straight * 0.11e0 + f_turn * 0.11e0 + f_lap * 0.08e0) * {w.original!r}"
        f" + f_weather * {w.weather!r})"
    )


def p_sql(w: features.Weights, part: str = P) -> str:
    s = f"greatest(raw_prob, 1e-6) * exp({adj_sql(w)})"
    return f"{s} / sum({s}) OVER ({part})"


REASON_SQL = "CASE WHEN t = '' THEN '{d}' ELSE t END".format(d=K.DEFAULT_REASON)
_R = K.REASON
REASON_PARTS = f"""concat_ws(' / ',
  CASE WHEN rel >= 0.34 AND f_meet >= 0.45 THEN '{_R['meet_good']}' WHEN rel >= 0.34 AND f_meet <= -0.45 THEN '{_R['meet_bad']}' END,
  CASE WHEN rel >= 0.5 AND z_current_meet_avg_st >= 0.6 THEN '{_R['meet_st']}' END,
  CASE WHEN f_course >= 0.45 THEN '{_R['course_good']}' WHEN f_course <= -0.45 THEN '{_R['course_bad']}' END,
  CASE WHEN z_course_avg_st >= 0.6 THEN '{_R['course_st']}' END,
  CASE racer_class WHEN 'A1' THEN '{_R['class_a1']}' WHEN 'B2' THEN '{_R['class_b2']}' END,
  CASE WHEN f_venue >= 0.55 THEN '{_R['venue_good']}' WHEN f_venue <= -0.55 THEN '{_R['venue_bad']}' END,
  CASE WHEN f_bonus > 0 THEN '{_R['rough_bonus']}' END,
  CASE WHEN exhibition_st < 0 THEN '{_R['flying']}' END,
  CASE WHEN f_time > 0.55 THEN '{_R['time_good']}' WHEN f_time < -0.55 THEN '{_R['time_bad']}' END,
  CASE WHEN f_straight > 0.65 THEN '{_R['straight']}' END, CASE WHEN f_turn > 0.65 THEN '{_R['turn']}' END,
  CASE WHEN f_lap > 0.65 THEN '{_R['lap']}' END,
  CASE WHEN rough AND lane >= 5 THEN '{_R['rough_outer']}' END)"""


def card(t):
    """Race card with the raw model probability the data stands in for."""
    return t.race_entries.withColumn("raw_prob", F.col("racer_win_rate") / 20)


def _ranked(t, col, make):
    return ranks.with_race_values(t.race_entries.select("race_key", "lane", col), [col]).select(
        "race_key", "lane", r6(make(col)).alias("score")
    )


@query("rank_score_lower", f"SELECT race_key, lane, {R6(Z('exhibition_time'))} AS score FROM {{race_entries}}")
def rank_score_lower(t):
    return _ranked(t, "exhibition_time", ranks.lower_better)


@query("rank_score_higher", f"SELECT race_key, lane, {R6('-(' + Z('local_win_rate') + ')')} AS score FROM {{race_entries}}")
def rank_score_higher(t):
    return _ranked(t, "local_win_rate", ranks.higher_better)


@query(
    "pct_rank_avg",
    f"""SELECT race_key, lane, {R6(f'''CASE WHEN local_win_rate IS NULL THEN 0e0 ELSE
  (rank() OVER ({P} ORDER BY local_win_rate NULLS LAST) + (count(*) OVER (PARTITION BY race_key, local_win_rate) - 1) / 2e0)
  / count(local_win_rate) OVER ({P}) END''')} AS score FROM {{race_entries}}""",
)
def pct_rank_avg(t):
    score = ranks.percent_rank_average(F.col("local_win_rate"), ranks.race_window())
    return t.race_entries.select("race_key", "lane", r6(score).alias("score"))


@query(
    "min_valid_gate",
    f"""SELECT race_key, lane, CASE WHEN count(original_straight) OVER ({P}) >= 4
  THEN {R6(Z('original_straight'))} ELSE 0e0 END AS score FROM {{race_entries}}""",
)
def min_valid_gate(t):
    return _ranked(t, "original_straight", lambda c: ranks.gated(c, K.MIN_VALID))


@query(
    "normalize_in_race",
    f"SELECT race_key, lane, {R6(f'motor_2ren / sum(motor_2ren) OVER ({P})')} AS share FROM {{race_entries}} "
    "QUALIFY sum(motor_2ren) OVER (PARTITION BY race_key) > 0 UNION ALL "
    f"SELECT race_key, lane, {R6(f'1e0 / count(*) OVER ({P})')} FROM {{race_entries}} "
    "QUALIFY NOT sum(motor_2ren) OVER (PARTITION BY race_key) > 0",
)
def normalize_in_race(t):
    share = ranks.normalise(F.col("motor_2ren"), ranks.race_window())
    return t.race_entries.select("race_key", "lane", r6(share).alias("share"))


def feature_query(name: str, column: str, extra: str = ""):
    @query(name, f"WITH {FEATURE_SQL} SELECT race_key, lane, {R6(column)} AS score FROM feat")
    def run(t):
        return features.with_features(card(t)).select("race_key", "lane", r6(column).alias("score"))


feature_query("adj_current_meet", "f_meet")
feature_query("adj_course", "f_course")
feature_query("adj_class", "f_class")
feature_query("adj_venue_course", "f_venue")
feature_query("rough_water_bonus", "f_bonus")
feature_query("weather_adjust", "f_weather")


@query(
    "adj_exhibition",
    f"""WITH {FEATURE_SQL} SELECT race_key, lane, {R6('f_time')} AS time_score,
  {R6('f_straight * 0.11e0 + f_turn * 0.11e0 + f_lap * 0.08e0')} AS original_score FROM feat""",
)
def adj_exhibition(t):
    return features.with_features(card(t)).select(
        "race_key", "lane", r6("f_time").alias("time_score"), r6(features.original_score()).alias("original_score")
    )


@query(
    "adjusted_win_prob",
    f"WITH {FEATURE_SQL} SELECT race_key, lane, {R6(p_sql(features.Weights()))} AS p_first, "
    f"{R6(adj_sql(features.Weights()))} AS adjustment FROM feat",
)
def adjusted_win_prob(t):
    return rounded(features.win_probability(card(t)).drop("reason"), "p_first", "adjustment")


@query(
    "reason_labels",
    f"WITH {FEATURE_SQL} SELECT race_key, lane, {REASON_SQL} AS reason FROM (SELECT race_key, lane, {REASON_PARTS} AS t FROM feat)",
)
def reason_labels(t):
    return features.win_probability(card(t)).select("race_key", "lane", "reason")


@query(
    "ablation_variants",
    f"WITH {FEATURE_SQL} "
    + " UNION ALL ".join(
        f"SELECT race_key, '{n}' AS variant, lane, {R6(p_sql(w))} AS p_first FROM feat" for n, w in features.VARIANTS.items()
    ),
)
def ablation_variants(t):
    return rounded(features.variants(card(t)), "p_first")


@query(
    "prob_delta",
    f"""WITH {FEATURE_SQL}, b AS (SELECT race_key, lane, {p_sql(features.BEFORE_DISPLAY)} AS p FROM feat),
a AS (SELECT race_key, lane, {p_sql(features.Weights())} AS p FROM feat)
SELECT a.race_key, a.lane, {R6('b.p')} AS p_first_before, {R6('a.p')} AS p_first_after, {R6('a.p - b.p')} AS delta
FROM a JOIN b ON a.race_key = b.race_key AND a.lane = b.lane""",
)
def prob_delta(t):
    return rounded(features.probability_change(card(t)), "p_first_before", "p_first_after", "delta")


@query(
    "favourite_per_race",
    f"""SELECT race_key, lane AS favourite, {R6('p_first')} AS p_first FROM {{win_probs}}
QUALIFY row_number() OVER ({P} ORDER BY p_first DESC, lane) = 1""",
)
def favourite_per_race(t):
    best = F.struct("p_first", -F.col("lane"))
    out = t.win_probs.groupBy("race_key").agg(F.max_by("lane", best).alias("favourite"), F.max("p_first").alias("p_first"))
    return rounded(out, "p_first")


def _worse(col: str, sign: str) -> str:
    return f"(count({col}) OVER ({P}) >= 3 AND {col} {sign} median({col}) OVER ({P}))"


@query(
    "favourite_risk",
    f"""WITH j AS (SELECT e.*, w.p_first FROM {{race_entries}} e JOIN {{win_probs}} w ON e.race_key = w.race_key AND e.lane = w.lane),
s AS (SELECT race_key, lane AS favourite, p_first, exhibition_st < 0 AS fl,
  coalesce({_worse('original_straight', '>')}, false) AS s1, coalesce({_worse('original_turn', '>')}, false) AS s2,
  coalesce({_worse('exhibition_time', '>')}, false) AS s3, coalesce({_worse('motor_2ren', '<')}, false) AS s4,
  coalesce({_worse('boat_2ren', '<')}, false) AS s5, coalesce(current_meet_top2_rate < 30, false) AS s6 FROM j)
SELECT race_key, favourite, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT + s6::INT AS risk_score,
  concat_ws(' / ', CASE WHEN fl THEN '{K.RISK['flying']}' END, CASE WHEN s1 THEN '{K.RISK['original_straight']}' END,
    CASE WHEN s2 THEN '{K.RISK['original_turn']}' END, CASE WHEN s3 THEN '{K.RISK['exhibition_time']}' END,
    CASE WHEN s4 THEN '{K.RISK['motor_2ren']}' END, CASE WHEN s5 THEN '{K.RISK['boat_2ren']}' END,
    CASE WHEN s6 THEN '{K.RISK['current_meet_top2_rate']}' END) AS reasons
FROM s QUALIFY row_number() OVER ({P} ORDER BY p_first DESC, favourite) = 1""",
)
def favourite_risk(t):
    return features.favourite_risk(with_probability(t))


def with_probability(t):
    """Card and win probability from one pass: both come from the same race partitioning."""
    p = F.exp(F.col("racer_win_rate") / 5)
    return t.race_entries.withColumn("p_first", p / F.sum(p).over(ranks.race_window()))


@query(
    "confidence_grade",
    f"""WITH j AS (SELECT e.*, w.p_first FROM {{race_entries}} e JOIN {{win_probs}} w ON e.race_key = w.race_key AND e.lane = w.lane),
g AS (SELECT race_key, count(*) AS n, max(p_first) AS p1, (list_sort(list(p_first), 'DESC'))[2] AS p2,
  (count(racer_win_rate) + count(local_win_rate) + count(motor_2ren) + count(boat_2ren) + count(avg_st) + count(exhibition_time))
    / (6e0 * count(*)) AS completeness FROM j GROUP BY race_key)
SELECT race_key, {R6('p1 - p2')} AS margin, {R6('completeness')} AS completeness,
  CASE WHEN n < 2 THEN 'C' WHEN (p1 - p2) * 0.88 + completeness * 0.18 > 0.33 THEN 'A'
       WHEN (p1 - p2) * 0.88 + completeness * 0.18 > 0.20 THEN 'B' ELSE 'C' END AS grade FROM g""",
)
def confidence_grade(t):
    return rounded(features.confidence(with_probability(t)), "margin", "completeness")


@query(
    "completeness",
    "SELECT race_key, "
    + ", ".join(f"count({c}) AS n_{c}" for c in K.COMPLETENESS)
    + ", concat_ws(' / ', "
    + ", ".join(f"CASE WHEN count({c}) < 6 THEN concat('{l}(', count({c}), '/6)') END" for c, l in K.COMPLETENESS.items())
    + ") AS missing FROM {race_entries} GROUP BY race_key",
)
def completeness(t):
    return features.completeness(t.race_entries)


@query(
    "current_meet_agg",
    f"""SELECT race_key, lane, {R6('avg(f)')} AS current_meet_avg_finish,
  {R6('1e2 * count(*) FILTER (WHERE f <= 2) / nullif(count(f), 0)')} AS current_meet_top2_rate,
  {R6('avg(s)')} AS current_meet_avg_st, count(*) AS current_meet_races
FROM (SELECT race_key, lane, TRY_CAST(finish AS INT) AS f,
        CASE WHEN st LIKE 'F%' THEN -1e0 ELSE 1e0 END * TRY_CAST(replace(st, 'F', '') AS DOUBLE) AS s, course FROM {{starts}})
WHERE s IS NOT NULL AND course IN ('1', '2', '3', '4', '5', '6') GROUP BY race_key, lane""",
)
def current_meet_agg(t):
    out = features.current_meet(t.starts)
    return rounded(out, "current_meet_avg_finish", "current_meet_top2_rate", "current_meet_avg_st")


TILT = "(race_key + lane) % 9 / 2e0 - 1e0 + CASE WHEN race_key % 5 = 0 THEN 1e-1 ELSE 0e0 END"


@query(
    "plausible_ranges",
    f"""SELECT race_key, lane, CASE WHEN avg_st >= 0 AND avg_st < 1 THEN avg_st END AS avg_st,
  CASE WHEN racer_win_rate BETWEEN 0 AND 10 THEN racer_win_rate END AS racer_win_rate,
  CASE WHEN local_win_rate BETWEEN 0 AND 10 THEN local_win_rate END AS local_win_rate,
  CASE WHEN motor_2ren BETWEEN 0 AND 100 THEN motor_2ren END AS motor_2ren,
  CASE WHEN exhibition_time BETWEEN 6 AND 8.5 THEN exhibition_time END AS exhibition_time,
  CASE WHEN tilt BETWEEN -0.5 AND 3 AND abs(tilt * 2 - round_even(tilt * 2, 0)) < 1e-9 THEN tilt END AS tilt
FROM (SELECT race_key, lane, avg_st * (1 + race_key % 8) AS avg_st, racer_win_rate + lane AS racer_win_rate,
  local_win_rate - race_key % 3 AS local_win_rate, motor_2ren + race_key % 40 AS motor_2ren,
  exhibition_time + race_key % 4 AS exhibition_time, {TILT} AS tilt FROM {{race_entries}})""",
)
def plausible_ranges(t):
    k = F.col("race_key")
    wild = t.race_entries.select(
        "race_key",
        "lane",
        (F.col("avg_st") * (1 + k % 8)).alias("avg_st"),
        (F.col("racer_win_rate") + F.col("lane")).alias("racer_win_rate"),
        (F.col("local_win_rate") - k % 3).alias("local_win_rate"),
        (F.col("motor_2ren") + k % 40).alias("motor_2ren"),
        (F.col("exhibition_time") + k % 4).alias("exhibition_time"),
        F.expr(TILT).alias("tilt"),
    )
    return features.plausible(wild)
