"""Queries that bring several sources together."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook.functions import scalars
from racebook.operators import features, joins
from racebook.plans.registry import R6, query, rounded


@query(
    "race_card_left_join",
    f"""WITH meet AS (SELECT race_key, lane, count(*) AS n FROM (SELECT * FROM {{starts}} WHERE st <> 'L' AND course <> '7') s GROUP BY ALL)
SELECT e.race_key, e.lane, e.racer_id, e.racer_win_rate, m.n AS current_meet_races, o.original_straight, c.course_top3_rate,
  c.course_starts, p.venue_course_1st
FROM {{race_entries}} e LEFT JOIN meet m ON m.race_key = e.race_key AND m.lane = e.lane
LEFT JOIN (SELECT race_key, lane, original_straight FROM {{race_entries}} WHERE original_straight IS NOT NULL) o ON o.race_key = e.race_key AND o.lane = e.lane
LEFT JOIN {{course_stats}} c ON c.racer_id = e.racer_id AND c.course = e.lane
LEFT JOIN {{venue_profile}} p ON p.venue = e.venue AND p.course = e.lane""",
)
def race_card_left_join(t):
    entries = t.race_entries.select("race_key", "lane", "racer_id", "venue", "racer_win_rate")
    own = t.race_entries.select("race_key", "lane", "original_straight").filter("original_straight IS NOT NULL")
    meet = features.current_meet(t.starts).select("race_key", "lane", "current_meet_races")
    out = joins.race_card(entries, meet, t.course_stats, own, t.venue_profile)
    return out.select(
        "race_key", "lane", "racer_id", "racer_win_rate", "current_meet_races", "original_straight", "course_top3_rate",
        "course_starts", "venue_course_1st",
    )


@query(
    "race_card_full_outer",
    """WITH c AS (SELECT race_key, lane, CASE WHEN racer_class = 'A1' THEN ' ' ELSE concat('R', racer_id) END AS racer_name, racer_win_rate
  FROM {race_entries} WHERE racer_class IS NOT NULL),
b AS (SELECT race_key, lane, concat('B', racer_id) AS racer_name, exhibition_time FROM {race_entries} WHERE exhibition_time IS NOT NULL)
SELECT coalesce(c.race_key, b.race_key) AS race_key, coalesce(c.lane, b.lane) AS lane,
  coalesce(nullif(trim(c.racer_name), ''), b.racer_name) AS racer_name, c.racer_win_rate, b.exhibition_time
FROM c FULL JOIN b ON b.race_key = c.race_key AND b.lane = c.lane""",
)
def race_card_full_outer(t):
    name = F.when(F.col("racer_class") == "A1", " ").otherwise(F.concat(F.lit("R"), "racer_id"))
    card = t.race_entries.filter("racer_class IS NOT NULL").select("race_key", "lane", name.alias("racer_name"), "racer_win_rate")
    before = t.race_entries.filter("exhibition_time IS NOT NULL").select(
        "race_key", "lane", F.concat(F.lit("B"), "racer_id").alias("racer_name_beforeinfo"), "exhibition_time"
    )
    return joins.race_card_outer(card, before)


@query(
    "venue_default_fill",
    """SELECT n.n_nationkey AS venue_no, s.n IS NOT NULL AS holding, coalesce(s.n, 0) AS races, coalesce(s.status, '') AS status
FROM {nation} n LEFT JOIN (SELECT s_nationkey, count(*) AS n, concat(count(*), 'R') AS status FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
  ON s.s_nationkey = n.n_nationkey""",
)
def venue_default_fill(t):
    facts = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("venue_no")).agg(F.count("*").alias("races"))
    facts = facts.withColumns({"holding": F.lit(True), "status": F.concat(F.col("races"), F.lit("R"))})
    venues = t.nation.select(F.col("n_nationkey").alias("venue_no"))
    return joins.fill_defaults(venues, facts, "venue_no", {"holding": False, "races": 0, "status": ""}).select(
        "venue_no", "holding", "races", "status"
    )


CHECK_SQL = """WITH a AS (SELECT race_key, trifecta AS v FROM {official_results}),
b AS (SELECT r.race_key, CASE WHEN o.o_orderpriority = '1-URGENT' THEN concat(r.second, '-', r.first, '-', r.third) ELSE r.trifecta END AS v
  FROM {official_results} r JOIN {orders} o ON o.o_orderkey = r.race_key WHERE o.o_orderstatus <> 'P')
SELECT coalesce(a.race_key, b.race_key) AS race_key, a.v AS value_a, b.v AS value_b,
  CASE WHEN a.v = b.v THEN 'agree' WHEN a.v IS NULL OR b.v IS NULL THEN 'single source' ELSE 'quarantine' END AS verdict
FROM a FULL JOIN b ON a.race_key = b.race_key"""


@query("source_crosscheck", CHECK_SQL)
def source_crosscheck(t):
    orders = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("race_key"), "o_orderpriority")
    swapped = F.concat_ws("-", "second", "first", "third")
    other = t.official_results.join(orders, "race_key").select(
        "race_key", F.when(F.col("o_orderpriority") == "1-URGENT", swapped).otherwise(F.col("trifecta")).alias("trifecta")
    )
    return joins.crosscheck(t.official_results, other, "race_key", "trifecta")


@query(
    "normalized_name_join",
    """SELECT c.c_custkey AS racer_no, c.c_name AS racer_name, m.comment FROM {customer} c LEFT JOIN (
  SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS comment FROM {orders} GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey""",
)
def normalized_name_join(t):
    spaced = F.concat(F.lit("Cus tomer　#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))
    comments = t.orders.select(spaced.alias("name"), F.col("o_orderpriority").alias("comment"), F.col("o_orderkey").alias("entry"))
    racers = t.customer.select(F.col("c_custkey").alias("racer_no"), F.col("c_name").alias("racer_name"))
    return joins.comments_by_name(racers, comments, "entry")


@query(
    "folded_name_join",
    """SELECT c.c_custkey AS racer_no, 'ガ' || c.c_name AS racer_name, m.comment FROM {customer} c LEFT JOIN (
  SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS comment FROM {orders} GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey""",
)
def folded_name_join(t):
    """Names entered in half-width, full-width and decomposed signs meet the composed ones."""
    plain = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    form = F.col("o_orderkey") % 3
    entered = (
        F.when(form == 0, F.concat(F.lit("ｶﾞ"), plain))
        .when(form == 1, F.concat(F.lit("カ\u3099 "), plain))
        .otherwise(F.concat(F.lit("ガ"), F.translate(plain, scalars.NARROW, scalars.WIDE)))
    )
    comments = t.orders.select(entered.alias("name"), F.col("o_orderpriority").alias("comment"), F.col("o_orderkey").alias("entry"))
    racers = t.customer.select(F.col("c_custkey").alias("racer_no"), F.concat(F.lit("ガ"), "c_name").alias("racer_name"))
    return joins.comments_by_name(racers, comments, "entry")


@query(
    "priority_coalesce",
    """SELECT race_key, arg_min(v, p) FILTER (WHERE v IS NOT NULL) AS racer_class, min(p) FILTER (WHERE v IS NOT NULL) AS priority FROM (
  SELECT race_key, lane - 1 AS p, nullif(trim(coalesce(racer_class, ' ')), '') AS v FROM {race_entries} WHERE lane <= 3) GROUP BY race_key""",
)
def priority_coalesce(t):
    klass = F.coalesce("racer_class", F.lit(" "))
    source = lambda i: t.race_entries.filter(F.col("lane") == i).select("race_key", klass.alias("racer_class"))
    return joins.fill_by_priority([source(1), source(2), source(3)], "race_key", "racer_class")
