"""Analysis views by name, for SQL.

Result rows and purchased tickets are reduced once, with map-side combination, to stored cubes of sums that can be added up
further. Each view adds up one cube, so a query of a view reads some hundred rows and never the results; registering
again after new results replaces the views of the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook.operators import verify
from racebook.sources.stores import store

RACE_MEASURES = """sum(races) AS races, sum(first_hits) / sum(races) AS first_hit_rate, sum(any_hits) / sum(races) AS ticket_hit_rate,
  sum(top_hits) / sum(races) AS top_ticket_hit_rate, sum(stake) AS total_stake, sum(paid) AS total_payout,
  sum(paid) - sum(stake) AS profit, try_divide(sum(paid), nullif(sum(stake), 0)) AS roi, try_divide(sum(brier), sum(rated)) AS brier_first"""
TICKET_MEASURES = """sum(tickets) AS tickets, sum(hits) AS hits, sum(total_stake) AS total_stake, sum(total_payout) AS total_payout,
  try_divide(sum(total_payout), sum(total_stake)) AS roi"""


def race_cube(results: DataFrame) -> DataFrame:
    """Sums per venue, favourite lane and probability band."""
    yes = lambda c: F.coalesce(verify.truthy(F.col(c)), F.lit(False))
    gap = F.pow(verify.number(F.col("p1_prob")) - yes("predicted_first_hit").cast("double"), F.lit(2))
    return results.groupBy("venue_no", "p1_lane", verify.band(F.col("p1_prob")).alias("band")).agg(
        F.count(F.lit(1)).alias("races"),
        F.count_if(yes("predicted_first_hit")).alias("first_hits"),
        F.count_if(yes("hit_any_ticket")).alias("any_hits"),
        F.count_if(yes("hit_top_ticket")).alias("top_hits"),
        F.coalesce(F.sum("total_stake"), F.lit(0)).alias("stake"),
        F.coalesce(F.sum("payout"), F.lit(0)).alias("paid"),
        F.sum(gap).alias("brier"),
        F.count(gap).alias("rated"),
    )


def ticket_cube(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Sums per ticket group and return band."""
    ev: Column = verify.ev_band(F.col("prob") * F.col("odds"))
    both = verify.ticket_performance(tickets, results, F.struct(F.col("ticket_group"), ev.alias("ev_band")), "k")
    return both.select("k.*", "tickets", "hits", "total_stake", "total_payout")


def register_views(results: DataFrame, tickets: DataFrame, official: DataFrame) -> list[str]:
    """Register the six views in the session of ``results`` and return their names."""
    spark = results.sparkSession
    store(race_cube(results), "race-cube").createOrReplaceTempView("perf_race_cube")
    store(ticket_cube(tickets, official), "ticket-cube").createOrReplaceTempView("perf_ticket_cube")
    spark.sql(f"CREATE OR REPLACE TEMP VIEW perf_overall AS SELECT {RACE_MEASURES} FROM perf_race_cube")
    for key in ("venue", "lane", "prob_band"):
        column = {"venue": "venue_no", "lane": "p1_lane", "prob_band": "band"}[key]
        spark.sql(f"CREATE OR REPLACE TEMP VIEW perf_by_{key} AS SELECT {column}, {RACE_MEASURES} FROM perf_race_cube GROUP BY {column}")
    for key in ("ticket_group", "ev_band"):
        spark.sql(f"CREATE OR REPLACE TEMP VIEW perf_by_{key} AS SELECT {key}, {TICKET_MEASURES} FROM perf_ticket_cube GROUP BY {key}")
    return ["perf_overall", "perf_by_venue", "perf_by_lane", "perf_by_prob_band", "perf_by_ticket_group", "perf_by_ev_band"]
