"""Ticket ranking: main, cover and longshot groups with an optional hedge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.ranks import percent_rank_average, race_window, whole
from racebook.operators.joins import latest_odds


def with_odds(outcomes: DataFrame, odds: DataFrame, order: list[str]) -> DataFrame:
    """Outcomes with the latest price of their combination, missing where there is none."""
    keys = ["race_key", "combo"]
    return outcomes.join(latest_odds(odds, keys, order), keys, "left")


def with_ranks(outcomes: DataFrame) -> DataFrame:
    """Expected return and the percentile ranks of probability, return and price.

    The price enters by rank only, so its logarithm would give the same order.
    """
    w = race_window()
    d = outcomes.withColumns(
        {"prob": F.coalesce("prob", F.lit(0.0)), "expected_return": F.col("prob") * F.col("odds")}
    )
    capped = F.least(F.greatest("expected_return", F.lit(0.0)), F.lit(K.RETURN_CAP))
    capped = F.when(F.col("expected_return").isNotNull(), capped)
    price = F.when(F.col("odds").isNotNull(), F.greatest("odds", F.lit(0.0)))
    return d.withColumns(
        {
            "prob_rank": percent_rank_average(F.col("prob"), w),
            "ev_rank": percent_rank_average(capped, w),
            "odds_rank": percent_rank_average(price, w),
        }
    )


def rank_tickets(
    outcomes: DataFrame,
    main_n: int = 3,
    cover_n: int = 3,
    longshot_n: int = 2,
    longshot_min_prob: float = 0.003,
    longshot_exception_ev: float = 1.80,
) -> DataFrame:
    """Tickets of each race from its outcomes with ``odds`` and a nullable ``hedge_lane``.

    Groups are filled one after the other, each from what the earlier ones left. A race without
    any price falls back to probability order by itself: its return ranks are all 0. Every step
    sorts all outcomes of a race, so the rows carry one number per outcome instead of its lanes.
    """
    w, c = race_window(), F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    hedge = c("hedge_lane")
    slim = outcomes.select(
        "race_key",
        (c("a") * 100 + c("b") * 10 + c("c")).alias("code"),
        "prob",
        "odds",
        ((c("a") != hedge) & (c("b") != hedge) & (c("c") != hedge)).alias("_outside"),
    )
    d = with_ranks(slim)

    strong = yes(c("expected_return") >= K.MAIN_MIN_RETURN) | (c("prob_rank") >= K.MAIN_MIN_RANK)
    d = d.withColumn("_pool", strong).withColumn("_n", F.count_if("_pool").over(w))
    d = d.withColumns(
        {
            "_open": c("_pool") | (c("_n") < main_n),
            "_score": c("prob_rank") * K.MAIN_SCORE[0] + c("ev_rank") * K.MAIN_SCORE[1],
        }
    )
    order = w.orderBy(c("_open").desc(), c("_score").desc(), c("prob").desc(), "code")
    d = d.withColumn("_main", F.when(c("_open"), F.row_number().over(order))).drop("_pool", "_n", "_open")
    d = d.withColumn("_main", F.when(c("_main") <= main_n, c("_main")))

    penalty = F.when(yes(c("expected_return") < K.COVER_LOW_RETURN), K.COVER_PENALTY).otherwise(0.0)
    d = d.withColumn("_score", c("prob_rank") * K.COVER_SCORE[0] + c("ev_rank") * K.COVER_SCORE[1] - penalty)
    order = w.orderBy(c("_main").isNotNull(), c("_score").desc(), c("prob").desc(), "code")
    d = d.withColumn("_cover", F.when(c("_main").isNull(), F.row_number().over(order)))
    d = d.withColumn("_cover", F.when(c("_cover") <= cover_n, c("_cover")))

    left = c("_main").isNull() & c("_cover").isNull()
    value = yes(c("expected_return") >= K.LONGSHOT_MIN_RETURN)
    likely = (c("prob") >= longshot_min_prob) | yes(c("expected_return") >= longshot_exception_ev)
    d = d.withColumns({"_left": left, "_best": left & value & likely, "_good": left & value})
    d = d.withColumns({"_n1": F.count_if("_best").over(w), "_n2": F.count_if("_good").over(w)})
    pool = (
        F.when(c("_n1") >= longshot_n, c("_best")).when(c("_n2") >= longshot_n, c("_good")).otherwise(c("_left"))
    )
    too_low = (c("prob") < longshot_min_prob) & yes(c("expected_return") < longshot_exception_ev)
    parts = K.LONGSHOT_SCORE
    score = c("ev_rank") * parts[0] + c("odds_rank") * parts[1] + c("prob_rank") * parts[2]
    d = d.withColumns({"_pool": pool, "_score": score - F.when(too_low, K.LONGSHOT_PENALTY).otherwise(0.0)})
    best_return = c("expected_return").desc_nulls_last()
    order = w.orderBy(c("_pool").desc(), c("_score").desc(), best_return, c("prob").desc(), "code")
    d = d.withColumn("_long", F.when(c("_pool"), F.row_number().over(order))).drop("_pool", "_best", "_good", "_n1", "_n2")
    d = d.withColumn("_long", F.when(c("_long") <= longshot_n, c("_long")))

    # swap the last longshot for the best outcome without the hedged lane, if all longshots hold it
    d = d.withColumns(
        {
            "_free": yes(c("_outside")) & c("_left"),
            "_kept": c("_long").isNotNull() & c("_outside"),
            "_score": c("ev_rank") * K.HEDGE_SCORE[0] + c("prob_rank") * K.HEDGE_SCORE[1],
        }
    )
    order = w.orderBy(c("_free").desc(), c("_score").desc(), best_return, c("prob").desc(), "code")
    d = d.withColumns(
        {
            "_turn": F.row_number().over(order),
            "_taken": F.max("_long").over(whole(order)),
            "_held": F.count_if("_kept").over(whole(order)),
            "_any": F.max("_free").over(whole(order)),
        }
    )
    need = c("_outside").isNotNull() & (c("_held") == 0)
    d = d.withColumns({"_hedge": need & c("_free") & (c("_turn") == 1), "_swap": (c("_held") == 0) & c("_any")})
    d = d.withColumn(
        "_long",
        F.when(c("_hedge"), c("_taken")).when(~(c("_swap") & (c("_long") == c("_taken"))), c("_long")),
    )
    group = F.when(c("_main").isNotNull(), K.MAIN).when(c("_cover").isNotNull(), K.COVER).when(c("_long").isNotNull(), K.LONGSHOT)
    digits = c("code").cast("string")
    combo = F.concat_ws("-", *[F.substring(digits, i, 1) for i in (1, 2, 3)])
    return (
        d.withColumn("group", group)
        .filter(c("group").isNotNull())
        .select(
            "race_key", combo.alias("combo"), "prob", "odds", "expected_return", "group",
            F.coalesce("_main", "_cover", "_long").alias("place"), c("_hedge").alias("is_hedge"),
        )
    )
