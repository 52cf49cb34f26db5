"""Budget allocation over the tickets of a race.

The stepwise rules (take or add one unit at a time) have closed forms in running sums, so a race
needs three ordered passes over its handful of tickets and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.ranks import race_window, whole


def round_to_unit(x: Column, unit: int) -> Column:
    """Nearest multiple of ``unit``, halves to the even multiple."""
    return (F.bround(x / unit) * unit).cast("int")


def group_value(mapping: dict[str, float], default: float) -> Column:
    (first, value), *rest = mapping.items()
    chain = F.when(F.col("group") == first, value)
    for name, value in rest:
        chain = chain.when(F.col("group") == name, value)
    return chain.otherwise(default)


def clamp(x: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), hi)


def earlier_sum(value: Column, order) -> Column:
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def whole_units(amount: Column, unit: int) -> Column:
    return F.floor(F.greatest(amount, F.lit(0)) / unit).cast("int")


def allocate_smart(
    tickets: DataFrame,
    budget: int = 2000,
    unit: int = 100,
    min_bet: int = 100,
    max_longshot_share: float = 0.15,
    max_ticket_share: float = 0.35,
    ev_floor: float = 0.65,
    hard_ev_cut: float = 0.40,
    very_low_prob: float = 0.003,
    value_bias: float = 0.0,
) -> DataFrame:
    """Stake and its reason per ticket, within budget, ticket cap and longshot cap."""
    if budget <= 0:
        return tickets.withColumns({"stake": F.lit(0), "stake_reason": F.lit(None).cast("string")})
    half_even = lambda x: round(x / unit) * unit
    bias = min(max(float(value_bias), 0.0), 1.0)
    cap = max(min_bet, half_even(budget * max_ticket_share))
    long_cap = max(0, half_even(budget * max_longshot_share))
    w, c = race_window(), F.col

    prob = F.greatest(F.coalesce("prob", F.lit(0.0)), F.lit(0.0))
    d = tickets.withColumn("prob", prob)
    d = d.withColumn("expected_return", F.coalesce("expected_return", c("prob") * c("odds")))
    ev = c("expected_return")
    ev_tier = (
        F.when(ev.isNull(), K.NO_RETURN_FACTOR).when(ev < hard_ev_cut, K.CUT_FACTOR).when(ev < ev_floor, K.FLOOR_FACTOR)
    )
    for edge, factor in K.RETURN_FACTORS:
        ev_tier = ev_tier.when(ev < edge, factor)
    ev_tier = ev_tier.otherwise(K.TOP_RETURN_FACTOR)
    edge = F.coalesce(F.greatest(ev - 1.0, F.lit(0.0)), F.lit(0.0))
    ev_factor = ev_tier * (1.0 + bias * F.least(edge, F.lit(K.EDGE_CAP)) * K.EDGE_GAIN)
    prob_factor = (
        F.when(c("prob") < K.TINY_PROB, K.TINY_FACTOR[0] + K.TINY_FACTOR[1] * bias)
        .when(c("prob") < very_low_prob, K.LOW_FACTOR[0] + K.LOW_FACTOR[1] * bias)
        .when(c("prob") < K.SMALL_PROB, K.SMALL_FACTOR[0] + K.SMALL_FACTOR[1] * bias)
        .otherwise(1.0)
    )
    group_factor = (1 - bias) * group_value(K.GROUP_WEIGHT, 0.50) + bias * group_value(K.GROUP_WEIGHT_VALUE, 0.80)
    score = group_factor * F.pow("prob", F.lit(K.PROB_EXPONENT[0] - K.PROB_EXPONENT[1] * bias)) * ev_factor * prob_factor
    is_long = c("group") == K.LONGSHOT
    weak_long = F.coalesce(is_long & (ev < ev_floor), F.lit(False))
    d = d.withColumns({"_long": F.coalesce(is_long, F.lit(False)), "_score": score * F.when(weak_long, K.WEAK_LONGSHOT_FACTOR).otherwise(1.0)})

    # nothing scores: fall back to probability, then to equal shares
    d = d.withColumns({"_scores": F.sum("_score").over(w), "_probs": F.sum("prob").over(w), "_n": F.count(F.lit(1)).over(w)})
    fallback = lambda score, prob, equal: F.when(c("_scores") > 0, score).when(c("_probs") > 0, prob).otherwise(equal)
    total = fallback(c("_scores"), c("_probs"), c("_n").cast("double"))
    d = d.withColumn("_score", fallback(c("_score"), c("prob"), F.lit(1.0)))
    d = d.withColumn("_raw", F.least(budget * c("_score") / total, F.lit(float(cap))))
    d = d.withColumn("_long_total", F.sum(F.when(c("_long"), c("_raw")).otherwise(0.0)).over(w))
    shrink = F.when(c("_long") & (c("_long_total") > long_cap), long_cap / c("_long_total")).otherwise(1.0)
    d = d.withColumn("stake", round_to_unit(c("_raw") * shrink, unit))
    d = d.withColumn("stake", F.when(c("stake") > 0, F.greatest("stake", F.lit(min_bet))).otherwise(0))

    # over budget: drain the least important tickets first
    rank = F.when(c("_long"), 0).when(c("group") == K.MAIN, 2).otherwise(1)
    weakest = w.orderBy(rank, "_score", "prob", "combo")
    d = d.withColumn("_rest", F.sum("stake").over(whole(weakest)) - budget - earlier_sum(c("stake"), weakest))
    cut = c("stake") - F.ceil(F.least("_rest", "stake") / unit).cast("int") * unit
    d = d.withColumn("stake", F.when(c("_rest") > 0, F.when(cut >= min_bet, cut).otherwise(0)).otherwise(c("stake")))

    # under budget: fill the best tickets up to their caps
    best = w.orderBy(c("_score").desc(), c("prob").desc(), "combo")
    long_only = lambda x: F.when(c("_long"), c(x)).otherwise(0)
    d = d.withColumn("_room", whole_units(cap - c("stake"), unit))
    d = d.withColumns(
        {
            "_free": whole_units(budget - F.sum("stake").over(whole(best)), unit),
            "_free_long": whole_units(long_cap - F.sum(long_only("stake")).over(whole(best)), unit),
            "_before": earlier_sum(long_only("_room"), best),
        }
    )
    fit = F.when(c("_long"), clamp(c("_free_long") - c("_before"), c("_room"))).otherwise(c("_room"))
    d = d.withColumn("_fit", fit)
    more = clamp(c("_free") - earlier_sum(c("_fit"), best), c("_fit")) * unit
    d = d.withColumn("stake", (c("stake") + more).cast("int"))

    label = K.STAKE_REASON
    reason = (
        F.when(c("stake") <= 0, label["none"])
        .when(c("_long") & (c("prob") < very_low_prob), label["tiny"])
        .when(ev < 1.0, label["low"])
        .when(F.lit(bias >= 0.3) & (ev >= 1.5), label["value"])
        .when(c("group") == K.MAIN, label["main"])
        .when(c("_long"), label["longshot"])
        .otherwise(label["other"])
    )
    return d.withColumn("stake_reason", reason).drop(*[x for x in d.columns if x.startswith("_")])


def allocate_largest_remainder(tickets: DataFrame, budget: int = 2000, unit: int = 100, min_bet: int = 100) -> DataFrame:
    """Minimum bet each, the rest by largest remainder; single units when the budget is too small."""
    unit = max(100, int(unit))
    budget = max(0, int(budget)) // unit * unit
    min_bet = max(unit, int(min_bet)) // unit * unit
    if budget <= 0:
        return tickets.withColumn("stake", F.lit(0))
    w, c = race_window(), F.col
    p = F.sqrt(F.greatest(F.coalesce("prob", F.lit(0.0)), F.lit(0.0)))
    ev = F.least(F.greatest(F.coalesce("expected_return", F.lit(1.0)), F.lit(0.5)), F.lit(2.5))
    is_long = c("group") == K.LONGSHOT
    score = group_value(K.GROUP_WEIGHT_OLD, 0.5) * (0.72 * p + 0.28 * p * ev)
    score = score * F.when(is_long, 0.85 + 0.25 * ev).otherwise(1.0)
    score = score * F.when(is_long & (c("prob") < 0.003), 0.55).otherwise(1.0)
    d = tickets.withColumn("_score", score)
    d = d.withColumns({"_n": F.count(F.lit(1)).over(w), "_total": F.sum("_score").over(w)})
    d = d.withColumns(
        {
            "_best": F.row_number().over(w.orderBy(c("_score").desc(), "combo")),
            "_spare": F.greatest(budget - c("_n") * min_bet, F.lit(0)),
        }
    )
    share = F.when(c("_total") > 0, c("_score") / c("_total") * (c("_spare") / unit)).otherwise(0.0)
    d = d.withColumn("_share", share).withColumn("_units", F.floor("_share").cast("int"))
    turn = w.orderBy((c("_share") - c("_units")).desc(), "combo")
    d = d.withColumns(
        {
            "_left": F.when(c("_total") > 0, F.floor(c("_spare") / unit) - F.sum("_units").over(whole(turn))).otherwise(0),
            "_turn": F.row_number().over(turn),
        }
    )
    enough = min_bet + (c("_units") + (c("_turn") <= c("_left")).cast("int")) * unit
    scarce = F.when(c("_best") <= budget // unit, unit).otherwise(0)
    stake = F.when(c("_n") * min_bet > budget, scarce).otherwise(enough).cast("int")
    return d.withColumn("stake", stake).drop(*[x for x in d.columns if x.startswith("_")])
