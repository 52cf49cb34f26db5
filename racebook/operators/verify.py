"""Frozen predictions against official results: records, metrics, calibration, ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.scalars import once
from racebook.operators import documents
from racebook.schemas import PAYLOAD


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """Text or number as a finite double; anything else is missing."""
    return finite(c.try_cast("double"))


def truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin("true", "1")


def payloads(final: DataFrame, tickets: DataFrame, research: DataFrame | None = None) -> DataFrame:
    """One JSON document per race: lanes, tickets and the lanes of every research variant.

    A race has six lanes, a handful of tickets and seven variants, so its lists stay small.
    """
    lane_row = F.struct("lane", "racer_name", finite(F.col("p_first")).alias("p_first"), "reason")
    lanes = final.groupBy("race_key").agg(F.sort_array(F.collect_list(lane_row)).alias("final"))
    ticket_row = F.struct(
        "k", "combo", "group", "prob", "odds", "expected_return", F.col("stake").cast("double").alias("stake"), "stake_reason"
    )
    bets = tickets.groupBy("race_key").agg(F.sort_array(F.collect_list(ticket_row)).alias("t"))
    bets = bets.select("race_key", F.transform("t", lambda x: x.dropFields("k")).alias("tickets"))
    out = lanes.join(bets, "race_key")
    parts = ["final", "tickets"]
    if research is not None:
        per_variant = research.groupBy("race_key", "variant").agg(F.sort_array(F.collect_list(lane_row)).alias("rows"))
        maps = per_variant.groupBy("race_key").agg(
            F.map_from_entries(F.collect_list(F.struct("variant", "rows"))).alias("research")
        )
        out, parts = out.join(maps, "race_key"), parts + ["research"]
    return out.select("race_key", once(F.to_json(F.struct(*parts))).alias("payload_json"))


def parse_payload(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", once(F.from_json("payload_json", PAYLOAD)))


def usable(payload: Column) -> Column:
    """Both parts present and at least one row of each carries what the check needs."""
    final, tickets = payload.getField("final"), payload.getField("tickets")
    ok = (
        (F.size(final) > 0)
        & (F.size(tickets) > 0)
        & F.exists(final, lambda x: x.lane.isNotNull() & x.p_first.isNotNull())
        & F.exists(tickets, lambda x: x.combo.isNotNull() & x.stake.isNotNull())
    )
    return F.coalesce(ok, F.lit(False))


def split_broken(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable snapshots and the quarantine: an unreadable one is not a lost bet."""
    d = parse_payload(df).withColumn("ok", usable(F.col("payload")))
    return d.filter("ok").drop("ok"), d.filter(~F.col("ok")).select(*df.columns)


def hit_stake(tickets: Column, combo: Column) -> Column:
    """Whole stake on the actual combination."""
    return F.aggregate(
        F.filter(tickets, lambda x: (F.trim(x.combo) == F.trim(combo)) & (x.stake > 0)),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x.stake.cast("long"),
    )


def payout(per_100: Column, stake: Column) -> Column:
    """Official payout is per 100; fractions are cut."""
    return F.floor(per_100 * stake / 100)


def split_unreadable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots whose lanes can be read, parsed, and the quarantine of all others. A list of tickets may be empty or
    absent: then nothing was bought."""
    d = parse_payload(df)
    lanes = F.col("payload.final")
    d = d.withColumn("ok", F.coalesce(F.exists(lanes, lambda x: x.lane.between(1, 6) & x.p_first.isNotNull()), F.lit(False)))
    return d.filter("ok").drop("ok"), d.filter(~F.col("ok")).select(*df.columns)


def verification_records(snapshots: DataFrame, results: DataFrame) -> DataFrame:
    """One verification row per race from its frozen payload and the official result.

    Both sides hold one row per race, and the payload lists are read in place, so the join on
    the race is the only shuffle. Equal candidates keep the order of the payload. A race without
    tickets gives a row with stake 0. Time, date, venue and number of the race come along where a side has them.
    """
    good, _ = split_unreadable(snapshots)
    d = good.join(results, "race_key")
    kind = d.schema["payload"].dataType["tickets"].dataType
    d = d.withColumn("_tickets", F.coalesce("payload.tickets", F.array().cast(kind)))
    final = F.filter(F.col("payload.final"), lambda x: x.lane.between(1, 6))
    fav = F.array_max(
        F.transform(final, lambda x, i: F.struct(F.coalesce(x.p_first, F.lit(-1.0)), -i, x.lane, x.p_first.alias("p")))
    )
    tickets = F.col("_tickets")
    top = F.array_max(
        F.transform(
            tickets,
            lambda x, i: F.struct(
                F.coalesce(x.prob, F.lit(-1.0)), F.coalesce(x.expected_return, F.lit(-1.0)), -i,
                x.combo.alias("combo"), x.prob.alias("prob"), x.odds.alias("odds"), x.stake.cast("long").alias("stake"),
            ),
        )
    )
    bought = F.filter(tickets, lambda x: x.stake > 0)
    d = d.filter(F.size(final) > 0).withColumns({"_fav": fav, "_top": top, "_bought": bought})
    d = d.withColumns(
        {
            "total_stake": F.aggregate("_bought", F.lit(0).cast("long"), lambda a, x: a + x.stake.cast("long")),
            "trifecta_actual": F.concat_ws("-", "first", "second", "third"),
        }
    )
    d = d.withColumn("payout", payout(F.col("trifecta_payout_per_100"), hit_stake(F.col("_tickets"), F.col("trifecta_actual"))))
    return d.select(
        *[c for c in ("saved_at", "race_date", "venue", "race_no") if c in d.columns],
        "race_key",
        F.col("first").alias("first_actual"),
        F.col("second").alias("second_actual"),
        F.col("third").alias("third_actual"),
        "trifecta_actual",
        F.col("_fav.lane").alias("p1_lane"),
        F.coalesce("_fav.p", F.lit(0.0)).alias("p1_prob"),
        F.coalesce("_top.combo", F.lit("")).alias("top_ticket"),
        F.coalesce("_top.prob", F.lit(0.0)).alias("top_ticket_prob"),
        F.col("_top.odds").alias("top_ticket_odds"),
        F.coalesce("_top.stake", F.lit(0)).alias("top_ticket_stake"),
        "total_stake",
        "payout",
        (F.col("payout") - F.col("total_stake")).alias("profit"),
        F.when(F.col("total_stake") > 0, F.col("payout") / F.col("total_stake")).alias("roi"),
        (F.col("trifecta_actual") == F.coalesce("_top.combo", F.lit(""))).alias("hit_top_ticket"),
        F.exists("_bought", lambda x: F.trim(x.combo) == F.col("trifecta_actual")).alias("hit_any_ticket"),
        (F.col("first") == F.col("_fav.lane")).alias("predicted_first_hit"),
        F.to_json("_tickets").alias("tickets_json"),
        F.to_json("payload.final").alias("lane_probs_json"),
    )


def payouts(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Total stake, stake on the winning ticket and payout per race."""
    r = results.select("race_key", "trifecta", "trifecta_payout_per_100")
    hit = (F.col("combo") == F.col("trifecta")) & (F.col("stake") > 0)
    d = tickets.join(r, "race_key").groupBy("race_key").agg(
        F.sum(F.when(F.col("stake") > 0, F.col("stake")).otherwise(0)).alias("total_stake"),
        F.sum(F.when(hit, F.col("stake")).otherwise(0)).alias("hit_stake"),
        F.max("trifecta_payout_per_100").alias("per_100"),
    )
    return d.select("race_key", "total_stake", "hit_stake", payout(F.col("per_100"), F.col("hit_stake")).alias("payout"))


def measures() -> list[Column]:
    """Hit rates, money and Brier score of result rows."""
    rate = lambda c: F.avg(F.coalesce(truthy(F.col(c)), F.lit(False)).cast("double"))
    stake, paid = F.coalesce(F.sum("total_stake"), F.lit(0)), F.coalesce(F.sum("payout"), F.lit(0))
    y = F.coalesce(truthy(F.col("predicted_first_hit")), F.lit(False)).cast("double")
    p = number(F.col("p1_prob"))
    return [
        F.count(F.lit(1)).alias("races"),
        rate("predicted_first_hit").alias("first_hit_rate"),
        rate("hit_any_ticket").alias("ticket_hit_rate"),
        rate("hit_top_ticket").alias("top_ticket_hit_rate"),
        stake.alias("total_stake"),
        paid.alias("total_payout"),
        (paid - stake).alias("profit"),
        F.when(stake > 0, paid / stake).alias("roi"),
        F.avg(F.pow(p - y, F.lit(2))).alias("brier_first"),
    ]


def metrics(results: DataFrame) -> DataFrame:
    return results.agg(*measures())


def band(p: Column) -> Column:
    """Label of the left-closed probability band; NULL outside all bands."""
    conds = [((p >= lo) & (p < hi), label) for label, lo, hi in K.PROB_BANDS]
    return reduce(lambda acc, c: acc.when(c[0], c[1]), conds[1:], F.when(conds[0][0], conds[0][1]))


def calibration(results: DataFrame) -> DataFrame:
    """Predicted against actual share per band in percent, empty bands included."""
    spark = results.sparkSession
    bands = spark.createDataFrame([(i, label) for i, (label, _, _) in enumerate(K.PROB_BANDS)], "band_no INT, band STRING")
    hit = F.coalesce(truthy(F.col("predicted_first_hit")), F.lit(False)).cast("double")
    p = number(F.col("p1_prob"))
    seen = results.select(p.alias("p"), hit.alias("hit"), band(p).alias("band")).groupBy("band").agg(
        F.count("hit").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("mean_hit")
    )
    return bands.join(seen, "band", "left").select(
        "band_no",
        "band",
        F.coalesce("n", F.lit(0)).alias("races"),
        F.bround(F.col("mean_p") * 100, 1).alias("mean_predicted"),
        F.bround(F.col("mean_hit") * 100, 1).alias("actual_rate"),
    )


def ablation(rows: DataFrame) -> DataFrame:
    """Per variant: races, favourite hit rate, Brier score over six lanes, mean winner probability.

    ``rows`` carries ``research`` (variant to lanes) and ``first_actual``. The last entry of a
    lane counts; variants with fewer than two lanes do not.
    """
    d = rows.filter("first_actual IS NOT NULL").select("first_actual", F.explode("research").alias("variant", "lanes"))
    lane = lambda i: F.try_element_at(
        F.filter("lanes", lambda x: (x.lane == i) & finite(x.p_first).isNotNull()), F.lit(-1)
    ).getField("p_first")
    d = d.select("variant", "first_actual", *[lane(i).alias(f"p{i}") for i in range(1, 7)])
    ps = [F.col(f"p{i}") for i in range(1, 7)]
    known = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in ps])
    best = F.greatest(*ps)
    top = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(i)) for i in range(1, 7)])
    won = lambda i: (F.col("first_actual") == i).cast("double")
    brier = reduce(
        lambda a, b: a + b, [F.pow(F.coalesce(F.col(f"p{i}"), F.lit(0.0)) - won(i), F.lit(2)) for i in range(1, 7)]
    ) / 6
    actual = F.try_element_at(F.array(*ps), F.col("first_actual").cast("int"))
    return d.filter(known >= 2).groupBy("variant").agg(
        F.count(F.lit(1)).alias("races"),
        F.avg((top == F.col("first_actual")).cast("double")).alias("hit_rate"),
        F.avg(brier).alias("brier"),
        F.avg(actual).alias("winner_probability"),
    )


def performance(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*measures())


def ev_band(ev: Column) -> Column:
    """Bands at the edges of the stake tiers."""
    edges = [0.40, 0.65, 1.00, 1.30, 1.80, 2.50]
    out = F.when(ev.isNull(), "missing").when(ev < edges[0], f"<{edges[0]:.2f}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(ev < hi, f"{lo:.2f}-{hi:.2f}")
    return out.otherwise(f">={edges[-1]:.2f}")


def ticket_performance(tickets: DataFrame, results: DataFrame, by: Column, name: str) -> DataFrame:
    """Money and hits of purchased tickets per group of ``by``."""
    r = results.select("race_key", "trifecta", "trifecta_payout_per_100")
    hit = F.col("combo") == F.col("trifecta")
    won = F.when(hit, payout(F.col("trifecta_payout_per_100"), F.col("stake"))).otherwise(0)
    return (
        tickets.filter("stake > 0")
        .join(r, "race_key")
        .groupBy(by.alias(name))
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.count_if(hit).alias("hits"),
            F.sum("stake").alias("total_stake"),
            F.sum(won).alias("total_payout"),
            F.try_divide(F.sum(won), F.sum("stake")).alias("roi"),
        )
    )


def actual_ranks(lanes: DataFrame) -> DataFrame:
    """Finishing place of each lane in the actual combination, missing beyond third."""
    place = F.array_position(F.split("trifecta", "-"), F.col("lane").cast("string"))
    return lanes.withColumn("actual_rank", F.nullif(place, F.lit(0)))


def any_hit(results: DataFrame, tickets: DataFrame) -> DataFrame:
    """Races in which a purchased ticket hit."""
    bought = tickets.filter("stake > 0").select("race_key", F.col("combo").alias("trifecta"))
    return results.join(bought, ["race_key", "trifecta"], "left_semi")


def lanes_of_document(doc: Column) -> Column:
    """Lane rows of a stored document in its old list form or its new object form."""
    return documents.lanes(documents.opened(doc))
