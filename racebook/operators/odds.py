"""Odds time series: roll-up, bars, movements, sessions and retention.

Every operator reduces the raw samples with map-side combined aggregates before anything is
grouped by race, so a race that holds most of the samples never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racebook.functions.scalars import epoch_micros, from_epoch
from racebook.operators.joins import first_per_key, salted_join

KEY = ["race_key", "combo"]


def sample_order(tie: str | None) -> Column:
    """Order of samples: their time, then ``tie`` (a long), or the time alone.

    Both are packed into one number: time in microseconds times 2 to the 64, plus the tie. A
    buffer of it has a fixed width, so Spark aggregates by hash, which a struct would not allow.
    """
    if tie is None:
        return F.col("fetched_at")
    micros = epoch_micros(F.col("fetched_at")).cast("decimal(18,0)")
    return (micros * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(tie).cast("decimal(19,0)")


def valid_odds(samples: DataFrame) -> DataFrame:
    """Samples with a combination and a finite price of at least 1."""
    odds = F.col("odds")
    return samples.filter(
        (F.trim("combo") != "") & (odds >= 1) & ~F.isnan(odds) & (odds != float("inf"))
    )


def summarise_series(samples: DataFrame, tie: str | None = "arrival") -> DataFrame:
    """First, last, extreme values and times per (race, combination)."""
    order = sample_order(tie)
    return samples.groupBy(*KEY).agg(
        F.min_by("odds", order).alias("odds_at_lock"),
        F.max_by("odds", order).alias("odds_final"),
        F.min("odds").alias("odds_min"),
        F.max("odds").alias("odds_max"),
        F.count("odds").alias("n_samples"),
        F.min("fetched_at").alias("first_at"),
        F.max("fetched_at").alias("last_at"),
    )


def target_combos(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Combinations worth keeping: all proposed ones, and the actual one even if not proposed."""
    proposed = tickets.select(
        *KEY,
        (F.col("stake") > 0).alias("was_purchased"),
        "stake",
        "ticket_group",
        "ai_prob",
        F.lit(0).alias("source"),
    )
    actual = results.filter(F.trim("actual_combo") != "").select(
        "race_key",
        F.col("actual_combo").alias("combo"),
        F.lit(False).alias("was_purchased"),
        F.lit(0).alias("stake"),
        F.lit("").alias("ticket_group"),
        F.lit(None).cast("double").alias("ai_prob"),
        F.lit(1).alias("source"),
    )
    return first_per_key(proposed.unionByName(actual), KEY, ["source"]).drop("source")


def summary_rows(series: DataFrame, tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Summary rows of the target combinations of finished races, from one row a (race, combination)."""
    finished = results.select("race_key", "actual_combo")
    targets = target_combos(tickets, results).join(finished, "race_key")
    return series.join(targets, KEY).select(
        *KEY,
        "was_purchased",
        "stake",
        "ticket_group",
        (F.col("combo") == F.col("actual_combo")).alias("is_hit"),
        "ai_prob",
        "odds_at_lock",
        "odds_final",
        "odds_min",
        "odds_max",
        F.try_divide("odds_final", "odds_at_lock").alias("odds_drift"),
        (F.col("ai_prob") * F.col("odds_at_lock")).alias("ev_at_lock"),
        (F.col("ai_prob") * F.col("odds_final")).alias("ev_final"),
        "n_samples",
        "first_at",
        "last_at",
    )


def rollup(samples: DataFrame, tickets: DataFrame, results: DataFrame, tie: str | None = "arrival") -> DataFrame:
    """Odds summary of the target combinations of finished races."""
    return summary_rows(summarise_series(valid_odds(samples), tie), tickets, results)


def series_state(samples: DataFrame, tie: str = "arrival") -> DataFrame:
    """What has to be kept of samples so that later ones can be added: first and last price with their places in the
    order of samples, extremes, number and times."""
    order = sample_order(tie)
    return valid_odds(samples).groupBy(*KEY).agg(
        F.min(order).alias("first_order"),
        F.min_by("odds", order).alias("odds_at_lock"),
        F.max(order).alias("last_order"),
        F.max_by("odds", order).alias("odds_final"),
        F.min("odds").alias("odds_min"),
        F.max("odds").alias("odds_max"),
        F.count("odds").alias("n_samples"),
        F.min("fetched_at").alias("first_at"),
        F.max("fetched_at").alias("last_at"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per (race, combination): that of all samples together, however they were divided and in any order."""
    return states.groupBy(*KEY).agg(
        F.min("first_order").alias("first_order"),
        F.min_by("odds_at_lock", "first_order").alias("odds_at_lock"),
        F.max("last_order").alias("last_order"),
        F.max_by("odds_final", "last_order").alias("odds_final"),
        F.min("odds_min").alias("odds_min"),
        F.max("odds_max").alias("odds_max"),
        F.sum("n_samples").alias("n_samples"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def added_summaries(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Summary rows of two runs as those of one; of equal times the earlier run's price is first, the later run's last."""
    both = earlier.withColumn("_run", F.lit(0)).unionByName(later.withColumn("_run", F.lit(1)))
    facts = ["was_purchased", "stake", "ticket_group", "is_hit", "ai_prob"]
    out = both.groupBy(*KEY).agg(
        *[F.max_by(c, "_run").alias(c) for c in facts],
        F.min_by("odds_at_lock", F.struct("first_at", "_run")).alias("odds_at_lock"),
        F.max_by("odds_final", F.struct("last_at", "_run")).alias("odds_final"),
        F.min("odds_min").alias("odds_min"),
        F.max("odds_max").alias("odds_max"),
        F.sum("n_samples").alias("n_samples"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    return out.withColumns(
        {
            "odds_drift": F.try_divide("odds_final", "odds_at_lock"),
            "ev_at_lock": F.col("ai_prob") * F.col("odds_at_lock"),
            "ev_final": F.col("ai_prob") * F.col("odds_final"),
        }
    ).select(*earlier.columns)


def asof_lock(samples: DataFrame, locks: DataFrame, tie: str | None = "arrival") -> DataFrame:
    """Last odds at or before the time the prediction was frozen, beside the first sample."""
    order = sample_order(tie)
    known = F.col("fetched_at") <= F.col("saved_at")
    joined = salted_join(valid_odds(samples), locks.select("race_key", "saved_at"), "race_key", "inner", "arrival")
    return joined.groupBy(*KEY).agg(
        F.min_by("odds", order).alias("odds_at_lock"),
        F.max_by(F.when(known, F.col("odds")), F.when(known, order)).alias("odds_asof_lock"),
        F.count(F.when(known, 1)).alias("n_before_lock"),
    )


def bars(samples: DataFrame, width: str = "5 minutes", tie: str | None = "arrival") -> DataFrame:
    """Open, high, low and close per tumbling window."""
    order = sample_order(tie)
    return (
        samples.groupBy(*KEY, F.window("fetched_at", width))
        .agg(
            F.min_by("odds", order).alias("open"),
            F.max("odds").alias("high"),
            F.min("odds").alias("low"),
            F.max_by("odds", order).alias("close"),
            F.count("odds").alias("n"),
        )
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )


def sliding_change(
    samples: DataFrame, width_minutes: int = 30, slide_minutes: int = 5, tie: str | None = "arrival"
) -> DataFrame:
    """Last minus first odds over a trailing period.

    Samples first shrink to one row per slide; only those rows are repeated for the overlapping
    windows, not the raw samples.
    """
    order = sample_order(tie)
    panes = samples.groupBy(*KEY, F.window("fetched_at", f"{slide_minutes} minutes").alias("pane")).agg(
        F.min_by("odds", order).alias("first_odds"),
        F.max_by("odds", order).alias("last_odds"),
        F.count("odds").alias("n"),
    )
    back = F.sequence(F.lit(0), F.lit(width_minutes // slide_minutes - 1))
    spread = panes.withColumn("k", F.explode(back)).withColumn(
        "window_start", F.col("pane.start") - F.make_dt_interval(mins=F.col("k") * slide_minutes)
    )
    return (
        spread.groupBy(*KEY, "window_start")
        .agg(
            F.min_by("first_odds", "pane.start").alias("first_odds"),
            F.max_by("last_odds", "pane.start").alias("last_odds"),
            F.sum("n").alias("n"),
        )
        .withColumn("change", F.col("last_odds") - F.col("first_odds"))
    )


def gap_groups(df: DataFrame, key: str, position: Column, gap: float) -> DataFrame:
    """Islands of positions whose neighbours are at most ``gap`` apart.

    Two positions inside one cell of width ``gap`` are always less than ``gap`` apart, so a
    cell never spans two islands. Rows first combine to one row per cell (map-side), and only
    cells are ordered per key: their number depends on the covered range, not on the rows.
    """
    cells = (
        df.select(key, position.cast("double").alias("x"))
        .groupBy(key, F.floor(F.col("x") / gap).alias("cell"))
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    )
    w = Window.partitionBy(key).orderBy("cell")
    opens = F.col("lo") - F.lag("hi").over(w) > gap
    marked = cells.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int"))
    numbered = marked.withColumn("island", F.sum("opens").over(w))
    return numbered.groupBy(key, "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    )


def sessions(samples: DataFrame, minutes: int = 30) -> DataFrame:
    """Runs of samples of one race without a gap longer than ``minutes``."""
    islands = gap_groups(samples, "race_key", epoch_micros(F.col("fetched_at")), minutes * 60_000_000)
    at = lambda c: from_epoch(F.col(c).cast("long"))
    return islands.select("race_key", at("lo").alias("started_at"), at("hi").alias("ended_at"), "n")


def timepoints(samples: DataFrame) -> DataFrame:
    return samples.groupBy("race_key").agg(F.countDistinct("fetched_at").alias("timepoints"))


def movements(samples: DataFrame, top: int = 5) -> DataFrame:
    """Biggest drops per race between its first and last sample time.

    Duplicates of one time are averaged; a combination without a price at either end is not ranked.
    """
    per_time = samples.groupBy(*KEY, "fetched_at").agg(F.avg("odds").alias("odds"))
    ends = per_time.groupBy(*KEY).agg(
        F.min("fetched_at").alias("first_at"),
        F.max("fetched_at").alias("last_at"),
        F.min_by("odds", "fetched_at").alias("first_odds"),
        F.max_by("odds", "fetched_at").alias("last_odds"),
    )
    w = Window.partitionBy("race_key")
    change = F.when(
        (F.col("first_at") == F.min("first_at").over(w)) & (F.col("last_at") == F.max("last_at").over(w)),
        F.col("last_odds") - F.col("first_odds"),
    )
    ranked = ends.select(*KEY, change.alias("change")).withColumn(
        "place", F.row_number().over(w.orderBy(F.col("change").asc_nulls_last(), "combo"))
    )
    return ranked.filter(F.col("place") <= top)


def wide_series(samples: DataFrame, combos: list[str]) -> DataFrame:
    """Time by combination, mean price per cell."""
    return samples.groupBy("race_key", "fetched_at").pivot("combo", combos).agg(F.avg("odds"))


def retention_candidates(samples: DataFrame, as_of: str, days: int = 7, limit: int | None = None) -> DataFrame:
    """Race days older than the retention period; ``limit`` bounds one run, oldest first."""
    day = F.col("fetched_at").cast("date")
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    old = samples.filter(day < cutoff).select("race_key", day.alias("race_date")).distinct()
    return old if limit is None else old.orderBy("race_date", "race_key").limit(limit)


def tracked_races(samples: DataFrame) -> DataFrame:
    return samples.select("race_key").distinct()


def older(samples: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Samples of days before the retention period; the condition on the time reaches the scan."""
    return samples.filter(F.col("fetched_at") < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))


def prune(samples: DataFrame, processed: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Raw samples without those older than the retention period of races whose summary is stored."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    done = processed.select("race_key").distinct().withColumn("_done", F.lit(True))
    known = salted_join(samples, done, "race_key", "left", "arrival")
    return known.filter(F.col("_done").isNull() | (F.col("fetched_at") >= cutoff) | F.col("fetched_at").isNull()).drop("_done")


def outdated_races(samples: DataFrame, results: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Finished races whose newest sample is older than the retention period."""
    newest = samples.groupBy("race_key").agg(F.max("fetched_at").alias("newest"))
    return older(newest.withColumnRenamed("newest", "fetched_at"), as_of, days).select("race_key").join(
        results.select("race_key"), "race_key", "left_semi"
    )


def of_races(samples: DataFrame, races: DataFrame) -> DataFrame:
    """All samples of the given races that have a time."""
    return salted_join(samples.filter(F.col("fetched_at").isNotNull()), races, "race_key", "left_semi", "arrival")


def without_races(samples: DataFrame, races: DataFrame) -> DataFrame:
    """Samples of all other races."""
    return salted_join(samples, races, "race_key", "left_anti", "arrival")


def late_samples(samples: DataFrame, watch: DataFrame) -> DataFrame:
    """Per race the samples stored (before the deadline) and refused (at or after it)."""
    joined = salted_join(valid_odds(samples), watch.select("race_key", "deadline"), "race_key", "inner", "arrival")
    late = F.col("fetched_at") >= F.col("deadline")
    return joined.groupBy("race_key").agg(
        F.count(F.when(~late, 1)).alias("stored"), F.count(F.when(late, 1)).alias("refused")
    )


def race_state(watch: DataFrame, as_of: str) -> DataFrame:
    """Tracking state of each watched race at ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    due = F.col("deadline").isNotNull() & (now >= F.col("deadline"))
    return watch.withColumn(
        "state",
        F.when(due & (F.col("has_result") | ~F.col("has_snapshot")), "DONE")
        .when(due & (now >= F.col("deadline") + minutes(120)), "TIMEOUT")
        .when(due, "WAIT_RESULT")
        .when(F.col("deadline").isNull() & (now > F.col("created_at") + minutes(180)), "TIMEOUT")
        .otherwise("ACTIVE"),
    )


def within_wait(snapshots: DataFrame, results: DataFrame, minutes: int = 120) -> DataFrame:
    """Frozen predictions with the result that arrived within the bounded wait."""
    upper = F.col("saved_at") + F.make_dt_interval(mins=F.lit(minutes))
    return snapshots.join(results, "race_key").filter(
        (F.col("result_ts") >= F.col("saved_at")) & (F.col("result_ts") <= upper)
    )
