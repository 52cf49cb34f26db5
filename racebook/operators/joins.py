"""Joins, look-ups and de-duplication on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.scalars import nfkc

SALTS = 16


def salted_join(
    rows: DataFrame, keyed: DataFrame, key: str | list[str], how: str, salt_on: str, salts: int = SALTS
) -> DataFrame:
    """Join many ``rows`` to a table with at most one row per ``key``.

    A single key may hold a large part of ``rows``. The rows of a key spread over ``salts`` tasks
    by a hash of ``salt_on`` and the keyed side is repeated once per salt; results are those of
    the plain join. When the keyed side is small Spark broadcasts it and nothing is shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    left = rows.withColumn("_salt", F.pmod(F.hash(salt_on), F.lit(salts)))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key: the first in ``order``.

    ``min_by`` combines on the map side, so a key with very many rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key: the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def blank_to(a: Column, b: Column) -> Column:
    """``a`` unless it is missing or blank, else ``b``."""
    return F.coalesce(F.nullif(F.trim(a), F.lit("")), b)


def compact_name(name: Column) -> Column:
    """Name without any white space, including the full-width space."""
    return F.regexp_replace(name, r"[\s　]+", "")


def name_key(name: Column) -> Column:
    """Name as a join key: full-width, half-width and composed forms folded to one, without white space."""
    return compact_name(nfkc(name))


def race_card(entries: DataFrame, meet: DataFrame, course: DataFrame, own: DataFrame, profile: DataFrame) -> DataFrame:
    """Race card with current-meet, own-exhibition, course and venue columns, all optional.

    A lane starts from the course of its number, so course rows join on the lane. One racer may
    be in very many races: nothing after that join needs its partitioning, so adaptive execution
    is free to split such a racer. The venue profile holds at most six rows for each of the known
    venues and can be broadcast.
    """
    codes = [f"{i:02d}" for i in range(1, len(K.VENUES) + 1)]
    by_course = course.withColumnRenamed("course", "lane")
    by_venue = profile.withColumnRenamed("course", "lane").filter(F.col("venue").isin(codes) & F.col("lane").between(1, 6))
    card = entries.join(meet, ["race_key", "lane"], "left").join(own, ["race_key", "lane"], "left")
    card = card.join(by_course, ["racer_id", "lane"], "left")
    return card.join(F.broadcast(by_venue), ["venue", "lane"], "left")


def fill_defaults(dim: DataFrame, facts: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every row of the dimension, with defaults where there is no fact."""
    return dim.join(facts, key, "left").na.fill(defaults)


def comments_by_name(racers: DataFrame, comments: DataFrame, order: str) -> DataFrame:
    """Racers with the first comment entered under their name, white space and forms of signs aside.

    Comments first shrink to one per spelling, so the folding reads each spelling once and not every entry.
    """
    spelled = comments.groupBy("name").agg(F.min_by("comment", order).alias("comment"), F.min(order).alias("_order"))
    first = spelled.groupBy(name_key(F.col("name")).alias("_name")).agg(F.min_by("comment", "_order").alias("comment"))
    keyed = racers.withColumn("_name", name_key(F.col("racer_name")))
    return keyed.join(first, "_name", "left").drop("_name")


def race_card_outer(card: DataFrame, before: DataFrame) -> DataFrame:
    """Card and pre-race rows side by side; a blank card name is filled from the other side."""
    c, b = card.alias("c"), before.alias("b")
    on = (F.col("c.race_key") == F.col("b.race_key")) & (F.col("c.lane") == F.col("b.lane"))
    return c.join(b, on, "full").select(
        F.coalesce("c.race_key", "b.race_key").alias("race_key"),
        F.coalesce("c.lane", "b.lane").alias("lane"),
        blank_to(F.col("c.racer_name"), F.col("b.racer_name_beforeinfo")).alias("racer_name"),
        F.col("c.racer_win_rate"),
        F.col("b.exhibition_time"),
    )


def latest_odds(odds: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One odds value per key; later samples replace earlier ones."""
    return odds.groupBy(*keys).agg(F.max_by("odds", F.struct(*order)).alias("odds"))


def crosscheck(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Same fact from two sources; rows on which they disagree are marked for quarantine."""
    x, y = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))
    return x.join(y, key, "full").withColumn(
        "verdict",
        F.when(F.col("value_a") == F.col("value_b"), "agree")
        .when(F.col("value_a").isNull() | F.col("value_b").isNull(), "single source")
        .otherwise("quarantine"),
    )


def fill_by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Per key the non-blank value of the earliest source that has one."""
    tagged = [
        s.select(key, F.nullif(F.trim(F.col(value)), F.lit("")).alias(value), F.lit(i).alias("priority"))
        for i, s in enumerate(sources)
    ]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    present = F.col(value).isNotNull()
    return rows.groupBy(key).agg(
        F.min_by(F.when(present, F.col(value)), F.when(present, F.struct("priority", value))).alias(value),
        F.min(F.when(present, F.col("priority"))).alias("priority"),
    )
