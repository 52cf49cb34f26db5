"""Ranks inside a race.

A race has at most six entrants, so the values of a race fit in a small array. One unordered
window per race collects them for every feature at once: a single sort on the race key serves
all features, where ordered windows would need one sort per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACE = "race_key"


def race_window(*more: str):
    return Window.partitionBy(RACE, *more)


def whole(window):
    """The whole group, in the order of ``window``: such sums and counts share its window step."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_race_values(df: DataFrame, cols: list[str], key: tuple[str, ...] = (RACE,)) -> DataFrame:
    """Add ``_v_<col>``: the sorted non-null values of the race, for each of ``cols``."""
    w = Window.partitionBy(*key)
    lists = df.select("*", *[F.collect_list(c).over(w).alias(f"_v_{c}") for c in cols])
    return lists.withColumns({f"_v_{c}": F.sort_array(f"_v_{c}") for c in cols})


def valid_count(col: str) -> Column:
    return F.size(f"_v_{col}")


def lower_better(col: str) -> Column:
    """Centred average rank in [-1, 1]; 0 where missing or with fewer than two values.

    With k-th smallest position ``up`` and k-th largest position ``down`` (ties share the first
    position of each order) the centred average rank is ``(down - up) / (n - 1)``.
    """
    vals = F.col(f"_v_{col}")
    up = F.array_position(vals, F.col(col))
    down = F.array_position(F.reverse(vals), F.col(col))
    n = F.size(vals)
    return F.when((n >= 2) & F.col(col).isNotNull(), (down - up) / (n - 1)).otherwise(0.0)


def higher_better(col: str) -> Column:
    return -lower_better(col)


def gated(col: str, minimum: int) -> Column:
    """``lower_better`` that counts only when the race has enough valid values."""
    return F.when(valid_count(col) >= minimum, lower_better(col)).otherwise(0.0)


def average_rank(value: Column, partition) -> tuple[Column, Column]:
    """(average rank over non-null values, their count) for wide groups.

    Ties hold the places from ``rank`` up to the number of values not above them; both and the
    count follow from one ordering, hence one sort and one window step per value.
    """
    ordered = partition.orderBy(value.asc_nulls_last())
    up_to = F.count(value).over(ordered)
    return (F.rank().over(ordered) + up_to) / 2, F.count(value).over(whole(ordered))


def percent_rank_average(value: Column, partition) -> Column:
    """Average rank divided by the number of values, 0 for missing ones."""
    rank, n = average_rank(value, partition)
    return F.when(value.isNotNull(), rank / n).otherwise(0.0)


def normalise(value: Column, partition) -> Column:
    """Share of the group total; uniform when the total is not positive."""
    total = F.sum(value).over(partition)
    return F.when(total > 0, value / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(partition))
