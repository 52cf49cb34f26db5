"""Chat logs with cumulative snapshots, collapsed and rendered. DataFrame functions only.

A service that logs a conversation after every answer stores each conversation many times, each log a prefix of
the next. A prefix is known by its number of turns and by two sums, over its turns, of 64-bit hashes of turn
number, role and text with different seeds: sums roll from turn to turn, and combine in aggregates and windows.
A conversation whose sums equal those of a shorter prefix of another one goes (anti-join); of equal
conversations the smallest id stays. Prefixes are reduced to distinct ones before they meet, so a first turn
that many conversations share counts once.

A long conversation is never one group: turns are summed by (conversation, turn), then by stretches of turns,
and only the sums of stretches run in one window per conversation. The rendered text comes in parts of ``PART``
rows. A row's place is the rows of earlier turns, from the same sums, and its rank in its turn. Of a turn with more
than ``PART`` rows the rows are ranked by cell, the start of a digest of role and text, then by role and text, so
that such a turn is sorted in as many pieces as there are cells and only counts of cells meet in one window.

A row that repeats another in all four columns counts once. Several texts at one turn stand in the order of role
and text, of a crowded turn in the order of cells first. A null turn comes first; a null role is written ``unknown``, a null text is empty, yet both differ from
their written forms as far as equality goes. Rows with a null id form a conversation of their own. A turn of
any length is one piece of text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racebook.llm.common import stored

#: Turns of a stretch whose sums are taken together; rows of a rendered part.
STRETCH, PART = 256, 64
#: Digits of a digest that name a cell: a crowded turn has 65,536 cells at most.
DIGITS = 4
#: Turn numbers of rows without one, below all others.
NO_TURN = -(1 << 62)


def _sums(prefix: str = "") -> list[str]:
    return [f"{prefix}n", f"{prefix}h1", f"{prefix}h2"]


def _turns(logs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    picked = logs.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return picked.distinct()


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, its rows, the sums over all turns up to it and the rows of the whole conversation (last_n)."""

    def hashed(seed: int) -> Column:
        parts = [F.lit(seed), F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
        return F.xxhash64(*parts).cast("decimal(20,0)")

    stretch = F.floor(F.col("turn") / STRETCH)
    each = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(hashed(1)).cast("decimal(38,0)").alias("h1"), F.sum(hashed(2)).cast("decimal(38,0)").alias("h2")).withColumn("stretch", stretch)
    totals = each.groupBy("conv_id", "stretch").agg(*[F.sum(c).cast("decimal(38,0)").alias(f"t_{c}") for c in _sums()])
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("conv_id").alias("b_conv"), F.col("stretch").alias("b_stretch"), F.sum("t_n").over(whole).cast("decimal(38,0)").alias("last_n"), *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b_{c}") for c in _sums()])
    upto = Window.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inside = each.select("conv_id", "turn", "stretch", F.col("n").alias("rows"), *[F.sum(c).over(upto).cast("decimal(38,0)").alias(f"i_{c}") for c in _sums()])
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("stretch") == F.col("b_stretch"))
    return inside.join(base, same).select("conv_id", "turn", "rows", "last_n", *[(F.col(f"i_{c}") + F.col(f"b_{c}")).cast("decimal(38,0)").alias(c) for c in _sums()])


def _collapsed(marks: DataFrame) -> DataFrame:
    whole = marks.where("n = last_n").groupBy(*_sums()).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    shorter = marks.where("n < last_n").select(*[F.col(c).alias(f"s_{c}") for c in _sums()]).distinct()
    alike = [F.col(c) == F.col(f"s_{c}") for c in _sums()]
    return whole.join(shorter, alike, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies")


def maximal(logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns (distinct rows) and copies (equal conversations) of those that are no shorter prefix of another."""
    return _collapsed(stored(prefixes(_turns(logs, conv, turn, role, text)), "chat-marks"))


def render(logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv_id, part, n_turns, copies and the rendered text of every maximal conversation, in parts of ``part`` rows."""
    words = F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = stored(_turns(logs, conv, turn, role, text).withColumn("cell", F.substring(F.md5(words), 1, DIGITS)), "chat-turns")
    marks = stored(prefixes(turns), "chat-marks")
    kept = _collapsed(marks).withColumnRenamed("conv_id", "kept_conv")
    begins = marks.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_conv")))
    begins = begins.select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn"), (F.col("n") - F.col("rows")).cast("long").alias("begin"), (F.col("rows") > part).alias("crowded"), "n_turns", "copies")
    cells = turns.groupBy("conv_id", "turn", "cell").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(begins, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("turn") == F.col("t_turn")))
    lower = F.sum("m").over(Window.partitionBy("t_conv", "t_turn").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.col("begin") + F.when(F.col("crowded"), F.coalesce(lower, F.lit(0))).otherwise(0)
    cells = cells.select("t_conv", "t_turn", F.col("cell").alias("t_cell"), begin.alias("begin"), "crowded", "n_turns", "copies")
    same = F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("turn") == F.col("t_turn")) & (F.col("cell") == F.col("t_cell"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn", F.when(F.col("crowded"), F.col("cell"))).orderBy("role", "text"))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    placed = turns.join(cells, same).select("conv_id", "n_turns", "copies", (F.col("begin") + rank - 1).alias("place"), line.alias("line"))
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / part).alias("part"), "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("items"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("items.line"), "").alias("text"))
