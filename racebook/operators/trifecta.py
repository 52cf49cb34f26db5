"""Ordered first-three probabilities and the place priors learned from history."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racebook import constants as K

LANES = range(1, 7)
#: Races that one task expands at most, on average: 2.4 million outcomes, some 300 MB where they are sorted.
TASK_RACES = 20_000


def triples() -> Column:
    """The 120 ordered triples of six lanes as one literal array."""
    rows = ", ".join(
        f"named_struct('a', {a}, 'b', {b}, 'c', {c}, 'combo', '{a}-{b}-{c}', 'second_prior', {K.SECOND_PRIOR[a][b]}D)"
        for a, b, c in permutations(LANES, 3)
    )
    return F.expr(f"array({rows})")


def total(terms) -> Column:
    terms = list(terms)
    return sum(terms[1:], terms[0])


def spread(races: DataFrame, finer: int = 4, most: int = 0) -> DataFrame:
    """Races over more partitions than a plain shuffle has, before each becomes up to 120 rows.

    The rows that are shuffled here are few and small. Left to the sizes before the expansion,
    adaptive execution would merge them into few tasks, each of which would then have to hold
    120 times its input; a fixed number of finer partitions stays as it is. Where the caller knows
    that there are ``most`` races at most, the number grows with them and the size of a task does not.
    """
    n = finer * int(races.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return races.repartition(max(n, math.ceil(most / TASK_RACES)), "race_key")


def race_fields(first: DataFrame) -> DataFrame:
    """One row per race with at least three runners: ``p1``..``p6``, missing lanes NULL."""
    p = F.col("p_first")
    usable = F.col("lane").between(1, 6) & p.isNotNull() & ~F.isnan(p)
    wide = first.filter(usable).groupBy("race_key").agg(
        *[F.max(F.when(F.col("lane") == i, p)).alias(f"p{i}") for i in LANES]
    )
    runners = total(F.col(f"p{i}").isNotNull().cast("int") for i in LANES)
    return wide.withColumn("runners", runners).filter(F.col("runners") >= 3)


def ordered_triples(first: DataFrame) -> DataFrame:
    """Every ordered choice of three runners of a race."""
    here = F.array(*[F.col(f"p{i}").isNotNull() for i in LANES])
    f = spread(race_fields(first).select("race_key", here.alias("here"))).withColumn("t", F.explode(triples()))
    present = F.element_at("here", F.col("t.a")) & F.element_at("here", F.col("t.b")) & F.element_at("here", F.col("t.c"))
    return f.filter(present).select("race_key", "t.a", "t.b", "t.c", "t.combo")


def trifecta(
    first: DataFrame,
    gamma_b: float = K.GAMMA_SECOND,
    gamma_c: float = K.GAMMA_THIRD,
    course_weight: float = K.SECOND_PRIOR_WEIGHT,
    course_weight_3rd: float = K.THIRD_PRIOR_WEIGHT,
    most: int = 0,
) -> DataFrame:
    """Probability of each ordered triple; ``most`` bounds the races, for ``spread``.

    Win probability, then discounted conditionals blended with the place priors. Everything a
    race needs is computed once on its single row, the normaliser included: summed over the
    third place the blend is ``(1-w3) + w3 * (third priors used)`` for any first two, and over
    the second ``(1-w2) + w2 * (second priors of the runners)``. So the 120 rows of a race need
    neither a join nor a window, and only the shuffle by race remains.
    """
    w2, w3 = float(course_weight), float(course_weight_3rd)
    plus = " + ".join

    def second_total(a: int) -> str:
        used = plus(f"if(p{b} IS NULL, 0D, {K.SECOND_PRIOR[a][b]}D)" for b in LANES if b != a)
        return f"({1 - w2}D + {w2}D * ({used}))"

    third_total = plus(f"if(runners >= {r + 2}, {v}D, 0D)" for r, v in K.THIRD_PRIOR.items())
    below = ", ".join(plus(["0"] + [f"int(p{j} IS NOT NULL)" for j in LANES if j < i]) for i in LANES)
    races = race_fields(first).selectExpr(
        "race_key",
        "array(" + ", ".join(f"p{i}" for i in LANES) + ") AS p",
        "array(" + ", ".join(f"coalesce(pow(p{i}, {gamma_b}D), 0D)" for i in LANES) + ") AS pb",
        "array(" + ", ".join(f"coalesce(pow(p{i}, {gamma_c}D), 0D)" for i in LANES) + ") AS pc",
        f"array({below}) AS below",
        f"({plus(f'coalesce(p{a}, 0D) * {second_total(a)}' for a in LANES)}) * ({1 - w3}D + {w3}D * ({third_total})) AS norm",
    )
    rows = spread(races, most=most).withColumn("t", F.explode(triples())).selectExpr("*", "t.*")
    rows = rows.filter("p[a - 1] IS NOT NULL AND p[b - 1] IS NOT NULL AND p[c - 1] IS NOT NULL")
    others_b = plus(f"if(a = {i}, 0D, pb[{i - 1}])" for i in LANES)
    others_c = plus(f"if(a = {i} OR b = {i}, 0D, pc[{i - 1}])" for i in LANES)
    place = "below[c - 1] - int(a < c) - int(b < c)"
    third_prior = "array(" + ", ".join(f"{v}D" for v in K.THIRD_PRIOR.values()) + ")"
    second = f"({1 - w2}D * try_divide(pb[b - 1], {others_b}) + {w2}D * second_prior)"
    third = f"({1 - w3}D * try_divide(pc[c - 1], {others_c}) + {w3}D * {third_prior}[{place}])"
    return rows.selectExpr(
        "race_key", "a", "b", "c", "combo", f"coalesce(try_divide(p[a - 1] * {second} * {third}, norm), 0D) AS prob"
    )


def podiums(history: DataFrame) -> DataFrame:
    """First, second and third lane per race, with the lanes that ran."""
    lane = lambda k: F.max(F.when(F.col("finish") == k, F.col("lane"))).alias(f"f{k}")
    return history.groupBy("race_key").agg(lane(1), lane(2), lane(3), F.sort_array(F.collect_set("lane")).alias("lanes"))


def second_place_prior(history: DataFrame) -> DataFrame:
    """Share of each second lane given the winner."""
    pairs = podiums(history).filter("f1 IS NOT NULL AND f2 IS NOT NULL").groupBy("f1", "f2").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("f1"))
    return pairs.select(F.col("f1").alias("a"), F.col("f2").alias("b"), "n", share.alias("p"))


def third_place_prior(history: DataFrame) -> DataFrame:
    """Share of each rank of the third lane among the lanes left after the first two."""
    p = podiums(history).filter("f3 IS NOT NULL")
    left = F.array_except("lanes", F.array("f1", "f2"))
    counts = p.groupBy(F.array_position(left, F.col("f3")).alias("place")).agg(F.count("*").alias("n"))
    # at most four places are left to share
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("place", "n", share.alias("p"))
