"""Race-relative features, the adjusted win probability and what is derived from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.ranks import (
    gated,
    higher_better,
    lower_better,
    normalise,
    race_window,
    valid_count,
    with_race_values,
)

RANKED = [
    "current_meet_avg_finish",
    "current_meet_top2_rate",
    "current_meet_avg_st",
    "course_top3_rate",
    "course_avg_st",
    "course_start_rank",
    "class_score",
    "venue_course_1st",
    "exhibition_time",
    "original_straight",
    "original_turn",
    "original_lap",
]


@dataclass(frozen=True)
class Weights:
    """How strongly each feature moves the win probability."""

    display: float = K.DISPLAY_WEIGHT
    meet: float = K.CURRENT_MEET_WEIGHT
    course: float = K.COURSE_WEIGHT
    weather: float = K.WEATHER_WEIGHT
    venue: float = K.VENUE_COURSE_WEIGHT
    klass: float = K.CLASS_WEIGHT
    original: float = 1.0


NO_WEIGHTS = Weights(0, 0, 0, 0, 0, 0, 0)
BEFORE_DISPLAY = Weights(display=0, weather=0, venue=0, original=0)
_S, _M, _C, _L = Weights(), K.CURRENT_MEET_WEIGHT, K.COURSE_WEIGHT, K.CLASS_WEIGHT
VARIANTS = dict(
    zip(
        K.VARIANTS,
        [
            NO_WEIGHTS,
            Weights(0, _M, 0, 0, 0, 0, 0),
            Weights(0, _M, _C, 0, 0, 0, 0),
            Weights(0, _M, _C, 0, 0, _L, 0),
            Weights(0, _M, _C, 0, _S.venue, _L, 0),
            Weights(_S.display, _M, _C, 0, _S.venue, _L, 1),
            Weights(),
        ],
    )
)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def class_score(racer_class: Column) -> Column:
    """Grade as a number; unknown grades are missing."""
    return F.coalesce(*[F.when(racer_class == name, F.lit(float(v))) for name, v in K.CLASS_SCORE.items()])


def with_features(card: DataFrame) -> DataFrame:
    """Add ``f_*`` features and the ranks ``z_*`` the reasons need: one shuffle, one sort."""
    w = race_window()
    base = card.withColumns(
        {
            "class_score": class_score(F.col("racer_class")),
            "_lane1_rate": F.max(F.when(F.col("lane") == 1, F.col("venue_course_1st"))).over(w),
        }
    )
    d = with_race_values(base, RANKED)
    reliability = clip(F.coalesce("current_meet_races", F.lit(0)) / K.FULL_MEET_RACES, 0.0, 1.0)
    rough = (F.coalesce("wind_speed", F.lit(0.0)) >= K.ROUGH_WIND) | (F.coalesce("wave_height", F.lit(0.0)) >= K.ROUGH_WAVE)
    attacked = (
        (F.col("_lane1_rate") < K.WEAK_INSIDE_RATE)
        & (F.coalesce("venue_kimarite_makuri", F.lit(0.0)) >= K.STRONG_ATTACK_RATE)
        & F.col("lane").isin(3, 4)
    )
    d = d.withColumns(
        {
            "reliability": reliability,
            "is_rough": rough,
            "z_meet_st": lower_better("current_meet_avg_st"),
            "z_course_st": lower_better("course_avg_st"),
        }
    )
    meet = (
        lower_better("current_meet_avg_finish") * K.MEET_PARTS[0]
        + higher_better("current_meet_top2_rate") * K.MEET_PARTS[1]
        + F.col("z_meet_st") * K.MEET_PARTS[2]
    )
    course = (
        higher_better("course_top3_rate") * K.COURSE_PARTS[0]
        + F.col("z_course_st") * K.COURSE_PARTS[1]
        + lower_better("course_start_rank") * K.COURSE_PARTS[2]
    )
    return d.withColumns(
        {
            "f_meet": meet * F.col("reliability"),
            "f_course": clip(course, -1.0, 1.0),
            "f_class": higher_better("class_score"),
            "f_venue": higher_better("venue_course_1st"),
            "f_bonus": F.when(attacked, K.ROUGH_WATER_BONUS).otherwise(0.0),
            "f_time": lower_better("exhibition_time"),
            "f_straight": gated("original_straight", K.MIN_VALID),
            "f_turn": gated("original_turn", K.MIN_VALID),
            "f_lap": gated("original_lap", K.MIN_VALID),
            "f_weather": F.when(rough, -F.greatest(F.col("lane") - 3, F.lit(0)).cast("double")).otherwise(0.0),
        }
    )


def original_score() -> Column:
    return (
        F.col("f_straight") * K.STRAIGHT_WEIGHT + F.col("f_turn") * K.TURN_WEIGHT + F.col("f_lap") * K.LAP_WEIGHT
    )


def adjustment(w: Weights | Column) -> Column:
    """Sum of weighted features; ``w`` is fixed or a struct column with the same fields.

    The attack bonus carries no weight, so it is part of every variant.
    """
    g = (lambda n: w.getField(n)) if isinstance(w, Column) else (lambda n: F.lit(float(getattr(w, n))))
    return (
        F.col("f_meet") * g("meet")
        + F.col("f_course") * g("course")
        + F.col("f_class") * g("klass")
        + F.col("f_venue") * g("venue")
        + F.col("f_bonus")
        + F.col("f_time") * g("display")
        + original_score() * g("original")
        + F.col("f_weather") * g("weather")
    )


def strength(raw: Column, adj: Column) -> Column:
    return F.greatest(raw, F.lit(1e-6)) * F.exp(adj)


def reasons() -> Column:
    """Labels of everything that moved the probability, in a fixed order."""
    c, R = F.col, K.REASON
    known = c("reliability") >= 0.34
    labels = [
        (known & (c("f_meet") >= 0.45), "meet_good"),
        (known & (c("f_meet") <= -0.45), "meet_bad"),
        ((c("reliability") >= 0.50) & (c("z_meet_st") >= 0.60), "meet_st"),
        (c("f_course") >= 0.45, "course_good"),
        (c("f_course") <= -0.45, "course_bad"),
        (c("z_course_st") >= 0.60, "course_st"),
        (c("racer_class") == "A1", "class_a1"),
        (c("racer_class") == "B2", "class_b2"),
        (c("f_venue") >= 0.55, "venue_good"),
        (c("f_venue") <= -0.55, "venue_bad"),
        (c("f_bonus") > 0, "rough_bonus"),
        (c("exhibition_st") < 0, "flying"),
        (c("f_time") > 0.55, "time_good"),
        (c("f_time") < -0.55, "time_bad"),
        (c("f_straight") > 0.65, "straight"),
        (c("f_turn") > 0.65, "turn"),
        (c("f_lap") > 0.65, "lap"),
        (c("is_rough") & (c("lane") >= 5), "rough_outer"),
    ]
    text = F.concat_ws(" / ", *[F.when(cond, F.lit(R[name])) for cond, name in labels])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(K.DEFAULT_REASON))


def win_probability(card: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adjusted probability of winning, normalised inside the race."""
    d = with_features(card).withColumn("adjustment", adjustment(weights))
    p = normalise(strength(F.col("raw_prob"), F.col("adjustment")), race_window())
    return d.select("race_key", "lane", p.alias("p_first"), "adjustment", reasons().alias("reason"))


def variants(card: DataFrame, named: dict[str, Weights] = VARIANTS) -> DataFrame:
    """One probability per (race, variant, lane); features are computed once."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), *[F.lit(float(v)).alias(k) for k, v in vars(w).items()])
            for n, w in named.items()
        ]
    )
    d = with_features(card).withColumn("v", F.explode(rows))
    s = strength(F.col("raw_prob"), adjustment(F.col("v")))
    d = d.select("race_key", F.col("v.variant").alias("variant"), "lane", s.alias("s"))
    return d.select("race_key", "variant", "lane", normalise(F.col("s"), race_window("variant")).alias("p_first"))


def probability_change(card: DataFrame) -> DataFrame:
    """Win probability before and after the exhibition, in one pass over the features."""
    d = with_features(card)
    w = race_window()
    p = lambda weights: normalise(strength(F.col("raw_prob"), adjustment(weights)), w)
    return d.select(
        "race_key", "lane", p(BEFORE_DISPLAY).alias("p_first_before"), p(Weights()).alias("p_first_after")
    ).withColumn("delta", F.col("p_first_after") - F.col("p_first_before"))


def sorted_median(col: str) -> Column:
    """Median from the sorted race values."""
    v = F.col(f"_v_{col}")
    n = F.size(v)
    mid = lambda i: F.try_element_at(v, i.cast("int"))
    return (mid(F.floor((n + 1) / 2)) + mid(F.floor(n / 2) + 1)) / 2


def favourite(p: Column) -> Column:
    """Lane with the highest probability; the lowest lane wins ties."""
    return F.max_by("lane", F.struct(p, -F.col("lane"))).over(race_window())


def favourite_risk(card: DataFrame) -> DataFrame:
    """Signals that the favourite may fail. ``card`` carries ``p_first`` beside the race columns."""
    slower = ["original_straight", "original_turn", "exhibition_time"]
    weaker = ["motor_2ren", "boat_2ren"]
    d = with_race_values(card.withColumn("favourite", favourite(F.col("p_first"))), slower + weaker)
    d = d.filter(F.col("lane") == F.col("favourite"))
    signals = {c: (valid_count(c) >= 3) & (F.col(c) > sorted_median(c)) for c in slower}
    signals |= {c: (valid_count(c) >= 3) & (F.col(c) < sorted_median(c)) for c in weaker}
    signals["current_meet_top2_rate"] = F.col("current_meet_top2_rate") < 30
    d = d.withColumns({f"s_{c}": F.coalesce(s, F.lit(False)) for c, s in signals.items()})
    score = sum((F.col(f"s_{c}").cast("int") for c in signals), F.lit(0))
    labels = [F.when(F.col("exhibition_st") < 0, F.lit(K.RISK["flying"]))]
    labels += [F.when(F.col(f"s_{c}"), F.lit(K.RISK[c])) for c in signals]
    return d.select("race_key", "favourite", score.alias("risk_score"), F.concat_ws(" / ", *labels).alias("reasons"))


CONFIDENCE_COLUMNS = ["racer_win_rate", "local_win_rate", "motor_2ren", "boat_2ren", "avg_st", "exhibition_time"]


def confidence(card: DataFrame) -> DataFrame:
    """Grade A, B or C from the lead of the favourite and the completeness of the card."""
    share = [F.avg(F.col(c).isNotNull().cast("double")) for c in CONFIDENCE_COLUMNS]
    d = card.groupBy("race_key").agg(
        F.sort_array(F.collect_list(F.coalesce("p_first", F.lit(0.0))), asc=False).alias("p"),
        (sum(share[1:], share[0]) / len(share)).alias("completeness"),
    )
    d = d.withColumn("margin", F.try_element_at("p", F.lit(1)) - F.try_element_at("p", F.lit(2)))
    score = F.col("margin") * K.CONFIDENCE_SCORE[0] + F.col("completeness") * K.CONFIDENCE_SCORE[1]
    grade = F.when(score > K.GRADE_A, "A").when(score > K.GRADE_B, "B").otherwise("C")
    return d.select("race_key", "margin", "completeness", grade.alias("grade"))


def completeness(card: DataFrame, field: int = 6) -> DataFrame:
    """Non-missing counts per column and the labels of those below a full field."""
    d = card.groupBy("race_key").agg(*[F.count(c).alias(f"n_{c}") for c in K.COMPLETENESS])
    notes = [
        F.when(F.col(f"n_{c}") < field, F.concat(F.lit(label + "("), F.col(f"n_{c}"), F.lit(f"/{field})")))
        for c, label in K.COMPLETENESS.items()
    ]
    return d.withColumn("missing", F.concat_ws(" / ", *notes))


def start_time(text: Column) -> Column:
    """``.14`` is 0.14, ``F.03`` is -0.03; anything else is missing."""
    s = F.regexp_replace(text, r"\s+", "")
    digits = F.regexp_extract(s, r"^F*(?:0?\.)?(\d{1,2})$", 1)
    value = F.concat(F.lit("0."), F.lpad(digits, 2, "0")).try_cast("double")
    return F.when(digits != "", F.when(s.startswith("F"), -value).otherwise(value))


def current_meet(starts: DataFrame) -> DataFrame:
    """Averages over the starts of the meet; only finishes 1 to 6 enter the finish averages."""
    d = starts.select(
        "race_key",
        "lane",
        start_time(F.col("st")).alias("st"),
        F.when(F.col("finish").rlike("^[1-6]$"), F.col("finish").try_cast("int")).alias("finish"),
        F.col("course").rlike("^[1-6]$").alias("placed"),
    ).filter(F.col("placed") & F.col("st").isNotNull())
    return d.groupBy("race_key", "lane").agg(
        F.avg("finish").alias("current_meet_avg_finish"),
        (F.avg((F.col("finish") <= 2).cast("int")) * 100).alias("current_meet_top2_rate"),
        F.avg("st").alias("current_meet_avg_st"),
        F.count("st").alias("current_meet_races"),
    )


def plausible(card: DataFrame) -> DataFrame:
    """Values outside their plausible range become missing."""
    c = F.col
    inside = lambda name, lo, hi: F.when(c(name).between(lo, hi), c(name)).alias(name)
    half_step = F.abs(c("tilt") * 2 - F.bround(c("tilt") * 2)) < 1e-9
    return card.select(
        "race_key",
        "lane",
        F.when((c("avg_st") >= 0) & (c("avg_st") < 1), c("avg_st")).alias("avg_st"),
        inside("racer_win_rate", 0, 10),
        inside("local_win_rate", 0, 10),
        inside("motor_2ren", 0, 100),
        inside("exhibition_time", 6.0, 8.5),
        F.when(c("tilt").between(-0.5, 3.0) & half_step, c("tilt")).alias("tilt"),
    )
