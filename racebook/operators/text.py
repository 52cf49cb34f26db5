"""Comments and landed pages as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions import scalars as S


@dataclass(frozen=True)
class Lexicon:
    """Phrases per axis, axis weights and the words of the fallback and of doubt."""

    phrases: dict[str, list[tuple[str, float]]] = field(default_factory=lambda: K.PHRASES)
    weights: dict[str, float] = field(default_factory=lambda: K.AXIS_WEIGHTS)
    general: str = K.GENERAL_AXIS
    good: str = K.GOOD_WORDS
    bad: str = K.BAD_WORDS
    uncertain: list[str] = field(default_factory=lambda: K.UNCERTAIN)
    forms: list[tuple[str, str]] = field(default_factory=lambda: K.VERB_FORMS)

    def ordered(self) -> list[tuple[str, int, float]]:
        """(phrase, axis number, score), longest first, otherwise as listed."""
        axes = list(self.weights)
        rows = [(p, axes.index(a), s) for a in axes for p, s in self.phrases[a]]
        return sorted(rows, key=lambda r: -len(r[0]))


def phrase_counts(text: Column, phrases: list[str]) -> Column:
    """How often each phrase counts in a text, where a sign counts for one phrase only: earlier phrases of the list take
    their signs first, each from left to right. Null for a null text.

    One automaton of all phrases finds every place of every phrase in one pass over the text, whatever the
    number of phrases; only these places are then gone through in the order of the list.
    """
    if not phrases:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))
    sizes = [len(p) for p in phrases]

    def count(batches):
        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            if not automaton.exists(p):  # of equal phrases the first has all places
                automaton.add_word(p, i)
        automaton.make_automaton()

        def counts(body: str) -> list[int]:
            out = [0] * len(sizes)
            taken = bytearray(len(body))
            for i, end in sorted((i, end + 1) for end, i in automaton.iter(body)):
                begin = end - sizes[i]
                if not any(taken[begin:end]):
                    taken[begin:end] = b"\x01" * sizes[i]
                    out[i] += 1
            return out

        for d in batches:
            yield pd.Series([None if body is None else counts(body) for body in d], dtype="object")

    from collections.abc import Iterator

    import pandas as pd

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "array<int>")(text)


def score_comments(df: DataFrame, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Axis scores, weighted total, grade and confidence of each comment.

    Longer phrases take their signs first, so a shorter phrase inside a longer one does not count
    again. Everything happens on the row; nothing is shuffled.
    """
    axes = list(lexicon.weights)
    body = S.collapse(F.col(text))
    for old, new in lexicon.forms:
        body = F.replace(body, F.lit(old), F.lit(new))
    steps = lexicon.ordered()
    d = df.withColumn("_body", body).withColumn("_found", phrase_counts(F.col("_body"), [p for p, _, _ in steps]))
    found = [f"_found[{k}]" for k in range(len(steps))]
    per_axis = [" + ".join(["0D"] + [f"{s}D * {found[k]}" for k, (_, i, s) in enumerate(steps) if i == n]) for n in range(len(axes))]
    scored = F.expr(f"named_struct('hits', {' + '.join(['0', *found])}, 's', array({', '.join(per_axis)}))")
    d = d.withColumn("_f", scored)
    none = F.col("_f.hits") == 0
    good, bad = none & F.col("_body").rlike(lexicon.good), none & F.col("_body").rlike(lexicon.bad)
    doubts = S.count_words(F.col("_body"), lexicon.uncertain)
    d = d.withColumns({"_good": good, "_bad": bad, "_doubts": doubts})
    general = F.when(F.col("_good"), 0.30).otherwise(0.0) - F.when(F.col("_bad"), 0.35).otherwise(0.0)
    general = general - F.least(F.lit(0.60), F.col("_doubts") * 0.18)

    def axis_score(i: int, axis: str) -> Column:
        raw = F.col("_f.s")[i] + (general if axis == lexicon.general else F.lit(0.0))
        return F.least(F.greatest(raw, F.lit(-2.0)), F.lit(2.0))

    d = d.withColumns({f"score_{i}": axis_score(i, a) for i, a in enumerate(axes)})
    scores = [F.col(f"score_{i}") for i in range(len(axes))]
    weighted = [s * w for s, w in zip(scores, lexicon.weights.values())]
    total = F.least(F.greatest(sum(weighted[1:], weighted[0]), F.lit(-1.55)), F.lit(1.55))
    hits = F.col("_f.hits") + F.col("_good").cast("int") + F.col("_bad").cast("int")
    sure = F.least(F.lit(0.90), 0.35 + 0.10 * hits) * F.when(F.col("_doubts") > 0, 0.78).otherwise(1.0)
    d = d.withColumns(
        {"total": total, "hits": hits, "confidence": F.when(F.col("_body") != "", F.bround(sure, 3)).otherwise(0.0)}
    )
    grade = (
        F.when(F.col("total") >= 0.75, "◎")
        .when(F.col("total") >= 0.30, "○")
        .when(F.col("total") <= -0.75, "×")
        .when(F.col("total") <= -0.30, "△")
        .otherwise("－")
    )
    strong = lambda cond: F.array_compact(F.array(*[F.when(cond(s), F.lit(a)) for s, a in zip(scores, axes)]))
    up, down = strong(lambda s: s >= 0.45), strong(lambda s: s <= -0.45)
    top3 = lambda names: F.concat_ws("・", F.slice(names, 1, 3))
    label = (
        F.when(F.size(up) > 0, F.concat_ws(" ", grade, top3(up)))
        .when(F.size(down) > 0, F.concat_ws(" ", grade, top3(down)))
        .when(F.col("_body") != "", F.concat_ws(" ", grade, F.lit("大きな強弱なし")))
        .otherwise("未入力")
    )
    return d.withColumns({"grade": grade, "summary": label}).drop("_body", "_found", "_f", "_good", "_bad", "_doubts")


def segments(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, no, marker, segment): the text after each marker up to the next one.

    Markers and the texts around them come from the same pattern, so the n-th marker is followed
    by the n-th piece after the first. Whole texts are cut on their own row, without a shuffle.
    """
    d = df.select(
        key,
        F.regexp_extract_all(text, F.lit(f"({marker})"), 1).alias("m"),
        F.split(text, marker, -1).alias("pieces"),
    )
    pairs = F.arrays_zip(F.col("m"), F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0))).alias("p"))
    d = d.select(key, F.posexplode(pairs).alias("no", "x"))
    return d.select(key, "no", F.col("x.m").alias("marker"), F.trim(F.col("x.p")).alias("segment"))


@dataclass(frozen=True)
class CommentRules:
    """What tells a natural comment from a table fragment."""

    letters: str = K.COMMENT_LETTERS
    table_words: list[str] = field(default_factory=lambda: K.TABLE_WORDS)
    noise_words: list[str] = field(default_factory=lambda: K.NOISE_WORDS)
    race_words: list[str] = field(default_factory=lambda: K.RACE_WORDS)
    natural_words: list[str] = field(default_factory=lambda: K.NATURAL_WORDS)
    score_words: list[str] = field(default_factory=lambda: K.SCORE_WORDS)
    stops: str = "。！？!?"


NUMBER = r"\d+(?:\.\d+)?"


def count_text(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def is_noise(s: Column, rules: CommentRules) -> Column:
    return (
        s.rlike(r"\b[AB][12]\)?\s+\d+")
        | (F.regexp_count(s, F.lit(r"\b\d{4}\b")) >= 2)
        | (count_text(s, "0.00") >= 2)
        | (F.regexp_count(s, F.lit(NUMBER)) >= 8)
        | (F.regexp_count(s, F.lit(r"\d")) >= 14)
        | (S.count_words(s, rules.noise_words) >= 3)
    )


def is_natural(s: Column, rules: CommentRules) -> Column:
    numbers = F.regexp_count(s, F.lit(NUMBER))
    # cheap tests first: most pieces fail one before any pattern has to be matched
    return (
        F.length(s).between(5, 220)
        & (S.count_words(s, rules.race_words) > 0)
        & (S.count_words(s, rules.natural_words) > 0)
        & (S.count_words(s, rules.table_words) < 2)
        & (numbers < 4)
        & (F.regexp_count(s, F.lit(rules.letters)) >= 5)
        & ~is_noise(s, rules)
        & ~((numbers >= 2) & s.rlike(r"(?:^|\s)[AB][12](?:\s|$|\))"))
    )


def comment_score(s: Column, rules: CommentRules) -> Column:
    return (
        F.regexp_count(s, F.lit(rules.letters))
        + 12 * S.count_words(s, rules.score_words)
        - 8 * F.regexp_count(s, F.lit(NUMBER))
        - 50 * count_text(s, "0.00")
    )


def sentences(text: Column, stops: str) -> Column:
    """Pieces that end with a stop sign, without empty ones."""
    cut = F.regexp_replace(S.collapse(text), rf"([{stops}])\s*", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def best_sentences(df: DataFrame, key: list[str], text: str, rules: CommentRules = CommentRules()) -> DataFrame:
    """Best natural sentence per key; the earliest wins ties."""
    d = df.select(*key, F.posexplode(sentences(F.col(text), rules.stops)).alias("no", "sentence"))
    s = F.col("sentence")
    d = d.filter(is_natural(s, rules)).withColumn("score", comment_score(s, rules))
    order = F.struct(F.col("score"), -F.col("no"))
    return d.groupBy(*key).agg(F.max_by("sentence", order).alias("sentence"), F.max("score").alias("score"))


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, language, heading, visible text and link count of landed pages."""
    links = F.regexp_count("html", F.lit(r"<a [^>]*href="))
    d = pages.select(
        "page_id",
        S.collapse(S.unescape(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))).alias("title"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"),
        S.collapse(S.unescape(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))).alias("heading"),
        S.strip_tags(F.col("html")).alias("text"),
        links.alias("links"),
    )
    return d.withColumn("first_number", S.first_number(F.col("text")))


def preferred_links(pages: DataFrame, entity: str, fallback: str) -> DataFrame:
    """One link per (page, entity): the first without ``fallback`` in it, else the first with it."""
    d = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
    d = d.withColumn("entity", F.regexp_extract("href", entity, 1)).filter("entity <> ''")
    is_fallback = F.contains(F.col("href"), F.lit(fallback))
    return d.groupBy("page_id", "entity").agg(
        F.min_by("href", F.struct(is_fallback, F.col("pos"))).alias("href"), F.min(is_fallback.cast("int")).alias("is_fallback")
    )


def before_info(text: Column) -> dict[str, Column]:
    """Weather values of a pre-race page."""
    return {name: S.labelled(text, label) for name, label in K.WEATHER_LABELS.items()}


def start_exhibition(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lane, exhibition_st) from the start exhibition section; the last entry of a lane counts."""
    section = S.between(F.col(text), *K.START_SECTION)
    hits = F.regexp_extract_all(section, F.lit(K.START_ENTRY), 1)
    d = pages.select(key, F.posexplode(hits).alias("pos", "hit"))
    digits = F.lpad(F.regexp_extract("hit", r"(\d{1,2})$", 1), 2, "0")
    value = F.concat(F.lit("0."), digits).try_cast("double")
    signed = F.when(F.contains(F.col("hit"), F.lit("F")), -value).otherwise(value)
    d = d.select(key, F.substring("hit", 1, 1).cast("int").alias("lane"), signed.alias("st"), "pos")
    return d.groupBy(key, "lane").agg(F.max_by("st", "pos").alias("exhibition_st"))


def six_values(pages: DataFrame, key: str, text: str, headings: list[str]) -> DataFrame:
    """(key, heading, course, value) of the value lists under each heading; the first per course."""
    parts = segments(pages, key, text, "|".join(headings))
    hits = F.regexp_extract_all("segment", F.lit(K.COURSE_ENTRY), 1)
    d = parts.select(key, F.col("marker").alias("heading"), "no", F.posexplode(hits).alias("pos", "hit"))
    d = d.select(
        key, "heading", "no", "pos",
        F.substring("hit", 1, 1).cast("int").alias("course"),
        F.regexp_extract("hit", r"\s(\d+(?:\.\d+)?)", 1).try_cast("double").alias("value"),
    )
    # min_by skips nothing: a dash is a value that was read and is missing
    first = F.min_by(F.struct("value"), F.struct("no", "pos"))
    return d.groupBy(key, "heading", "course").agg(first.getField("value").alias("value"))


def deadline_clock(text: Column, race_no: Column, label: str = K.DEADLINE_LABEL) -> Column:
    """Clock time of the race: the n-th of the twelve times that follow the label."""
    times = S.clock_times(S.after(text, label))
    return F.when(F.size(times) >= 12, F.try_element_at(times, race_no))


def official_payout(text: Column) -> tuple[Column, Column]:
    """Combination and payout per 100 from the text of a result page."""
    parts = [F.regexp_extract(text, K.TRIFECTA_ENTRY, i) for i in (1, 2, 3)]
    found = F.when(parts[0] != "", F.concat_ws("-", *parts))
    tail = F.regexp_extract(text, K.TRIFECTA_ENTRY + r"\s+[¥￥]?([\d,]+)円?", 4)
    return found, S.money(tail)


def layout(rows: DataFrame, key: str, length: Column, vote: Column) -> DataFrame:
    """Typical row length per table and whether at least half of its rows carry a mark."""
    per_length = rows.groupBy(key, length.alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(vote).alias("votes")
    )
    return per_length.groupBy(key).agg(
        F.max_by("length", F.struct(F.col("n"), -F.col("length"))).alias("typical_length"),
        (F.sum("votes") >= F.greatest(F.lit(1), F.floor(F.sum("n") / 2))).alias("majority"),
    )
