"""Text, date and number expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from racebook import constants as K

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def collapse(text: Column) -> Column:
    """One space for any run of white space, none at the ends; missing text is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　]+", " "))


def narrow(text: Column) -> Column:
    """Full-width letters, digits and signs as their plain form."""
    return F.translate(text, WIDE, NARROW)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Full compatibility folding, for text where ``narrow`` is not enough."""
    return text.str.normalize("NFKC")


def once(value: Column) -> Column:
    """``value``, computed once a row. Later filters would otherwise repeat a long expression, with all that it is made
    of, below the place where it is computed; they do not pass a generator."""
    return F.explode(F.array(value))


def unescape(text: Column) -> Column:
    """Basic HTML entities; the ampersand last, so that nothing is unescaped twice."""
    for name, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def strip_tags(html: Column) -> Column:
    """Visible text of a page."""
    text = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return collapse(unescape(F.regexp_replace(text, r"<[^>]*>", " ")))


def first_number(text: Column) -> Column:
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.regexp_extract(bare, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def all_numbers(text: Column) -> Column:
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.transform(F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double"))


def money(text: Column) -> Column:
    """Whole amount of at least 100 without currency marks and separators."""
    digits = F.regexp_replace(text, r"[¥￥円, ]", "")
    amount = F.when(digits.rlike(r"^\d+$"), digits.try_cast("long"))
    return F.when(amount >= 100, amount)


def labelled(text: Column, label: str) -> Column:
    """Number right after a label."""
    return F.regexp_extract(text, label + r"\s*([0-9.]+)", 1).try_cast("double")


def after(text: Column, start: str) -> Column:
    """Text after the first ``start``; NULL without it."""
    at = F.locate(start, text)
    return F.when(at > 0, F.substring(text, at + len(start), F.length(text)))


def between(text: Column, start: str, end: str) -> Column:
    """Text after the first ``start`` and before the next ``end``; NULL without ``start``."""
    return F.substring_index(after(text, start), end, 1)


def count_words(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the text."""
    hits = [F.contains(text, F.lit(w)).cast("int") for w in words]
    return sum(hits[1:], hits[0])


def clock_times(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.CLOCK_TIME), 1)


def compact_day(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[-/]", "")


def day(text: Column) -> Column:
    """Date from ``YYYYMMDD``, ``YYYY-MM-DD`` or ``YYYY/MM/DD``."""
    return F.try_to_date(compact_day(text), "yyyyMMdd")


def race_key(date_text: Column, venue: Column, race_no: Column) -> Column:
    return F.concat_ws("_", compact_day(date_text), F.lpad(venue.cast("string"), 2, "0"), race_no.cast("string"))


def epoch_micros(wall: Column) -> Column:
    """Microseconds since 1970 of a UTC wall time, whatever the session zone."""
    days = F.date_diff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("long")
    minutes = (days * 24 + F.hour(wall)) * 60 + F.minute(wall)
    return minutes * 60_000_000 + seconds


def instant(wall: Column) -> Column:
    """Zoned timestamp of a UTC wall time."""
    return F.timestamp_micros(epoch_micros(wall))


def from_epoch(micros: Column) -> Column:
    """UTC wall time of microseconds since 1970."""
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def utc(ts: Column) -> Column:
    """UTC wall time of a zoned timestamp, whatever the session zone."""
    return from_epoch(F.unix_micros(ts))


def iso_time(text: Column) -> Column:
    """ISO text as UTC wall time; text without a zone is UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return utc(zoned.try_cast("timestamp"))


def japan_time(date: Column, clock: Column) -> Column:
    """UTC wall time of a local clock reading."""
    local = F.concat_ws(" ", date.cast("string"), clock).try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit("Asia/Tokyo"), F.lit("UTC"), local)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / 60e6


def day_label(text: Column) -> Column:
    return F.regexp_extract(text, K.DAY_LABEL, 1)


def sale_status(text: Column) -> Column:
    """Closed, next race with its time, not yet open, or empty, in this precedence."""
    no, time = next_race_no(text), next_race_time(text)
    return (
        F.when(text.rlike(K.CLOSED), K.CLOSED_STATUS)
        .when(no.isNotNull(), F.concat(no.cast("string"), F.lit("R "), time))
        .when(F.contains(text, F.lit(K.NOT_OPEN)), K.NOT_OPEN)
        .otherwise("")
    )


def next_race_no(text: Column) -> Column:
    return F.regexp_extract(text, K.NEXT_RACE, 1).try_cast("int")


def next_race_time(text: Column) -> Column:
    return F.regexp_extract(text, K.NEXT_RACE, 2)
