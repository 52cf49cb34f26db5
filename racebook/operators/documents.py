"""Stored JSON documents of predictions, read as VARIANT: one path for every form a document has.

A document is an object with ``final``, ``tickets`` and ``research``, or, in its old form, the bare list of lanes.
It is parsed once; each field is then taken by path and cast by itself, so one bad value is a missing value and not
a lost row. ``NaN`` and infinities, which JSON does not know, count as missing. A text that was cut off or is no
JSON gives no document, and so do nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StructType

from racebook.functions.scalars import once
from racebook.schemas import PAYLOAD

#: A stretch of strings and other signs, then a number that JSON does not know. Strings are passed over whole.
_NOT_FINITE = r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"NI-]++|-(?!Infinity))*+)(?:-?Infinity|NaN)'


def _kind(part: str) -> ArrayType | MapType:
    return StructType.fromDDL(PAYLOAD)[part].dataType


def opened(text: Column) -> Column:
    """The document as VARIANT."""
    clean = F.when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), F.regexp_replace(text, _NOT_FINITE, "$1null")).otherwise(text)
    return F.try_parse_json(clean)


def _finite(item: Column, field) -> Column:
    got = item.getField(field.name)
    if isinstance(field.dataType, DoubleType):  # a text may say "NaN" as well
        got = F.when(~F.isnan(got) & (F.abs(got) != float("inf")), got)
    return got.alias(field.name)


def _rows(items: Column, kind: ArrayType) -> Column:
    """Rows of the named fields: each is taken from its item once, then looked at."""
    fields = kind.elementType.fields
    taken = lambda x: F.struct(*[F.try_variant_get(x, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])
    return F.transform(F.transform(items, taken), lambda x: F.struct(*[_finite(x, f) for f in fields]))


def lanes(doc: Column) -> Column:
    """Rows of lanes of either form."""
    items = F.coalesce(F.try_variant_get(doc, "$.final", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    return _rows(items, _kind("final"))


def tickets(doc: Column) -> Column:
    return _rows(F.try_variant_get(doc, "$.tickets", "array<variant>"), _kind("tickets"))


def research(doc: Column) -> Column:
    """Variant name -> rows of lanes. A variant that is no list has none."""
    kind = _kind("research").valueType
    return F.transform_values(
        F.try_variant_get(doc, "$.research", "map<string,variant>"),
        lambda _, v: _rows(F.try_variant_get(v, "$", "array<variant>"), kind),
    )


def read_documents(df: DataFrame, text: str = "payload_json") -> DataFrame:
    """``df`` with ``payload``: the lists of a document, null where the text is no document."""
    doc = F.col("_doc")
    parts = F.struct(lanes(doc).alias("final"), tickets(doc).alias("tickets"), research(doc).alias("research"))
    read = df.withColumn("_doc", once(opened(F.col(text)))).withColumn("payload", once(F.when(doc.isNotNull(), parts)))
    return read.drop("_doc")
