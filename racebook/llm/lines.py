"""Lines that many documents share, dropped from all but one. DataFrame functions only.

Every text is split at line feeds. The key of a line is the line without blanks at its ends, A-Z lower-cased; it is
known by two 64-bit hashes. Lines whose key is long enough are written out once as (row, place, hashes); from there

1. documents are counted: the lines are first reduced to one row for each key and document, then counted by key,
   so a key that stands in a third of all documents is spread by document and meets in partial counts only;
2. the lines meet the keys that are to go; what is dropped is gathered as places of a row of the input;
3. the rows meet their dropped places, and the lines left are joined in their order.

In both joins a key that very many rows share is dealt out: such keys are few (each holds more than one part in
``HOT_KEYS`` of all matches), so the list of them is broadcast, and both sides spread them over as many parts as they
need. The text itself is shuffled once, by row.

A null text is empty; an empty text is one empty line. Rows that repeat an id are one document in the counts, and
the document with the largest id keeps its lines in all its rows. Rows without an id are one document below all
others. A repeated row is treated like its copy and stays as often as it came. A line of any length is one line; the lines of one text
are one array, as they came in one text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racebook.llm.common import drop_stored, stored

OWN = "__lines_"
#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: At most so many keys are dealt out one by one; each of them has more than this share of all matches.
HOT_KEYS = 1 << 15
#: A key with fewer matches is never dealt out.
FEW = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_letters(text: Column) -> Column:
    """A-Z lower-cased and no other letter; texts of ASCII alone take the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def two_hashes(*parts: Column) -> list[Column]:
    """128 bits in two columns; a null differs from every value."""
    known = [c for p in parts for c in (p.isNull(), p)]
    return [F.xxhash64(F.lit(seed), *known) for seed in (1, 2)]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, salt: Column, how: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` the number of rows of ``left`` that
    it meets. Keys far above the average are dealt out by ``salt`` of the left rows."""
    total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    limit = max(FEW, total // HOT_KEYS)
    fan = F.ceil(F.col(weight) / limit).cast("int")
    # weights above the limit add up to the total at most, so this list has HOT_KEYS rows at most
    hot = right.where(F.col(weight) > limit).select(*keys, fan.alias(f"{OWN}fan"))
    dealt = left.withColumn(f"{OWN}any", salt).join(F.broadcast(hot), keys, "left")
    part = F.when(F.col(f"{OWN}fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(f"{OWN}any"), F.col(f"{OWN}fan")).cast("int"))
    dealt = dealt.withColumn(f"{OWN}part", part).drop(f"{OWN}any", f"{OWN}fan")
    copies = F.when(F.col(weight) > limit, F.sequence(F.lit(0), fan - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn(f"{OWN}part", F.explode(copies)), [*keys, f"{OWN}part"], how).drop(f"{OWN}part")


def keyed_lines(rows: DataFrame, shortest: int) -> DataFrame:
    """id, r1, r2, place, h1, h2 of every line whose key has ``shortest`` code points; ``rows``: id, r1, r2, lines."""
    each = rows.select("id", "r1", "r2", F.posexplode("lines").alias("place", "line"))
    bare = F.btrim(F.col("line"), F.lit(BLANKS))
    h1, h2 = two_hashes(small_letters(bare))
    long = each.where((F.octet_length("line") >= shortest) & (F.char_length(bare) >= shortest))
    return long.select("id", "r1", "r2", "place", h1.alias("h1"), h2.alias("h2"))


def common_keys(keyed: DataFrame, least: int) -> DataFrame:
    """h1, h2, keeper (the largest id that holds the key) and n_lines of every key in ``least`` documents."""
    by_document = keyed.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_document.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"), F.sum("n").alias("n_lines"))
    return by_key.where(F.col("docs") >= least).drop("docs")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shortest: int = 20) -> DataFrame:
    """All columns of ``docs`` and, under names that begin with ``OWN``: n_lines, n_dropped, kept (the text left)."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    key = F.col(id_col).cast("long")
    r1, r2 = two_hashes(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(key.alias("id"), r1.alias("r1"), r2.alias("r2"), lines.alias("lines"))
    keyed = stored(keyed_lines(rows, shortest), "line-keys")
    common = stored(common_keys(keyed, least), "line-common")
    met = spread_join(keyed, common, ["h1", "h2"], "n_lines", F.struct("r1", "r2", "place"), "inner")
    gone = met.where(~F.col("id").eqNullSafe(F.col("keeper")))
    # copies of a row have the same places; one row a place, and how many copies of the row there are
    places = gone.groupBy("r1", "r2", "place").agg(F.count(F.lit(1)).alias("copies"))
    dropped = stored(places.groupBy("r1", "r2").agg(F.collect_list("place").alias("gone"), F.max("copies").alias("copies")), "line-places")
    drop_stored(keyed, common)
    own = {f"{OWN}{c}": c for c in ("r1", "r2")}
    whole = docs.withColumns({f"{OWN}r1": r1, f"{OWN}r2": r2, f"{OWN}all": lines})
    dropped = dropped.select(*[F.col(c).alias(o) for o, c in own.items()], F.col("gone").alias(f"{OWN}gone"), F.col("copies").alias(f"{OWN}copies"))
    out = spread_join(whole, dropped, list(own), f"{OWN}copies", F.monotonically_increasing_id(), "left")
    every = F.sequence(F.lit(0), F.size(f"{OWN}all") - 1)
    left = F.transform(F.array_except(every, F.col(f"{OWN}gone")), lambda i: F.get(F.col(f"{OWN}all"), i))
    kept = F.when(F.col(f"{OWN}gone").isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(left, "\n"))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(f"{OWN}all").cast("long").alias(f"{OWN}n_lines"),
        F.coalesce(F.array_size(f"{OWN}gone"), F.lit(0)).cast("long").alias(f"{OWN}n_dropped"),
        kept.alias(f"{OWN}kept"),
    )
