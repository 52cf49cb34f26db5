"""Corpus preparation in five stages: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, written as Parquet and read again for the next stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.llm import jaccard, langid, packing, quality, suffix
from racebook.llm.common import ship, stored
from racebook.sources.tables import read_table

#: A text whose main language has a smaller share of its words is rejected.
LEAST_SHARE = 0.4
#: Words that a worker remembers while it packs: fewer than packing alone may, as the workers serve all stages.
MEMO_WORDS = 250_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with a main language; learned from four fifths of the labelled rows, as in the query, where rows
    without an id go by their text. Where nothing can be learned, all texts with letters stay."""
    ship(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))) % 5 == 0
    field = langid.learned(docs, ~held_out)
    if field is None:
        return docs.where(F.col("text").rlike(r"\p{IsAlphabetic}"))
    found = langid.labelled(docs, field, lang="__lang_pred", score="__lang_score")
    sure = (F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__lang_score") >= LEAST_SHARE)
    return found.where(sure).drop("__lang_pred", "__lang_score")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that pass the base rule and are probably good."""
    ship(spark)
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of texts that share 80 % of their 5-word shingles. Texts without an id
    stay, and so do rows that repeat the id of a kept text."""
    ship(spark)
    groups = jaccard.jaccard_groups(docs, words=5, percent=80)
    others = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that occur earlier; texts of which nothing is left go."""
    ship(spark)
    cut = suffix.without_repeats(docs).withColumn("text", F.col(f"{suffix.OWN}kept")).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").rlike(r"[^ \t-\r]")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    ship(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, memo_words=MEMO_WORDS, added_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Stages learn models and packing optimises, so there is no SQL. A test holds run() against a plain version: near
#: copies by counts of shared shingles, passages by a byte scan, pieces by the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
