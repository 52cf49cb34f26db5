"""Registered queries of this subpackage, with check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.llm import binary, bpe, chat, jaccard, langid, lexical, lines, packing, quality, suffix, topk, warc, whitening
from racebook.llm.common import ship, stored
from racebook.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Files of the public tokenizers.
WORDS, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def query(name: str, table: str, sql: str | None = None, other: tuple[str, ...] = ()):
    """Register ``fn(table, *other tables) -> DataFrame``."""

    def wrap(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(*[read_table(spark, sf_dir, t) for t in (table, *other)])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query(
    "op1_warc",
    "pages",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
    SELECT page_id, strlen(p.html) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p JOIN f USING (html)
    """,
)
def op1_warc(pages: DataFrame) -> DataFrame:
    archived = warc.read_warc(warc.write_warc(pages, min_bytes=0))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_packing", "documents")
def op2_packing(documents: DataFrame) -> DataFrame:
    pieces = packing.pack(documents, public_tokenizers.path(WORDS), end_id=2, added_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_quality_rules", "documents")
def op3_quality_rules(documents: DataFrame) -> DataFrame:
    counted = stored(quality.with_counts(documents.select("doc_id", "text"), keep_text=False), "quality-counts")
    out = quality.judged(counted)
    own = [*quality.COUNTS[:5], "base_failed", "kept", "p_good"]
    return out.select("doc_id", *[F.col(quality.OWN + c).alias(c) for c in own])


@query("op4_jaccard_join", "documents")
def op4_jaccard_join(documents: DataFrame) -> DataFrame:
    return jaccard.jaccard_groups(documents, words=3, percent=90)


@query("op5_suffix_array", "documents")
def op5_suffix_array(documents: DataFrame) -> DataFrame:
    out = suffix.without_repeats(documents.select("doc_id", "text"), digest=True)
    own = {"n_bytes": "n_bytes", "n_removed": "n_removed", "n_spans": "n_spans", "kept": "kept_sha256"}
    return out.select("doc_id", *[F.col(suffix.OWN + c).alias(name) for c, name in own.items()])


@query("op6_token_files", "documents")
def op6_token_files(documents: DataFrame) -> DataFrame:
    return binary.read_binary(binary.write_binary(documents, public_tokenizers.path(WORDS), end_id=1, added_tokens=True))


@query(
    "op7_chat",
    "conversations",
    """
    WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text FROM conversations),
    i AS (SELECT *, struct_pack(a := turn, b := role, c := text) AS item FROM t),
    p AS (SELECT conv_id, turn, md5(list(item ORDER BY turn, role, text)
            OVER (PARTITION BY conv_id ORDER BY turn RANGE UNBOUNDED PRECEDING)::VARCHAR) AS mark,
            count(*) OVER (PARTITION BY conv_id ORDER BY turn RANGE UNBOUNDED PRECEDING) AS n,
            count(*) OVER (PARTITION BY conv_id) AS whole FROM i),
    d AS (SELECT DISTINCT conv_id, mark, n, whole FROM p),
    k AS (SELECT mark, n, min(conv_id) AS conv_id, count(*) AS copies FROM d WHERE n = whole GROUP BY mark, n),
    m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.n < d.whole AND d.mark = k.mark AND d.n = k.n)),
    c AS (SELECT t.*, n, copies, CASE WHEN count(*) OVER (PARTITION BY t.conv_id, turn) > 64
            THEN substr(md5(coalesce(role, '') || chr(10) || coalesce(text, '')), 1, 4) END AS cell
          FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, cell, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM c)
    SELECT conv_id, place // 64 AS part, n AS n_turns, copies,
      string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS text
    FROM r GROUP BY ALL
    """,
)
def op7_chat(conversations: DataFrame) -> DataFrame:
    return chat.render(conversations)


@query("op8_language", "documents")
def op8_language(documents: DataFrame) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    field = langid.learned(documents, ~held_out)
    texts = documents.select("doc_id", "text")
    return langid.labelled(texts, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(
    "op9_topk",
    "embeddings",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 20
    """,
)
def op9_topk(embeddings: DataFrame) -> DataFrame:
    return topk.search(embeddings, F.col("vec_id") % 20 == 0, k=20)


@query("op10_bpe", "documents")
def op10_bpe(documents: DataFrame) -> DataFrame:
    return bpe.round_trip(documents, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query(
    "op11_line_dedup",
    "documents",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20)
      GROUP BY key HAVING count(*) >= 3),
    m AS (SELECT k.*, c.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY r
    """,
)
def op11_line_dedup(documents: DataFrame) -> DataFrame:
    out = lines.without_common_lines(documents.select("doc_id", "text"))
    kept = F.sha2(F.col(lines.OWN + "kept"), 256).alias("kept_sha256")
    return out.select("doc_id", F.col(lines.OWN + "n_lines").alias("n_lines"), F.col(lines.OWN + "n_dropped").alias("n_dropped"), kept)


@query("op12_whitening", "embeddings")
def op12_whitening(embeddings: DataFrame) -> DataFrame:
    return whitening.whiten(embeddings, k=4, scale=256).withColumn("deviation", F.col("deviation").cast("long"))


@query(
    "op13_lexical_search",
    "documents",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    e AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    tf AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM e GROUP BY r, term),
    n AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
    g AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
    w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf CROSS JOIN g GROUP BY term, docs),
    b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    i AS (SELECT DISTINCT item_id, term FROM b),
    s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r) CROSS JOIN g GROUP BY item_id, r),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
    SELECT * FROM k WHERE rank <= 10
    """,
    other=("benchmark",),
)
def op13_lexical_search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return lexical.rank(documents, benchmark, k=10)
