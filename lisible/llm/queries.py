"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, html_text, pfair_mix, pii, simhash, substring_dedup, topk_search, toxicity, unigram_counts
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0, every_row=True)


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighted by the square root of their rows."""
    return pfair_mix.mix(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE ranked AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS place
  FROM documents
), sizes AS (
  SELECT source, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS u FROM ranked GROUP BY source
), totals AS (
  SELECT CAST(sum(u) AS BIGINT) AS total, count(*) AS sources, greatest(1000, 4 * count(*)) AS cycle FROM sizes
), parts AS (
  SELECT source, cycle, cycle - sources AS spare, u * (cycle - sources) // total AS whole, u * (cycle - sources) % total AS rest
  FROM sizes, totals
), shares AS (
  SELECT source, cycle,
         1 + whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= spare - sum(whole) OVER () THEN 1 ELSE 0 END AS slots
  FROM parts
), lists AS (
  SELECT cycle, list(source ORDER BY source) AS sources, list(slots ORDER BY source) AS slots FROM shares GROUP BY cycle
), steps AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS i, list_transform(slots, lambda x: CAST(0 AS BIGINT)) AS sent FROM lists
  UNION ALL
  SELECT slot, i, list_transform(range(1, len(sent) + 1), lambda j: sent[j] + CASE WHEN j = i THEN 1 ELSE 0 END)
  FROM (
    SELECT s.slot + 1 AS slot, s.sent,
           list_min(list_transform(list_filter(range(1, len(s.sent) + 1), lambda j: s.sent[j] * l.cycle // l.slots[j] <= s.slot + 1),
                                   lambda j: ((s.sent[j] + 1) * l.cycle + l.slots[j] - 1) // l.slots[j] * 1000000 + j)) % 1000000 AS i
    FROM steps s, lists l WHERE s.slot + 1 < l.cycle
  )
), schedule AS (
  SELECT l.sources[i] AS source, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS turn FROM steps, lists l WHERE slot >= 0
), blocks AS (
  SELECT doc_id, r.source, place // 64 AS block, CAST(place % 64 AS INTEGER) AS position, slots, cycle
  FROM ranked r JOIN shares USING (source)
)
SELECT b.doc_id, b.source, CAST(block AS BIGINT) AS block, position,
       CAST(block * cycle // slots AS BIGINT) AS release, CAST(((block + 1) * cycle + slots - 1) // slots AS BIGINT) AS deadline,
       CAST(block // slots * cycle + slot AS BIGINT) AS slot
FROM blocks b JOIN schedule s ON s.source = b.source AND s.turn = b.block % b.slots
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM hashed
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_byte_bpe, op3_topk, op4_pfair_mix, op5_simhash, op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_pii, op10_toxicity)}
SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op4_pfair_mix": OP4_SQL, "op6_exact_dedup": OP6_SQL}
