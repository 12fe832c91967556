"""Queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, classifier, decontaminate, html_extract, line_dedup, ngram_trie, quality_rules, sentencepiece_dropout, sharding, warc
from .shared import table


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.judge(docs, keep_text=False)
    return judged.select("doc_id", *[f"quality.{c}" for c in quality_rules.COUNTS], "quality.base_failed", "quality.kept")


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classify_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode_texts(table(spark, sf_dir, "documents"))


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_rank")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram_trie.held_out_fold())


_QUERIES = (
    op1_histogram_sort,
    op2_robust_outliers,
    op3_merge_dropout,
    op4_bradley_terry,
    op5_bagminhash,
    op6_crf_main_text,
    op7_warc_index_merge,
    op8_line_chunks,
    op9_spaced_seeds,
    op10_ngram_trie,
)

#: Shards by bytes in the order of a digest of id and text; the checksum by its table of 256 remainders.
_OP1 = """
WITH RECURSIVE bit(i, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, octet_length(encode(text)) + 16 AS size, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), text)) AS h, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, size, substr(h, 1, 15) AS key, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, t[1 + xor(a & 255, x)])), 4294967295) AS crc FROM b, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST(least(39, (2 * below + size) * 40 // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size, crc) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

#: Rows in the order of page captures: host labels reversed, path, sorted query; revisits by equal payloads of 100 bytes or more.
_OP7 = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, url, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
), u AS (
  SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM r
), k AS (
  SELECT *, regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), ':.*$', '')), '^www[0-9]*[.]', '') AS host,
    lower(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1)) AS path, lower(regexp_extract(rest, '[?](.*)$', 1)) AS query FROM u
), s AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url_key FROM k
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to,
  url_key, CAST(row_number() OVER (ORDER BY url_key, page_id) - 1 AS BIGINT) AS history_rank
FROM s
"""


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_histogram_sort": _OP1, "op7_warc_index_merge": _OP7}
