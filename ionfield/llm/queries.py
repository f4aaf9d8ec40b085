"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    from .token_counts import count_tokens

    counted = count_tokens(_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import encode_texts, read_media, store_media

    return read_media(store_media(encode_texts(_table(spark, sf_dir, "documents"))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_histories

    return capture_histories(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position", "capture_rank")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    from .langid import crc_residue
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    held_out = crc_residue(F.col("doc_id"), 3) == 1
    model = train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import crc_residue, identify, train

    docs = _table(spark, sf_dir, "documents")
    held_out = crc_residue(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WARC_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(html, '') AS html, list_last(string_split(regexp_extract(coalesce(url, ''), '^[^#]*'), '://')) AS rest FROM pages
), h AS (
  SELECT page_id, html, rest, lower(list_last(string_split(regexp_extract(rest, '^[^/?]*'), '@'))) AS site, regexp_extract(rest, '[/?].*$', 0, 's') AS path FROM u
), p AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
    CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(split_part(site, ':', 1), '^www\.', ''), '.')), ',')
      || CASE WHEN split_part(site, ':', 2) IN ('', '80', '443') THEN '' ELSE ':' || split_part(site, ':', 2) END
      || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key
  FROM h
), m AS (
  SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN m.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.response <> p.page_id THEN m.response END AS refers_to, url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, p.page_id) - 1 AS position,
       row_number() OVER (PARTITION BY url_key ORDER BY captured_at, p.page_id) AS capture_rank
FROM p LEFT JOIN m USING (payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_matroska": op2_matroska,
        "op3_warc": op3_warc,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_main_text": op6_main_text,
        "op7_language": op7_language,
        "op8_packing": op8_packing,
        "op9_secrets": op9_secrets,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _WARC_SQL}
