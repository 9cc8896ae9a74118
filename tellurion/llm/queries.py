"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts under byte_bpe_50k.json, from the prefix tables."""
    from .tokens import prefix_counts

    counted = prefix_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "limit_bytes")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the line chain, learned from labels outside the held-out fifth."""
    from .quality import classify, train

    docs, labels = documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, train(docs, labels.where(fold("doc_id", 5) != 0)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 3-word shingles at 85 %."""
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), words=3, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled uniformly into 40 shards with row counts at most one apart."""
    from .sharding import shard

    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts under word_bpe_49k.json, written as sorted string tables and read back."""
    from .sstable import roundtrip

    return roundtrip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded by the ranks of byte_bpe_50k.tiktoken and decoded again."""
    from .codec import decode, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(documents(spark, sf_dir, "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return decode(coded, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out quarter."""
    from .langid import identify, train

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs, train(docs.where(fold("doc_id", 4) != 2)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts stored as payload of MPEG streams, parsed back from the stored bytes."""
    from .audio import encode_media, read_media

    return read_media(encode_media(documents(spark, sf_dir, "doc_id", "text"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "seek"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    from .decontam import decontaminate

    found = decontaminate(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated").select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.score", "hit.overlap", "hit.start", "hit.end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


_NEARDUP_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM words),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(m, doc_id) >= doc_id AS kept
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; trained models, tokenizers, file formats and random draws are tested by brute force."""
    return {"op3_minhash_dedup": _NEARDUP_SQL}
