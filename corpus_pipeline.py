"""A training corpus from `documents` in five stages, each calling one operator of tellurion.llm.

    quality     drops documents that the line classifier rejects (score under 0.3)
    language    drops documents without letters, or of whose letters no learned language has the share MIN_LANGUAGE_SHARE
    near_dedup  keeps one document of each group of near duplicates: the smallest doc_id
    decontaminate  drops documents that hold a benchmark item
    encode      token ids of what is left

Stages take (spark, docs, sf_dir) and work on all rows of `docs`. All but the last return the columns of `docs`, whatever
their names; an empty table gives an empty one. A null text counts as the empty one, which has no language and goes. Rows are
judged by their own text: rows that repeat a doc_id with other texts, and rows with a null doc_id, stay unless their text
is a near copy of another document's. Of rows that repeat doc_id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm.codec import encode
from tellurion.llm.common import fresh, materialize
from tellurion.llm.decontam import keep_clean
from tellurion.llm.langid import keep_identified
from tellurion.llm.langid import train as train_langid
from tellurion.llm.neardup import BROADCAST_IDS, near_duplicates
from tellurion.llm.quality import keep_good
from tellurion.llm.quality import train as train_quality

#: Language and quality models of the pipeline learn from all labelled rows, within the bounds of the operators' samples. Texts that
#: two languages share evenly go; one in one language with a foreign license line or two stays.
MIN_LANGUAGE_SHARE = 0.55


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, model, threshold=0.3)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, train_langid(docs), MIN_LANGUAGE_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name, own_id, own_hash = (fresh(docs, c) for c in ("text_hash", "own_id", "own_hash"))
    found = near_duplicates(docs, words=5, percent=80, with_hash=True)
    seen = found.groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    seen = materialize(seen.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), "kept"), "decisions")
    gone, twice = (seen.where(test).select(own_id, own_hash) for test in ("not kept", "kept"))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(name) == F.col(own_hash))
    marked = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    left = marked.join(_near(gone), same, "left_anti")
    if not twice.isEmpty():
        once = left.join(_near(twice), same, "left_semi").dropDuplicates(["doc_id", name])
        left = left.join(_near(twice), same, "left_anti").unionByName(once)
    return left.drop(name)


def _near(rows: DataFrame) -> DataFrame:
    """Decisions about few rows, counted first, go to the texts; texts and decisions of more are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS // 2 else rows


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("encode", encoded),
]

#: Trained models, hashed signatures and token merges are not expressible in SQL; tests use brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
