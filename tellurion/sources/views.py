"""Telemetry tables: derived from an `events` table, or read from stored segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact

CORE = {"chq_timestamp", "chq_tsns", "chq_id", "log_message", "bucket_ts"}


def _millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _level() -> Column:
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def logs(spark: SparkSession, sf_dir: str, message: str = "logfmt") -> DataFrame:
    """Log lines: `message` is logfmt, json (the event's properties) or access (a line for regular expressions)."""
    k = F.get_json_object("props", "$.k")
    text = {
        "logfmt": F.concat(F.lit("type="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" dur="), k, F.lit("ms"), F.lit(" size="), k, F.lit("KiB")),
        "json": F.col("props"),
        "access": F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" k="), k),
    }[message]
    return events(spark, sf_dir).select(
        _millis().alias("chq_timestamp"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("chq_tsns"), F.col("event_id").cast("string").alias("chq_id"), _level().alias("log_level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("resource_service_name"), F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("resource_k8s_pod_name"), text.alias("log_message"),
    )


def metrics(spark: SparkSession, sf_dir: str, frequency: int = 10_000) -> DataFrame:
    """One metric, rolled up to `frequency` ms per event type and user."""
    source = events(spark, sf_dir).select(_millis().alias("t"), "event_type", "user_id", "value")
    rolled = exact.summed(
        source, {"chq_timestamp": F.col("t") - F.pmod("t", F.lit(frequency)), "event_type": F.col("event_type"), "user_id": F.col("user_id")}, F.col("value"), "chq_rollup_sum",
        {"chq_rollup_count": (F.lit(1), F.count), "chq_rollup_min": (F.col("value"), F.min), "chq_rollup_max": (F.col("value"), F.max)},
    )
    return rolled.select(
        "chq_timestamp", F.lit("event_value").alias("metric_name"), "event_type", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("resource_service_name"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("resource_k8s_pod_name"), "chq_rollup_sum", "chq_rollup_count", "chq_rollup_min", "chq_rollup_max",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples of the metric, each a rollup of one, for sketches and ingestion."""
    return events(spark, sf_dir).select(
        _millis().alias("chq_timestamp"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("chq_tsns"), F.lit("event_value").alias("metric_name"), "event_type", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("resource_service_name"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("resource_k8s_pod_name"), F.col("value"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        _millis().alias("chq_timestamp"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("chq_tsns"), F.col("event_id").cast("string").alias("chq_id"), F.col("event_type").alias("span_name"),
        F.when(F.col("user_id") % 2 == 0, "server").otherwise("client").alias("span_kind"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("span_status_code"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("span_trace_id"), F.concat(F.lit("span-"), F.col("event_id").cast("string")).alias("span_id"), (F.col("event_id") % 1000).alias("span_duration"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("resource_service_name"),
    )


def label_columns(df: DataFrame) -> list[str]:
    """Columns that count as labels: all but identities, times, values and bodies."""
    return [c for c in df.columns if not c.startswith("chq_") and c not in CORE and c not in ("value", "metric_name")]
