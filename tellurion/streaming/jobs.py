"""Structured Streaming forms: rollups and log counts with watermarks, late rows dropped, segments appended."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import ingest

#: How long each tier waits for late rows.
WAIT = {10_000: "90 seconds", 60_000: "90 seconds", 300_000: "200 seconds", 1_200_000: "5 minutes", 3_600_000: "5 minutes"}


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder; the source's log of seen files removes repeated notifications."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema) -> DataFrame:
    """JSON rows of a topic; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def windowed_rollup(samples: DataFrame, frequency: int, keys: list[str], delay: str | None = None) -> DataFrame:
    """Tumbling windows of `frequency` ms per key; rows later than the watermark are dropped, windows come out once closed."""
    at = samples.withColumn("_at", F.timestamp_millis("chq_timestamp")).withWatermark("_at", delay or WAIT.get(frequency, "90 seconds"))
    out = at.groupBy(F.window("_at", f"{frequency} milliseconds").alias("_w"), *keys).agg(F.sum("value").alias("chq_rollup_sum"), F.count("value").alias("chq_rollup_count"), F.min("value").alias("chq_rollup_min"), F.max("value").alias("chq_rollup_max"))
    return out.select(F.unix_millis("_w.start").alias("chq_timestamp"), *keys, "chq_rollup_sum", "chq_rollup_count", "chq_rollup_min", "chq_rollup_max")


def sliding_counts(logs: DataFrame, range_ms: int, step: int, keys: list[str], delay: str = "90 seconds") -> DataFrame:
    """Counts per sliding window, for dashboards that follow the stream."""
    at = logs.withColumn("_at", F.timestamp_millis("chq_timestamp")).withWatermark("_at", delay)
    out = at.groupBy(F.window("_at", f"{range_ms} milliseconds", f"{step} milliseconds").alias("_w"), *keys).agg(F.count("*").alias("count"))
    return out.select(F.unix_millis("_w.end").alias("chq_timestamp"), *keys, "count")


def raw_objects(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of (path, signal, length, modificationTime) of new raw objects, those of the store itself left out; each object
    comes once. The signal follows from the path as `ingest.signal_of` says."""
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length", "modificationTime")
    named = F.coalesce(F.nullif(F.regexp_extract("path", r"/(logs|metrics|traces)-raw/", 1), F.lit("")), F.when(F.col("path").contains("/otel-raw/"), F.nullif(F.regexp_extract("path", r"(logs|metrics|traces)[_.-][^/]*$", 1), F.lit(""))), F.lit("logs"))
    return seen.where(~F.col("path").contains("/db/")).withColumn("signal", F.when(named == "traces", "spans").otherwise(named)).select("path", "signal", "length", "modificationTime")


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, key: str | None = None):
    """Rows as JSON messages of a topic, from a table or, with a checkpoint, a stream; needs Spark's Kafka package."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    if df.isStreaming:
        return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def deduplicated(stream: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    at = stream.withColumn("_at", F.timestamp_millis("chq_timestamp")).withWatermark("_at", delay)
    return at.dropDuplicatesWithinWatermark([key]).drop("_at")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available now, exactly once, as Parquet. Windows that the watermark has not closed stay in the state."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_to_end(windowed: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Everything available now with the windows that are still open: every batch writes the windows it changed, the last
    writing of a window counts. Returned in the order of time. A batch that runs again overwrites its own folder."""
    spark = windowed.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    windowed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, path):
        return spark.createDataFrame([], windowed.schema)
    seen = spark.read.schema(T.StructType([*windowed.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)
    values = [c for c in windowed.columns if c not in keys]
    last = seen.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*").select(*windowed.columns).orderBy(keys[0])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ingest_segments(stream: DataFrame, path: str, checkpoint: str, signal: str) -> None:
    """Micro-batches as clustered segments, one folder per batch: a batch that runs again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        ingest.write_segments(batch, f"{path}/batch={number}", signal, mode="overwrite")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulate(stream: DataFrame, path: str, checkpoint: str, signal: str, key: str, target_rows: int, max_age_ms: int, at_once: str | None = None, now: Callable[[], int] | None = None) -> None:
    """Rows are held back until their key has `target_rows`, or its oldest row waited `max_age_ms`; then the key's rows become
    segments. Rows for which the SQL condition `at_once` holds do not wait.

    What waits is a table per batch number below `path`/waiting, made from the one before, so a batch that runs again replaces
    its own table and segments, both by the clock of that run. A last call of `flush` writes what still waits.
    """
    clock = now or (lambda: int(time.time() * 1000))

    def write(batch: DataFrame, number: int) -> None:
        spark, held, at = batch.sparkSession, f"{path}/waiting/batch={number - 1}", clock()
        fresh = batch.withColumn("_since", F.lit(at).cast("long"))
        every = fresh.unionByName(spark.read.schema(fresh.schema).parquet(held)) if number and _exists(spark, held) else fresh
        due = every.groupBy(key).agg(F.count("*").alias("_n"), F.min("_since").alias("_first"))
        due = due.where((F.col("_n") >= target_rows) | (F.col("_first") <= at - max_age_ms)).select(F.col(key).alias("_due"))
        passed = F.expr(at_once) if at_once else F.lit(False)
        marked = every.join(due, F.col(key).eqNullSafe(F.col("_due")), "left_semi").unionByName(every.join(due, F.col(key).eqNullSafe(F.col("_due")), "left_anti").where(F.coalesce(passed, F.lit(False))))
        ingest.write_segments(marked.drop("_since"), f"{path}/segments/batch={number}", signal, mode="overwrite")
        rest = every.join(due, F.col(key).eqNullSafe(F.col("_due")), "left_anti").where(~F.coalesce(passed, F.lit(False)))
        rest.write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def waiting(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that still wait, with the time since when: the table of the last batch. `schema` is the stream's."""
    schema = T.StructType([*schema.fields, T.StructField("_since", T.LongType())])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/waiting")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName()[6:]) for s in fs.listStatus(where)] if fs.exists(where) else []
    return spark.read.schema(schema).parquet(f"{path}/waiting/batch={max(numbers)}") if numbers else spark.createDataFrame([], schema)


def flush(spark: SparkSession, path: str, schema, signal: str) -> None:
    """Write what still waits as segments of their own, in place of what an earlier flush wrote."""
    ingest.write_segments(waiting(spark, path, schema).drop("_since"), f"{path}/segments/batch=end", signal, mode="overwrite")
