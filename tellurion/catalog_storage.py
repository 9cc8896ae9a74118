"""Queries of ingestion, storage and streaming on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sketch
from .functions.identity import span_parts
from .operators import metadata
from .session import Engine
from .sources import ingest, views
from .sources.store import Store
from .streaming import jobs

DAY, HOUR = 86_400_000, 3_600_000
START, END = 1_704_067_200_000, 1_704_067_200_000 + 31 * DAY
_DAY_SQL = "CAST(strftime(make_timestamp(chq_timestamp * 1000), '%Y%m%d') AS INTEGER)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _store(spark: SparkSession, d: str, path: str, *signals: str) -> Store:
    """Logs, samples (with all tiers) and spans in two ingestions each."""
    store = Store(spark, path)
    for table, signal in ((views.logs, "logs"), (views.samples, "metrics"), (views.spans, "spans")):
        if signal in signals:
            for half in (0, 1):
                store.ingest(table(spark, d).where(F.floor(F.col("chq_timestamp") / DAY) % 2 == half), signal)
    if "metrics" in signals:
        store.rollup()
    return store


def queries(temporary) -> dict:
    """name -> (query, SQL or None); `temporary` (spark, name) gives a fresh path in the shared folder."""
    engine = lambda s, d, *signals: Engine(store=_store(s, d, temporary(s, "store"), *signals))

    def tiers(s: SparkSession, d: str) -> DataFrame:
        """The rows that a daily query reads: those of the coarsest tier."""
        store = _store(s, d, temporary(s, "store"), "metrics")
        rows = store.source("metrics")(metadata.selectors(metadata.syntax.parse_promql("event_value"))[0], START, END, DAY, (), False)
        return _rounded(rows.select("chq_timestamp", "event_type", "resource_k8s_pod_name", "chq_rollup_sum", "chq_rollup_count", "frequency_ms"))

    def compacted(s: SparkSession, d: str) -> DataFrame:
        """What is left after compaction, expiry and the deletion of old files: files by day, and their rows."""
        store = _store(s, d, temporary(s, "store"), "logs")
        store.ingest(views.logs(s, d).where("chq_id % 10 = 0"), "logs")
        store.compact("logs")
        store.expire(START + 29 * DAY, 7, ("logs",))
        store.vacuum()
        return store.live().where("signal = 'logs'").groupBy("dateint").agg(F.count("*").alias("files"), F.sum("rows").alias("records"))

    def mixed(s: SparkSession, d: str) -> DataFrame:
        fine = ingest.rollup(views.samples(s, d), 10_000, True)
        out = ingest.compact([fine, ingest.rollup(fine, HOUR)], "metrics")
        return _rounded(out.groupBy("frequency_ms", "event_type").agg(F.count("*").alias("n"), F.sum("chq_rollup_sum").alias("total"), F.sum("chq_rollup_count").alias("samples")))

    def all_labels(s: SparkSession, d: str) -> DataFrame:
        df = views.samples(s, d).drop("event_type", "resource_k8s_pod_name").withColumn("zone", F.concat(F.lit("z"), F.expr("cast(chq_tsns div 1000 % 3 as string)")))
        return _rounded(ingest.rollup(df, HOUR, True).select("chq_timestamp", "zone", "resource_service_name", "chq_rollup_sum", "chq_rollup_count"))

    def detected(s: SparkSession, d: str) -> DataFrame:
        e = views.events(s, d)
        at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        odd = F.col("event_id") % 2 == 1
        return ingest.translate_logs(e.select(
            F.when(odd, at).alias("@timestamp"), F.when(~odd, F.unix_millis(F.col("ts").cast("timestamp"))).alias("time"), F.when(odd, F.col("event_type")).alias("message"), F.when(~odd, F.col("props")).alias("body"),
            F.when(odd, F.lit("warn")).alias("severity"), F.col("user_id").alias("User.Id"), F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit(".shop.example.com")).alias("host.name"),
        ), "s3://b/logs-raw/x.json.gz", bucket="b").select("chq_timestamp", "log_message", "log_level", "resource_user_id", "resource_customer_domain", "resource_file_type")

    def spans_of_all_kinds(s: SparkSession, d: str) -> DataFrame:
        is_ = lambda kind, value: F.when(F.col("span_name") == kind, value)
        df = views.spans(s, d).withColumns({
            "attr_messaging_system": is_("click", F.lit("kafka")), "attr_messaging_destination_name": is_("click", F.concat(F.lit("t"), (F.col("span_duration") % 3).cast("string"))),
            "attr_db_system_name": is_("view", F.lit("pg")), "attr_server_address": is_("view", F.concat(F.lit("db"), (F.col("span_duration") % 2).cast("string"))), "attr_http_request_method": is_("signup", F.lit("GET")), "attr_url_template": is_("signup", F.lit("/u/{id}")),
            "resource_service_name": F.when(F.col("span_duration") % 2 == 0, F.col("resource_service_name")),
        })
        return df.groupBy(span_parts(df).alias("parts")).agg(F.count("*").alias("n"))

    def cardinality(s: SparkSession, d: str) -> DataFrame:
        """Sketches per day and level, stored as bytes, merged and estimated: within 5 % of the exact number of pods."""
        logs = ingest.with_dates(views.logs(s, d))
        daily = logs.groupBy("dateint", "log_level").agg(sketch.cardinality("resource_k8s_pod_name").alias("hll"))
        exact = logs.groupBy("log_level").agg(F.countDistinct("resource_k8s_pod_name").alias("exact"))
        merged = daily.groupBy("log_level").agg(sketch.estimate(sketch.merged("hll")).alias("estimate"))
        return merged.join(exact, "log_level").select("log_level", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))

    def events_stream(s: SparkSession, d: str) -> DataFrame:
        source = jobs.file_stream(s, d, views.events(s, d).schema, "events.parquet")
        return source.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("chq_timestamp"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("chq_tsns"), "event_id", "event_type", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("resource_service_name"))

    def sliding(s: SparkSession, d: str) -> DataFrame:
        out = temporary(s, "sliding")
        return jobs.run_to_end(jobs.sliding_counts(events_stream(s, d), 6 * HOUR, 2 * HOUR, ["event_type"]), f"{out}/data", f"{out}/checkpoint", ["chq_timestamp", "event_type"])

    def unique(s: SparkSession, d: str) -> DataFrame:
        out = temporary(s, "unique")
        jobs.run_once(jobs.deduplicated(events_stream(s, d), "event_type", "40 days").select("event_type"), f"{out}/data", f"{out}/checkpoint")
        return s.read.parquet(f"{out}/data")

    def held_back(s: SparkSession, d: str) -> DataFrame:
        out, stream = temporary(s, "waiting"), events_stream(s, d)
        jobs.accumulate(stream, out, f"{out}/checkpoint", "logs", "resource_service_name", 1 << 40, 1 << 60, at_once="event_type = 'error'")
        first = s.read.parquet(f"{out}/segments/batch=0").groupBy("event_type").agg(F.count("*").alias("at_once"))
        jobs.flush(s, out, stream.schema, "logs")
        whole = s.read.option("basePath", f"{out}/segments").parquet(f"{out}/segments/batch=0", f"{out}/segments/batch=end").groupBy("event_type").agg(F.count("*").alias("n"))
        return whole.join(first, "event_type", "left").select("event_type", "n", F.coalesce("at_once", F.lit(0)).alias("at_once"))

    def stored_stream(s: SparkSession, d: str) -> DataFrame:
        out = temporary(s, "segments")
        jobs.ingest_segments(events_stream(s, d), f"{out}/data", f"{out}/checkpoint", "logs")
        return s.read.parquet(f"{out}/data").groupBy("dateint").agg(F.count("*").alias("n"))

    def result(s: SparkSession, d: str) -> DataFrame:
        found = ingest.write_result(Engine(metrics=views.metrics(s, d)).promql("sum by (event_type) (event_value)", START, END, DAY), temporary(s, "result"))
        return s.createDataFrame([(found["rows"], found["first"], found["last"])], "rows long, first long, last long")

    def sizes(s: SparkSession, d: str) -> DataFrame:
        stats = views.logs(s, d).groupBy(F.col("resource_service_name").alias("organization")).agg((F.count("*") * 200 + 30_000).alias("bytes"), F.lit(2).alias("files"), F.count("*").alias("records"))
        return ingest.records_per_file(stats).withColumn("smooth", F.round(ingest.smoothed(F.lit(1000.0), F.col("records_per_file")), 6))

    logs_sql = "SELECT epoch_us(ts) // 1000 AS chq_timestamp, event_id, event_type, user_id, value, props FROM events"
    return {
        "store_tiers": (tiers, f"SELECT t - t % {HOUR} AS chq_timestamp, event_type, concat('pod-', user_id) AS resource_k8s_pod_name, round(sum(value), 6) AS chq_rollup_sum, count(*) AS chq_rollup_count, {HOUR} AS frequency_ms FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events) GROUP BY ALL"),
        "store_promql": (lambda s, d: _rounded(engine(s, d, "metrics").promql("sum by (event_type) (event_value)", START, END, DAY)), f"SELECT t - t % {DAY} AS bucket_ts, event_type, round(sum(value), 6) AS value FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events) GROUP BY ALL"),
        "store_log_counts": (
            lambda s, d: engine(s, d, "logs").logql('sum by (log_level) (count_over_time({resource_service_name="svc-1"}[1d]))', START, END, DAY),
            f"""WITH b AS (SELECT t - t % {DAY} AS bucket_ts, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS log_level, CAST(count(*) AS DOUBLE) AS value
  FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM events) WHERE user_id % 5 = 1 GROUP BY ALL), g AS (SELECT *, coalesce(bucket_ts - lag(bucket_ts) OVER (PARTITION BY log_level ORDER BY bucket_ts), {DAY}) AS gap FROM b)
  SELECT bucket_ts, log_level, value FROM g WHERE gap <= {DAY}""",
        ),
        "store_raw": (lambda s, d: engine(s, d, "logs").logql('{log_level="ERROR", resource_k8s_pod_name=~"pod-1.*"}', START, START + 3 * DAY, fields=("resource_k8s_pod_name",)).select("chq_id", "resource_k8s_pod_name"), f"SELECT CAST(event_id AS VARCHAR) AS chq_id, concat('pod-', user_id) AS resource_k8s_pod_name FROM ({logs_sql}) WHERE event_type = 'error' AND CAST(user_id AS VARCHAR) LIKE '1%' AND chq_timestamp < {START + 3 * DAY}"),
        "store_spans": (lambda s, d: engine(s, d, "spans").spans_query('{span_kind="server", span_status_code="ERROR"}', START, END).select("span_id"), "SELECT concat('span-', event_id) AS span_id FROM events WHERE user_id % 2 = 0 AND event_type = 'error'"),
        "store_services": (lambda s, d: engine(s, d, "logs", "spans").services(START, END), "SELECT DISTINCT concat('svc-', user_id % 5) AS tag_value FROM events"),
        "store_upkeep": (compacted, f"SELECT {_DAY_SQL} AS dateint, 1 AS files, count(*) + count(*) FILTER (event_id % 10 = 0) AS records FROM ({logs_sql}) WHERE chq_timestamp >= {START + 21 * DAY} GROUP BY ALL"),
        "compact_frequencies": (mixed, f"""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS t FROM events), f AS (SELECT 10000 AS frequency_ms, event_type, user_id, t - t % 10000 AS b, sum(value) AS v, count(*) AS c FROM e GROUP BY ALL UNION ALL
  SELECT {HOUR}, event_type, user_id, t - t % {HOUR}, sum(value), count(*) FROM e GROUP BY ALL) SELECT frequency_ms, event_type, count(*) AS n, round(sum(v), 6) AS total, CAST(sum(c) AS BIGINT) AS samples FROM f GROUP BY ALL"""),
        "series_of_all_labels": (all_labels, f"SELECT t - t % {HOUR} AS chq_timestamp, concat('z', us % 3) AS zone, concat('svc-', user_id % 5) AS resource_service_name, round(sum(value), 6) AS chq_rollup_sum, count(*) AS chq_rollup_count FROM (SELECT *, epoch_us(ts) // 1000 AS t, epoch_us(ts) AS us FROM events) GROUP BY ALL"),
        "field_detection": (detected, f"""SELECT chq_timestamp, CASE WHEN event_id % 2 = 1 THEN event_type ELSE props END AS log_message, CASE WHEN event_id % 2 = 1 THEN 'WARN' ELSE 'INFO' END AS log_level, CAST(user_id AS VARCHAR) AS resource_user_id,
  'example.com' AS resource_customer_domain, 'json.gz' AS resource_file_type FROM ({logs_sql})"""),
        "span_fingerprint_parts": (spans_of_all_kinds, """WITH s AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END AS kind, event_id % 1000 AS dur, CASE WHEN event_id % 1000 % 2 = 0 THEN concat('svc-', user_id % 5) ELSE 'unknown' END AS svc FROM events)
  SELECT concat('unknown##unknown##', svc, '##', kind, '##', CASE event_type WHEN 'click' THEN concat('kafka####t', dur % 3) WHEN 'view' THEN concat('view##pg######db', dur % 2, '##') WHEN 'signup' THEN 'GET##/u/{id}' ELSE event_type END) AS parts, count(*) AS n FROM s GROUP BY ALL"""),
        "cardinality_sketches": (cardinality, "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END AS log_level, count(DISTINCT user_id) AS exact, TRUE AS close FROM events GROUP BY ALL"),
        "stream_sliding": (sliding, f"SELECT (b + k * {2 * HOUR}) AS chq_timestamp, event_type, count(*) AS count FROM (SELECT t - t % {2 * HOUR} AS b, event_type FROM (SELECT epoch_us(ts) // 1000 AS t, event_type FROM events)), range(1, 4) r(k) GROUP BY ALL"),
        "stream_unique": (unique, "SELECT DISTINCT event_type FROM events"),
        "stream_accumulate": (held_back, "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS at_once FROM events GROUP BY ALL"),
        "stream_segments": (stored_stream, f"SELECT {_DAY_SQL} AS dateint, count(*) AS n FROM ({logs_sql}) GROUP BY ALL"),
        "result_metadata": (result, f"WITH b AS (SELECT DISTINCT t - t % {DAY} AS b, event_type FROM (SELECT epoch_us(ts) // 1000 AS t, event_type FROM events)) SELECT count(*) AS rows, min(b) AS first, max(b) AS last FROM b"),
        "records_per_file": (sizes, "WITH o AS (SELECT concat('svc-', user_id % 5) AS organization, CAST(floor(2097152 / greatest(1, count(*) * 200.0 / count(*))) AS BIGINT) AS r FROM events GROUP BY ALL) SELECT organization, r AS records_per_file, round(0.2 * r + 800, 6) AS smooth FROM o"),
        "date_hours": (lambda s, d: ingest.date_hours(s, START + 22 * HOUR + 5, START + 26 * HOUR).select("dateint", F.explode("hours").alias("hour")), "SELECT * FROM (VALUES (20240101, 22), (20240101, 23), (20240102, 0), (20240102, 1)) t(dateint, hour)"),
        "segment_names": (lambda s, d: ingest.zipped_names(ingest.segment_names(views.samples(s, d).withColumn("metric_name", F.col("event_type")).withColumn("chq_metric_type", F.when(F.col("event_type") == "error", "sum").otherwise("gauge")))), "SELECT DISTINCT event_type AS metric_name, CASE WHEN event_type = 'error' THEN 'sum' ELSE 'gauge' END AS metric_type FROM events"),
        "parquet_schema": (lambda s, d: ingest.schema_of(s, f"{d}/nation.parquet", from_data=True).select("name", "filled"), "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name, 25 AS filled"),
    }
