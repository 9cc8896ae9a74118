"""Every query of the engine on the driver's tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_storage
from .functions import sketch
from .functions.template import compile_template
from .operators import metadata
from .plans.syntax import parse_logql
from .session import Engine
from .sources import ingest, views
from .streaming import jobs

DAY, HOUR = 86_400_000, 3_600_000
START, END = 1_704_067_200_000, 1_704_067_200_000 + 31 * DAY
Query = Callable[[SparkSession, str], DataFrame]

_T = "(epoch_us(ts) // 1000)"
_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARN' ELSE 'INFO' END"
_K = "json_extract_string(props, '$.k')"
_LOGS = f"""logs AS (SELECT {_T} AS chq_timestamp, epoch_us(ts) * 1000 AS chq_tsns, CAST(event_id AS VARCHAR) AS chq_id, {_LEVEL} AS log_level,
  concat('svc-', user_id % 5) AS resource_service_name, concat('pod-', user_id) AS resource_k8s_pod_name, event_type, {_K} AS k, props,
  concat('type=', event_type, ' user=', user_id, ' dur=', {_K}, 'ms size=', {_K}, 'KiB') AS log_message, concat('user-', user_id, ' did ', event_type, ' k=', {_K}) AS access FROM events)"""
_METRICS = f"""metrics AS (SELECT {_T} - {_T} % 10000 AS chq_timestamp, 'event_value' AS metric_name, event_type, concat('svc-', user_id % 5) AS resource_service_name, concat('pod-', user_id) AS resource_k8s_pod_name,
  sum(value) AS s, count(*) AS c, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)"""
_SPANS = f"""spans AS (SELECT {_T} AS chq_timestamp, epoch_us(ts) * 1000 AS chq_tsns, CAST(event_id AS VARCHAR) AS chq_id, event_type AS span_name, CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END AS span_kind,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS span_status_code, concat('trace-', user_id) AS span_trace_id, concat('span-', event_id) AS span_id, event_id % 1000 AS span_duration, concat('svc-', user_id % 5) AS resource_service_name FROM events)"""


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded as the SQL does it: halves away from zero of the scaled double, so 55.683749999999996 is 55.6838."""
    scaled = lambda c: F.col(f"`{c}`") * 10.0**digits
    return df.withColumns({c: F.when(F.abs(scaled(c)) < float("inf"), F.round(scaled(c)) / 10.0**digits).otherwise(F.col(f"`{c}`")) for c, t in df.dtypes if t == "double"})


def _pq(query: str, step: int, start: int = START, end: int = END) -> Query:
    return lambda spark, d: _round(Engine(metrics=views.metrics(spark, d)).promql(query, start, end, step))


def _sq(query: str, step: int) -> Query:
    return lambda spark, d: _round(Engine(metrics=views.samples(spark, d)).promql(query, START, END, step))


def _lq(query: str, step: int = DAY, message: str = "logfmt", **more) -> Query:
    return lambda spark, d: _round(Engine(logs=views.logs(spark, d, message)).logql(query, START, END, step, **more))


def _raw(query: str, columns: list[str], message: str = "logfmt", limit: int = 0) -> Query:
    return lambda spark, d: Engine(logs=views.logs(spark, d, message)).logql(query, START, END, limit=limit).select(*columns)


def _leaf(labels: str, step: int, where: str = "TRUE", source: str = "metrics", back: int = 0, shift: int = 0) -> str:
    """Partials per bucket in SQL."""
    s, c, lo, hi = ("s", "c", "lo", "hi") if source == "metrics" else ("v", "1", "v", "v")
    group = f", {labels}" if labels else ""
    return f"SELECT chq_timestamp - chq_timestamp % {step} + {shift} AS bucket_ts{group}, sum({s}) AS s, sum({c}) AS c, count(*) AS n, min({lo}) AS lo, max({hi}) AS hi FROM {source} WHERE {where} AND chq_timestamp >= {START - back - shift} AND chq_timestamp < {END - shift} GROUP BY ALL"


def _range(value: str, labels: str, step: int, rng: int, where: str = "TRUE", source: str = "metrics", having: str = "") -> str:
    """The sliding-window rule in SQL: CTEs leaf, e, k and the final select."""
    names = [x.strip() for x in labels.split(",") if x.strip()]
    part = f"PARTITION BY {labels} " if labels else ""
    same = " AND ".join(["TRUE", *[f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in names]])
    pick = "".join(f", a.{n}" for n in names)
    return f"""leaf AS ({_leaf(labels, step, where, source, rng)}),
  e AS (SELECT *, greatest({step}, coalesce(bucket_ts - lag(bucket_ts) OVER ({part}ORDER BY bucket_ts), {step})) AS eff FROM leaf),
  w AS (SELECT *, max(least(bucket_ts + eff - {rng}, bucket_ts + 1)) OVER ({part}ORDER BY bucket_ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
  r AS (SELECT a.bucket_ts{pick}, a.eff, sum(b.s) AS s, sum(b.c) AS c, min(b.lo) AS lo, max(b.hi) AS hi, min(b.bucket_ts) AS first, arg_max(b.s / b.c, b.bucket_ts) AS latest, arg_max(b.s, b.bucket_ts) AS last_sum
    FROM w a JOIN w b ON {same} AND b.bucket_ts BETWEEN a.k AND a.bucket_ts GROUP BY ALL)
  SELECT bucket_ts{"".join(", " + n for n in names)}, round(CAST({value} AS DOUBLE), 6) AS value FROM r WHERE bucket_ts - first + eff >= {rng} AND bucket_ts >= {START} AND bucket_ts < {END}{having}"""


def _instant(labels: str, value: str, step: int = DAY, where: str = "TRUE") -> str:
    return f"SELECT bucket_ts{', ' + labels if labels else ''}, round(CAST({value} AS DOUBLE), 6) AS value FROM ({_leaf(labels, step, where)})"


def _count(labels: str, where: str, step: int = DAY, value: str = "count(*)", extra: str = "", source: str = "logs") -> str:
    """A log aggregate whose range is one step: only buckets whose series had no gap of more than a step before them."""
    part = f"PARTITION BY {labels} " if labels else ""
    group = f", {labels}" if labels else ""
    return f"""b AS (SELECT chq_timestamp - chq_timestamp % {step} AS bucket_ts{group}, CAST({value} AS DOUBLE) AS value{extra} FROM {source} WHERE {where} GROUP BY ALL),
  g AS (SELECT *, coalesce(bucket_ts - lag(bucket_ts) OVER ({part}ORDER BY bucket_ts), {step}) AS gap FROM b)
  SELECT bucket_ts{group}, round(value, 6) AS value FROM g WHERE gap <= {step}"""


def _temporary(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/tellurion-{name}-{uuid.uuid4().hex}"


def _stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    schema = views.events(spark, d).schema
    source = jobs.file_stream(spark, d, schema, "events.parquet")
    samples = source.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("chq_timestamp"), "event_type", "value")
    out = _temporary(spark, "stream")
    done = jobs.run_to_end(jobs.windowed_rollup(samples, HOUR, ["event_type"]), f"{out}/data", f"{out}/checkpoint", ["chq_timestamp", "event_type"])
    return _round(done.select("chq_timestamp", "event_type", "chq_rollup_sum", "chq_rollup_count", "chq_rollup_min", "chq_rollup_max"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    path = _temporary(spark, "segments")
    ingest.write_segments(views.logs(spark, d), path, "logs")
    return spark.read.parquet(path)


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    stored = _segments(spark, d)
    selector = parse_logql('{log_level="ERROR", resource_k8s_pod_name=~"pod-1.*"}')
    table = metadata.pruned_table(spark, metadata.file_catalog(stored), selector, START, START + 3 * DAY)
    source = table if table is not None else stored.limit(0)
    return Engine(logs=source).logql('{log_level="ERROR", resource_k8s_pod_name=~"pod-1.*"}', START, START + 3 * DAY).select("chq_id", "resource_k8s_pod_name")


def _promoted(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    frames = [e.where("event_id % 3 = 0").select("event_id", F.col("user_id").alias("v")), e.where("event_id % 3 = 1").select("event_id", F.col("event_type").alias("v")), e.where("event_id % 3 = 2").select("event_id", F.col("event_type").alias("w"))]
    return ingest.union_promoted(frames).select("event_id", "v", "w")


def _rows(f: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, d: _round(f(spark, d))


def _summary(query: str, source: str = "metrics") -> Query:
    return lambda spark, d: _round(Engine(metrics=getattr(views, source)(spark, d)).promql_summary(query, START, END, DAY), 4)


def _chain(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.rollup_chain(views.samples(spark, d))
    return out.select("chq_timestamp", "event_type", "resource_k8s_pod_name", "chq_rollup_sum", "chq_rollup_count", "chq_rollup_min", "chq_rollup_max", "chq_rollup_avg", "frequency_ms")


def _binding() -> dict[str, tuple[Query, str | None]]:
    m, lg, sp = f"WITH {_METRICS}, ", f"WITH {_LOGS}, ", f"WITH {_SPANS} "
    both = lambda value, join="JOIN", cond="TRUE": f"SELECT a.bucket_ts, a.event_type, round(CAST({value} AS DOUBLE), 6) AS value FROM a {join} b ON a.bucket_ts = b.bucket_ts AND a.event_type IS NOT DISTINCT FROM b.event_type WHERE {cond}"
    pair = lambda w1, w2, v1="sum(s)", v2="sum(s)": f"{m}a AS (SELECT bucket_ts, event_type, {v1} AS value FROM ({_leaf('event_type', DAY, w1)}) GROUP BY ALL), b AS (SELECT bucket_ts, event_type, {v2} AS value FROM ({_leaf('event_type', DAY, w2)}) GROUP BY ALL) "
    svc = "resource_service_name"
    q: dict[str, tuple[Query, str | None]] = {
        # metrics: steps, matchers, aggregations
        "bucket_sum": (_pq("sum by (event_type) (event_value)", HOUR), f"{m}x AS (SELECT 1) " + _instant("event_type", "s", HOUR)),
        "bucket_mean": (_pq("event_value", DAY), f"{m}x AS (SELECT 1) " + _instant("", "s / c")),
        "matchers": (_pq('sum(event_value{event_type=~"click|view", resource_service_name!="svc-1", resource_k8s_pod_name!~"pod-2.*"})', DAY), f"{m}x AS (SELECT 1) " + _instant("", "s", DAY, "event_type IN ('click', 'view') AND resource_service_name <> 'svc-1' AND NOT regexp_full_match(resource_k8s_pod_name, 'pod-2.*')")),
        "vector_sum_by": (_pq("sum by (event_type, resource_service_name) (event_value)", DAY), f"{m}x AS (SELECT 1) " + _instant(f"event_type, {svc}", "s")),
        "vector_avg_without": (_pq("avg without (resource_k8s_pod_name) (event_value)", DAY), f"{m}x AS (SELECT 1) " + _instant(f"event_type, {svc}", "s / c")),
        "vector_min": (_pq("min by (event_type) (event_value)", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "lo")),
        "vector_max": (_pq("max by (event_type) (event_value)", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "hi")),
        "vector_count": (_pq("count by (event_type) (event_value)", DAY), f"{m}{_dense_sql()}"),
        "nested_aggregate": (_pq("max(sum by (event_type) (event_value))", DAY), f"{m}l AS ({_leaf('event_type', DAY)}) SELECT bucket_ts, round(max(s), 6) AS value FROM l GROUP BY ALL"),
        "bucket_count_dense": (_pq("count(event_value)", HOUR, START, START + 3 * DAY), f"{m}l AS ({_leaf('', HOUR)}) SELECT t AS bucket_ts, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM range({START}, {START + 3 * DAY}, {HOUR}) r(t) LEFT JOIN l ON t = bucket_ts"),
        "topk_per_step": (_pq("topk(2, sum by (event_type) (event_value))", DAY), f"{m}l AS ({_leaf('event_type', DAY)}) SELECT bucket_ts, event_type, round(s, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY bucket_ts ORDER BY s DESC, event_type) <= 2"),
        "bottomk_per_step": (_pq("bottomk(2, sum by (event_type) (event_value))", DAY), f"{m}l AS ({_leaf('event_type', DAY)}) SELECT bucket_ts, event_type, round(s, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY bucket_ts ORDER BY s, event_type) <= 2"),
        # metrics: ranges
        "rate_range": (_pq("sum by (event_type) (rate(event_value[3h]))", HOUR), m + _range("s / 10800.0", "event_type", HOUR, 3 * HOUR)),
        "increase_range": (_pq("sum by (event_type) (increase(event_value[6h]))", HOUR), m + _range("s", "event_type", HOUR, 6 * HOUR)),
        "sum_over_time": (_pq("sum by (event_type) (sum_over_time(event_value[2d]))", DAY), m + _range("s", "event_type", DAY, 2 * DAY)),
        "avg_over_time": (_pq("avg by (event_type) (avg_over_time(event_value[3h]))", HOUR), m + _range("s / c", "event_type", HOUR, 3 * HOUR)),
        "count_over_time": (_pq("sum by (event_type) (count_over_time(event_value[4h]))", HOUR), m + _range("c", "event_type", HOUR, 4 * HOUR)),
        "min_over_time": (_pq("min by (event_type) (min_over_time(event_value[5h]))", HOUR), m + _range("lo", "event_type", HOUR, 5 * HOUR)),
        "max_over_time": (_pq("max by (event_type) (max_over_time(event_value[5h]))", HOUR), m + _range("hi", "event_type", HOUR, 5 * HOUR)),
        "last_over_time": (_pq("max by (event_type) (last_over_time(event_value[3h]))", HOUR), m + _range("latest", "event_type", HOUR, 3 * HOUR)),
        "irate_range": (_pq("sum by (event_type) (irate(event_value[3h]))", HOUR), m + _range("last_sum / (eff / 1000.0)", "event_type", HOUR, 3 * HOUR)),
        "sparse_range": (_pq("sum by (resource_k8s_pod_name) (increase(event_value[12h]))", HOUR), m + _range("s", "resource_k8s_pod_name", HOUR, 12 * HOUR)),
        "plain_rate": (_pq("rate(event_value)", HOUR), f"{m}l AS ({_leaf('', HOUR)}) SELECT bucket_ts, round(s / (greatest({HOUR}, coalesce(bucket_ts - lag(bucket_ts) OVER (ORDER BY bucket_ts), {HOUR})) / 1000.0), 6) AS value FROM l"),
        "offset_diff": (_pq("sum by (event_type) (event_value) - sum by (event_type) (event_value offset 1d)", DAY), f"{m}a AS ({_leaf('event_type', DAY)}), b AS ({_leaf('event_type', DAY, shift=DAY)}) SELECT a.bucket_ts, event_type, round(a.s - b.s, 6) AS value FROM a JOIN b USING (bucket_ts, event_type)"),
        # metrics: binary operators, sets, functions
        "binop_ratio": (_pq('sum by (event_type) (event_value{resource_service_name="svc-1"}) / sum by (event_type) (event_value)', DAY), pair(f"{svc} = 'svc-1'", "TRUE") + both("a.value / b.value")),
        "binop_on": (_pq("sum by (event_type, resource_service_name) (event_value) / on (event_type) sum by (event_type) (event_value)", DAY), f"{m}a AS ({_leaf(f'event_type, {svc}', DAY)}), b AS ({_leaf('event_type', DAY)}) SELECT a.bucket_ts, event_type, {svc}, round(a.s / b.s, 6) AS value FROM a JOIN b USING (bucket_ts, event_type)"),
        "binop_ignoring": (_pq("sum by (event_type, resource_service_name) (event_value) - ignoring (resource_service_name) sum by (event_type) (event_value)", DAY), f"{m}a AS ({_leaf(f'event_type, {svc}', DAY)}), b AS ({_leaf('event_type', DAY)}) SELECT a.bucket_ts, event_type, {svc}, round(a.s - b.s, 6) AS value FROM a JOIN b USING (bucket_ts, event_type)"),
        "binop_scalar": (_pq("sum by (event_type) (event_value) * 2 + 1", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "s * 2 + 1")),
        "divide_by_zero": (_pq("sum by (event_type) (event_value) / 0", DAY), f"{m}l AS ({_leaf('event_type', DAY)}) SELECT bucket_ts, event_type, s AS value FROM l WHERE FALSE"),
        "cmp_filter": (_pq("sum by (event_type) (event_value) > 300", DAY), f"{m}l AS ({_leaf('event_type', DAY)}) SELECT bucket_ts, event_type, round(s, 6) AS value FROM l WHERE s > 300"),
        "cmp_bool": (_pq("sum by (event_type) (event_value) >= bool 300", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "CASE WHEN s >= 300 THEN 1 ELSE 0 END")),
        "cmp_vectors": (_pq('sum by (event_type) (event_value{resource_service_name="svc-1"}) > sum by (event_type) (event_value{resource_service_name="svc-2"})', DAY), pair(f"{svc} = 'svc-1'", f"{svc} = 'svc-2'") + both("a.value", cond="a.value > b.value")),
        "set_and": (_pq('sum by (event_type) (event_value) and sum by (event_type) (event_value{resource_service_name="svc-1"})', DAY), pair("TRUE", f"{svc} = 'svc-1'") + both("a.value", "SEMI JOIN")),
        "set_unless": (_pq('sum by (event_type) (event_value) unless sum by (event_type) (event_value{resource_k8s_pod_name=~"pod-1.?"})', DAY), pair("TRUE", "regexp_full_match(resource_k8s_pod_name, 'pod-1.?')") + both("a.value", "ANTI JOIN")),
        "set_or": (_pq('sum by (event_type) (event_value{resource_service_name="svc-1"}) or sum by (event_type) (event_value)', DAY), pair(f"{svc} = 'svc-1'", "TRUE") + "SELECT bucket_ts, event_type, round(value, 6) AS value FROM (SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a ON a.bucket_ts = b.bucket_ts AND a.event_type = b.event_type)"),
        "clamp": (_pq("clamp_max(clamp_min(sum by (event_type) (event_value), 100), 500)", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "least(greatest(s, 100), 500)")),
        "unary_math": (_pq("sqrt(abs(ceil(sum by (event_type) (event_value)) - 200)) + log2(sum by (event_type) (event_value)) - sgn(floor(sum by (event_type) (event_value)) - 300)", DAY), f"{m}x AS (SELECT 1) " + _instant("event_type", "sqrt(abs(ceil(s) - 200)) + log2(s) - sign(floor(s) - 300)")),
        "scalar_of": (_pq("sum by (event_type) (event_value) / scalar(sum(event_value))", DAY), f"{m}a AS ({_leaf('event_type', DAY)}), b AS ({_leaf('', DAY)}) SELECT bucket_ts, event_type, round(a.s / b.s, 6) AS value FROM a JOIN b USING (bucket_ts)"),
        # sketches and summaries
        "histogram_quantile": (_sq("histogram_quantile(0.9, sum by (event_type) (event_value))", DAY), _quantile_sql(0.9, DAY, "event_type")),
        "quantile_over_time": (_sq("quantile_over_time(0.5, event_value[1d])", DAY), _quantile_sql(0.5, DAY, "")),
        "summary_stats": (_summary("sum by (event_type) (event_value)"), f"WITH {_METRICS} SELECT event_type, CAST(sum(c) AS BIGINT) AS count, round(sum(s), 4) AS sum, round(min(lo), 4) AS min, round(max(hi), 4) AS max, round(sum(s) / sum(c), 4) AS avg FROM metrics GROUP BY ALL"),
        "summary_filter": (_summary("max by (resource_k8s_pod_name) (event_value) > 150"), f"WITH {_METRICS} SELECT resource_k8s_pod_name, CAST(sum(c) AS BIGINT) AS count, round(sum(s), 4) AS sum, round(min(lo), 4) AS min, round(max(hi), 4) AS max, round(sum(s) / sum(c), 4) AS avg FROM metrics GROUP BY ALL HAVING max(hi) > 150"),
        "summary_percentiles": (_summary("sum by (event_type) (event_value)", "samples"), _percentile_sql()),
        "approx_pods": (_rows(lambda s, d: views.logs(s, d).groupBy("log_level").agg(F.approx_count_distinct("resource_k8s_pod_name").alias("pods"))), None),
        # log aggregates
        "log_count_by_level": (_lq("sum by (log_level) (count_over_time({resource_service_name=~\"svc-.*\"}[1d]))"), lg + _count("log_level", "TRUE")),
        "log_rate": (_lq("sum by (log_level) (rate({log_level=\"ERROR\"}[1d]))"), lg + _count("log_level", "log_level = 'ERROR'", value="count(*) / 86400.0")),
        "log_count_sliding": (_lq("sum by (log_level) (count_over_time({resource_service_name=\"svc-1\"}[6h]))", HOUR), f"WITH {_LOGS}, lines AS (SELECT *, 1 AS v FROM logs), " + _range("s", "log_level", HOUR, 6 * HOUR, "resource_service_name = 'svc-1'", "lines")),
        "bytes_over_time": (_lq("sum by (log_level) (bytes_over_time({resource_service_name=\"svc-2\"}[1d]))"), lg + _count("log_level", "resource_service_name = 'svc-2'", value="sum(length(log_message))")),
        "bytes_rate": (_lq("sum(bytes_rate({resource_service_name=\"svc-2\"}[1d]))"), lg + _count("", "resource_service_name = 'svc-2'", value="sum(length(log_message)) / 86400.0")),
        "line_contains": (_lq("sum by (resource_service_name) (count_over_time({log_level=\"INFO\"} |= \"type=click\" != \"user=1 \" [1d]))"), lg + _count(svc, "log_level = 'INFO' AND contains(log_message, 'type=click') AND NOT contains(log_message, 'user=1 ')")),
        "line_regex": (_lq("sum(count_over_time({log_level=~\"INFO|WARN\"} |~ \"user=1[0-9]+ \" !~ \"type=(view|signup)\" [1d]))"), lg + _count("", "log_level IN ('INFO', 'WARN') AND regexp_matches(log_message, 'user=1[0-9]+ ') AND NOT regexp_matches(log_message, 'type=(view|signup)')")),
        "json_filter": (_lq("sum by (log_level) (count_over_time({resource_service_name=~\"svc-[0-3]\"} | json | k >= 50 [1d]))", message="json"), lg + _count("log_level", "regexp_matches(resource_service_name, 'svc-[0-3]') AND TRY_CAST(k AS DOUBLE) >= 50")),
        "json_mapped": (_raw('{log_level="ERROR"} | json kk="k" | kk=~"^9.$"', ["chq_id", "kk"], "json"), f"WITH {_LOGS} SELECT chq_id, k AS kk FROM logs WHERE log_level = 'ERROR' AND regexp_matches(k, '^9.$')"),
        "logfmt_filter": (_lq("sum by (type) (count_over_time({log_level=~\".+\"} | logfmt | user=\"7\" or user=\"8\" [1d]))"), f"WITH {_LOGS}, typed AS (SELECT *, event_type AS type FROM logs), " + _count("type", "regexp_extract(log_message, '(?:^|\\s)user=([^\\s]+)', 1) IN ('7', '8')", source="typed")),
        "regexp_extract": (_lq("sum by (what) (count_over_time({log_level=~\".+\"} | regexp \"user-(?P<who>\\\\d+) did (?P<what>\\\\w+)\" | what != \"view\" [1d]))", message="access"), f"WITH {_LOGS}, typed AS (SELECT *, event_type AS what FROM logs), " + _count("what", "what <> 'view'", source="typed")),
        "label_format_if": (_lq("sum by (size) (count_over_time({log_level=~\".+\"} | logfmt | label_format size=`{{ if hasPrefix \"9\" .dur }}big{{ else }}{{ .type | upper }}{{ end }}` [1d]))"), f"WITH {_LOGS}, typed AS (SELECT *, CASE WHEN starts_with(concat(k, 'ms'), '9') THEN 'big' ELSE upper(event_type) END AS sized FROM logs), " + _count("sized", "TRUE", source="typed").replace("SELECT bucket_ts, sized", "SELECT bucket_ts, sized AS size")),
        "line_format": (_raw('{log_level="WARN"} | logfmt | line_format "{{ .type }}:{{ .user | len }}" |= ":2"', ["chq_id", "log_message"]), f"WITH {_LOGS}, f AS (SELECT chq_id, concat(event_type, ':', length(regexp_extract(log_message, '(?:^|\\s)user=([^\\s]+)', 1))) AS log_message FROM logs WHERE log_level = 'WARN') SELECT * FROM f WHERE contains(log_message, ':2')"),
        "template_functions": (_templates, f"WITH {_LOGS} SELECT chq_id, concat('<', upper(log_level), '|', length(log_message), '|', CASE WHEN contains(log_message, 'click') THEN 'yes' ELSE '' END, '>') AS text FROM logs"),
        "unwrap_avg": (_lq("avg by (log_level) (avg_over_time({log_level=~\".+\"} | json | unwrap k [1d]))", message="json"), lg + _count("log_level", "k IS NOT NULL", value="sum(CAST(k AS DOUBLE)) / count(*)")),
        "unwrap_max": (_lq("max by (log_level) (max_over_time({log_level=~\".+\"} | json | unwrap k [1d]))", message="json"), lg + _count("log_level", "k IS NOT NULL", value="max(CAST(k AS DOUBLE))")),
        "unwrap_duration": (_lq("sum by (log_level) (sum_over_time({log_level=~\".+\"} | logfmt | unwrap duration(dur) [1d]))"), lg + _count("log_level", "k IS NOT NULL", value="sum(CAST(k AS DOUBLE) / 1000)")),
        "unwrap_bytes": (_lq("sum by (log_level) (min_over_time({log_level=~\".+\"} | logfmt | unwrap bytes(size) [1d]))"), lg + _count("log_level", "k IS NOT NULL", value="min(CAST(k AS DOUBLE) * 1024)")),
        "unwrap_rate_counter": (_lq("sum(rate_counter({log_level=~\".+\"} | json | unwrap k [1d]))", message="json"), lg + _count("", "k IS NOT NULL", value="sum(CAST(k AS DOUBLE)) / 86400")),
        "log_topk": (_lq("topk(1, sum by (log_level) (count_over_time({log_level=~\".+\"}[1d])))"), f"WITH {_LOGS}, c AS (WITH {_count('log_level', 'TRUE')}) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY bucket_ts ORDER BY value DESC, log_level) <= 1"),
        "log_error_ratio": (_lq("sum(count_over_time({log_level=\"ERROR\"}[1d])) / sum(count_over_time({log_level=~\".+\"}[1d]))"), f"WITH {_LOGS}, a AS (WITH {_count('', chr(39).join(['log_level = ', 'ERROR', '']))}), b AS (WITH {_count('', 'TRUE')}) SELECT bucket_ts, round(a.value / b.value, 6) AS value FROM a JOIN b USING (bucket_ts)"),
        # raw rows
        "raw_logs_limit": (_raw('{log_level="ERROR"} |= "user="', ["chq_tsns", "chq_id", "log_message"], limit=50), f"WITH {_LOGS} SELECT chq_tsns, chq_id, log_message FROM logs WHERE log_level = 'ERROR' AND contains(log_message, 'user=') ORDER BY chq_tsns DESC, chq_id DESC LIMIT 50"),
        "spans_filter": (lambda s, d: Engine(spans=views.spans(s, d)).spans_query('{span_kind="server", span_status_code="ERROR"} | span_duration > 500', START, END).select("span_id", "span_trace_id", "span_duration"), f"{sp}SELECT span_id, span_trace_id, span_duration FROM spans WHERE span_kind = 'server' AND span_status_code = 'ERROR' AND span_duration > 500"),
        # metadata
        "tag_values": (lambda s, d: Engine(logs=views.logs(s, d)).tag_values("resource_k8s_pod_name", "logs", '{log_level="ERROR"}'), f"WITH {_LOGS} SELECT DISTINCT resource_k8s_pod_name AS tag_value FROM logs WHERE log_level = 'ERROR'"),
        "tag_values_parsed": (lambda s, d: Engine(logs=views.logs(s, d)).tag_values("type", "logs", '{log_level=~".+"} | logfmt'), "SELECT DISTINCT event_type AS tag_value FROM events"),
        "tag_names": (lambda s, d: Engine(metrics=views.metrics(s, d)).tag_names("metrics"), "SELECT unnest(['chq_timestamp', 'metric_name', 'event_type', 'resource_service_name', 'resource_k8s_pod_name', 'chq_rollup_sum', 'chq_rollup_count', 'chq_rollup_min', 'chq_rollup_max']) AS tag_name"),
        "series": (lambda s, d: Engine(logs=views.logs(s, d)).log_series(['{resource_service_name=~"svc-[12]"}', '{resource_service_name="svc-4"}'], START, END), f"WITH {_LOGS} SELECT resource_service_name AS stream, count(*) AS lines FROM logs WHERE resource_service_name IN ('svc-1', 'svc-2', 'svc-4') GROUP BY ALL"),
        "metrics_metadata": (lambda s, d: Engine(metrics=views.metrics(s, d)).metrics_metadata(0, END), f"WITH {_METRICS} SELECT metric_name, 'gauge' AS metric_type, min(chq_timestamp) AS first_ts, max(chq_timestamp) AS last_ts FROM metrics GROUP BY ALL"),
        "services": (lambda s, d: Engine(logs=views.logs(s, d)).services(), f"WITH {_LOGS} SELECT DISTINCT resource_service_name AS tag_value FROM logs"),
        # ingestion
        "rollup_10s": (_rows(lambda s, d: ingest.rollup(views.samples(s, d), 10_000, True).select("chq_timestamp", "event_type", "resource_k8s_pod_name", "chq_rollup_sum", "chq_rollup_count", "chq_rollup_min", "chq_rollup_max")), f"WITH {_METRICS} SELECT chq_timestamp, event_type, resource_k8s_pod_name, round(s, 6) AS chq_rollup_sum, c AS chq_rollup_count, round(lo, 6) AS chq_rollup_min, round(hi, 6) AS chq_rollup_max FROM metrics"),
        "rollup_chain": (_rows(_chain), f"SELECT {_T} - {_T} % {HOUR} AS chq_timestamp, event_type, concat('pod-', user_id) AS resource_k8s_pod_name, round(sum(value), 6) AS chq_rollup_sum, count(*) AS chq_rollup_count, round(min(value), 6) AS chq_rollup_min, round(max(value), 6) AS chq_rollup_max, round(avg(value), 6) AS chq_rollup_avg, {HOUR} AS frequency_ms FROM events GROUP BY ALL"),
        "log_agg_10s": (lambda s, d: ingest.log_counts(views.logs(s, d)), f"WITH {_LOGS} SELECT chq_timestamp - chq_timestamp % 10000 AS bucket_ts, log_level, resource_service_name, count(*) AS count, 10000 AS frequency FROM logs GROUP BY ALL"),
        "agg_rebucket": (lambda s, d: ingest.rebucket_counts(ingest.log_counts(views.logs(s, d)), DAY, ["log_level"]), f"WITH {_LOGS} SELECT chq_timestamp - chq_timestamp % {DAY} AS bucket_ts, log_level, CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY ALL"),
        "compact_sorted": (lambda s, d: ingest.compact([views.logs(s, d).where("chq_id % 2 = 0"), views.logs(s, d).where("chq_id % 2 = 1").withColumn("extra", F.lit("x"))], "logs").select("chq_id", "log_message", "extra"), f"WITH {_LOGS} SELECT chq_id, log_message, CASE WHEN CAST(chq_id AS BIGINT) % 2 = 1 THEN 'x' END AS extra FROM logs"),
        "segments_write_read": (lambda s, d: _segments(s, d).select("chq_id", "log_level", "dateint", "hour"), f"WITH {_LOGS} SELECT chq_id, log_level, CAST(strftime(make_timestamp(chq_timestamp * 1000), '%Y%m%d') AS INTEGER) AS dateint, CAST(date_part('hour', make_timestamp(chq_timestamp * 1000)) AS INTEGER) AS hour FROM logs"),
        "segment_stats": (lambda s, d: ingest.segment_stats(views.logs(s, d)), f"WITH {_LOGS} SELECT CAST(strftime(make_timestamp(chq_timestamp * 1000), '%Y%m%d') AS INTEGER) AS dateint, count(*) AS records, min(chq_timestamp) AS first_ts, max(chq_timestamp) AS last_ts, count(DISTINCT resource_service_name) AS streams FROM logs GROUP BY ALL"),
        "retention": (lambda s, d: ingest.retained(views.logs(s, d), START + 29 * DAY, 7).select("chq_id"), f"WITH {_LOGS} SELECT chq_id FROM logs WHERE chq_timestamp >= {START + 21 * DAY}"),
        "fingerprint_prune": (_pruned, f"WITH {_LOGS} SELECT chq_id, resource_k8s_pod_name FROM logs WHERE log_level = 'ERROR' AND regexp_matches(resource_k8s_pod_name, 'pod-1.*') AND chq_timestamp < {START + 3 * DAY}"),
        "trigram_set": (lambda s, d: views.logs(s, d).select("resource_k8s_pod_name").distinct().select("resource_k8s_pod_name", F.explode(metadata.trigrams(F.col("resource_k8s_pod_name"))).alias("trigram")), f"WITH {_LOGS} SELECT DISTINCT resource_k8s_pod_name, substr(resource_k8s_pod_name, i, 3) AS trigram FROM (SELECT DISTINCT resource_k8s_pod_name FROM logs), range(1, 40) r(i) WHERE i <= length(resource_k8s_pod_name) - 2"),
        "type_promotion": (_promoted, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type END AS v, CASE WHEN event_id % 3 = 2 THEN event_type END AS w FROM events"),
        "log_translation": (lambda s, d: ingest.translate_logs(views.events(s, d).select(F.col("ts").alias("Timestamp"), F.col("event_type").alias("level"), F.col("props").alias("msg"), F.col("user_id").alias("User.Id"))).select("chq_timestamp", "log_message", "log_level", "resource_user_id"), f"SELECT {_T} AS chq_timestamp, props AS log_message, upper(event_type) AS log_level, CAST(user_id AS VARCHAR) AS resource_user_id FROM events"),
        "stream_rollup": (_stream_rollup, f"SELECT {_T} - {_T} % {HOUR} AS chq_timestamp, event_type, round(sum(value), 6) AS chq_rollup_sum, count(value) AS chq_rollup_count, round(min(value), 6) AS chq_rollup_min, round(max(value), 6) AS chq_rollup_max FROM events GROUP BY ALL"),
        "message_templates": (_message_templates, "SELECT concat('user-<number> did ', event_type, ' k <number>') AS template, count(*) AS n FROM events GROUP BY ALL"),
        "span_fingerprints": (_span_groups, "SELECT count(DISTINCT (user_id % 5, user_id % 2, event_type)) AS n FROM events"),
    }
    return q | _faults() | catalog_storage.queries(_temporary)


def _faults() -> dict[str, tuple[Query, str | None]]:
    """Queries at the edges of matchers and quantiles."""
    lg = f"WITH {_LOGS} "
    rng, step = 3 * DAY, DAY
    quantile = f"""WITH {_METRICS}, samples AS (SELECT {_T} AS chq_timestamp, event_type, value AS v FROM events), leaf AS ({_leaf('event_type', step, source='samples', back=rng)}),
  e AS (SELECT *, greatest({step}, coalesce(bucket_ts - lag(bucket_ts) OVER (PARTITION BY event_type ORDER BY bucket_ts), {step})) AS eff FROM leaf),
  w AS (SELECT *, max(least(bucket_ts + eff - {rng}, bucket_ts + 1)) OVER (PARTITION BY event_type ORDER BY bucket_ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
  r AS (SELECT a.bucket_ts, a.event_type, a.k FROM w a JOIN w b ON a.event_type = b.event_type AND b.bucket_ts BETWEEN a.k AND a.bucket_ts GROUP BY a.bucket_ts, a.event_type, a.k, a.eff HAVING a.bucket_ts - min(b.bucket_ts) + a.eff >= {rng}),
  n AS (SELECT r.bucket_ts, r.event_type, {_bin_sql('v')} AS bin, count(*) AS n FROM r JOIN samples s ON r.event_type = s.event_type AND s.chq_timestamp - s.chq_timestamp % {step} BETWEEN r.k AND r.bucket_ts GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY bucket_ts, event_type ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY bucket_ts, event_type) AS total FROM n)
  SELECT bucket_ts, event_type, round(min(CASE WHEN upto > 0.9 * (total - 1) THEN pow({sketch.GAMMA!r}, bin) * {2 / (sketch.GAMMA + 1)!r} END), 6) AS value FROM c WHERE bucket_ts >= {START} AND bucket_ts < {END} GROUP BY ALL"""
    dropped = _lq('sum by (type) (count_over_time({log_level=~".+"} | logfmt | drop resource_k8s_pod_name | keep type, user | user="7" [1d]))')
    return {
        "parsed_label_matcher": (_raw('{resource_service_name="svc-1", kind=~"click|view"} | logfmt kind="type"', ["chq_id", "kind"]), f"{lg}SELECT chq_id, event_type AS kind FROM logs WHERE resource_service_name = 'svc-1' AND event_type IN ('click', 'view')"),
        "quantile_over_range": (_sq("quantile_over_time(0.9, sum by (event_type) (event_value[3d]))", DAY), quantile),
        "quantile_of_rate": (_sq("histogram_quantile(0.9, sum by (event_type) (rate(event_value[3d])))", DAY), quantile),
        "quantile_absent_label": (_sq('histogram_quantile(0.5, sum by (event_type) (event_value{zone="x"}))', DAY), "SELECT 0::BIGINT AS bucket_ts, '' AS event_type, 0::DOUBLE AS value FROM events WHERE FALSE"),
        "keep_and_drop": (dropped, f"WITH {_LOGS}, typed AS (SELECT *, event_type AS type FROM logs), " + _count("type", "regexp_extract(log_message, '(?:^|\\s)user=([^\\s]+)', 1) = '7'", source="typed")),
        "tag_names_logs": (lambda s, d: Engine(logs=views.logs(s, d)).tag_names("logs", '{log_level="WARN"}'), "SELECT unnest(['chq_timestamp', 'chq_tsns', 'chq_id', 'log_level', 'resource_service_name', 'resource_k8s_pod_name', 'log_message']) AS tag_name"),
        "tag_values_spans": (lambda s, d: Engine(spans=views.spans(s, d)).tag_values("span_name", "spans", '{span_kind="client"}'), "SELECT DISTINCT event_type AS tag_value FROM events WHERE user_id % 2 = 1"),
        "exponentials": (_pq("exp(log10(sum by (event_type) (event_value))) + ln(sum by (event_type) (event_value))", DAY), f"WITH {_METRICS}, x AS (SELECT 1) " + _instant("event_type", "exp(log10(s)) + ln(s)")),
    }


def _dense_sql() -> str:
    return f"l AS ({_leaf('event_type', DAY)}), g AS (SELECT t AS bucket_ts, event_type FROM range({START}, {END}, {DAY}) r(t), (SELECT DISTINCT event_type FROM l)) SELECT g.bucket_ts, g.event_type, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM g LEFT JOIN l USING (bucket_ts, event_type)"


def _templates(spark: SparkSession, d: str) -> DataFrame:
    text = compile_template('<{{ .log_level | upper }}|{{ len .log_message }}|{{ if contains "click" .log_message }}yes{{ end }}>', F.col)
    return views.logs(spark, d).select("chq_id", text.alias("text"))


def _message_templates(spark: SparkSession, d: str) -> DataFrame:
    from .functions.identity import message_template

    return views.logs(spark, d, "access").groupBy(message_template(F.col("log_message")).alias("template")).agg(F.count("*").alias("n"))


def _span_groups(spark: SparkSession, d: str) -> DataFrame:
    from .functions.identity import span_fingerprint

    df = views.spans(spark, d)
    return df.select(span_fingerprint(df).alias("f")).agg(F.countDistinct("f").alias("n"))


def _bin_sql(value: str) -> str:
    return f"CAST(ceil(ln({value}) / {sketch.log(sketch.GAMMA)!r}) AS INTEGER)"


def _quantile_sql(q: float, step: int, labels: str) -> str:
    group = f", {labels}" if labels else ""
    return f"""WITH b AS (SELECT {_T} - {_T} % {step} AS bucket_ts{group}, {_bin_sql('value')} AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY bucket_ts{group} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY bucket_ts{group}) AS total FROM b)
  SELECT bucket_ts{group}, round(min(CASE WHEN upto > {q} * (total - 1) THEN pow({sketch.GAMMA!r}, bin) * {2 / (sketch.GAMMA + 1)!r} END), 6) AS value FROM r GROUP BY ALL"""


def _percentile_sql() -> str:
    picks = ", ".join(f"round(min(CASE WHEN upto > {q} * (total - 1) THEN pow({sketch.GAMMA!r}, bin) * {2 / (sketch.GAMMA + 1)!r} END), 4) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return f"""WITH b AS (SELECT event_type, {_bin_sql('value')} AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b), p AS (SELECT event_type, {picks} FROM r GROUP BY ALL),
  s AS (SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS avg FROM events GROUP BY ALL) SELECT s.*, p50, p90, p95, p99 FROM s JOIN p USING (event_type)"""


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _binding().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _binding().items() if sql}
