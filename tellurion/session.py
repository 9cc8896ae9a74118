"""The engine's facade: queries, metadata and validation over telemetry tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metadata
from .plans.pipeline import apply_selector
from .plans.planner import Planner, auto_step
from .plans.syntax import QueryError, Selector, parse_logql, parse_promql, selectors
from .sources import ingest
from .sources.store import Store


def session(app: str = "tellurion", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, adaptive execution, skew joins."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


class Engine:
    """Queries over logs, metrics and spans: DataFrames, or a `Store`, of whose files each query reads those that can matter, at the
    coarsest fitting tier. Every query method returns a lazy DataFrame."""

    def __init__(self, logs: DataFrame | None = None, metrics: DataFrame | None = None, spans: DataFrame | None = None, keep_series: bool = False, store: Store | None = None):
        self.logs, self.metrics, self.spans, self.keep_series, self.store = logs, metrics, spans, keep_series, store

    def _source(self, signal: str):
        """A signal's table, or what the planner asks a store by."""
        table = getattr(self, signal)
        return self.store.source(signal) if table is None and self.store else table

    def _rows(self, signal: str, selectors: list[Selector], start: int, end: int) -> DataFrame:
        """Rows of [start, end) that may pass any of the selectors (of stored metrics the finest tier)."""
        table = getattr(self, signal)
        if table is None and self.store:
            table = self.store.scan(signal, selectors, start, end, self.store.tiers(start, end, 1) if signal == "metrics" else None)
        return table.where((F.col("chq_timestamp") >= start) & (F.col("chq_timestamp") < end))

    def promql(self, query: str, start: int, end: int, step: int | None = None) -> DataFrame:
        """A range query in ms: (bucket_ts, labels, value)."""
        return Planner(self._source("metrics"), start, end, step or auto_step(start, end), keep_series=self.keep_series).run(parse_promql(query))

    def promql_summary(self, query: str, start: int, end: int, step: int | None = None) -> DataFrame:
        """Statistics per series over the whole range."""
        node = parse_promql(query)
        back = max((s.range_ms + max(0, s.offset_ms) for s in selectors(node)), default=0)
        ahead = max((max(0, -s.offset_ms) for s in selectors(node)), default=0)
        return metadata.summary(self._rows("metrics", selectors(node), start - back, end + ahead), node, start, end, step or auto_step(start, end), self.keep_series)

    def logql(self, query: str, start: int, end: int, step: int | None = None, limit: int = 0, reverse: bool = True, fields: tuple[str, ...] = ()) -> DataFrame:
        """Raw lines (newest first unless not `reverse`) for a selector, else a range query. `fields` restricts raw lines to their
        core columns and these."""
        node = parse_logql(query)
        if isinstance(node, Selector):
            return self._raw("logs", node, start, end, limit, reverse, fields=fields)
        return Planner(self._source("logs"), start, end, step or auto_step(start, end), logs=True, keep_series=self.keep_series).run(node)

    def spans_query(self, query: str, start: int, end: int, limit: int = 0, reverse: bool = True, fields: tuple[str, ...] = ()) -> DataFrame:
        """Spans for a selector; the body is span_name and line filters have no effect."""
        node = parse_logql(query)
        if not isinstance(node, Selector):
            raise QueryError("spans take a selector")
        return self._raw("spans", node, start, end, limit, reverse, "span_name", lines=False, fields=fields)

    def _raw(self, signal: str, node: Selector, start: int, end: int, limit: int, reverse: bool, body: str = "log_message", lines: bool = True, fields: tuple[str, ...] = ()) -> DataFrame:
        df = self._rows(signal, [node], start, end)
        if "chq_fingerprint" in df.columns:
            df = df.withColumn("chq_fingerprint", F.col("chq_fingerprint").cast("string"))
        df = apply_selector(df, node, fields, body=body, lines=lines)
        if fields:
            df = df.select(*[c for c in df.columns if c.startswith("chq_") or c in (body, "log_level", *fields)])
        order = F.desc if reverse else F.asc
        keys = [order(c) for c in ("chq_tsns", "chq_id") if c in df.columns]
        return df.orderBy(*keys).limit(limit) if limit else df.orderBy(*keys)

    def exemplar(self, query: str, start: int, end: int, limit: int = 1) -> DataFrame:
        """Example rows of a selector as (timestamp, tags): ms from chq_timestamp, else from chq_tsns; the metric's name and nulls
        are left out of the tags."""
        df = self._raw("logs", parse_logql(query), start, end, limit, True)
        times = [F.col("chq_timestamp")] if "chq_timestamp" in df.columns else []
        times += [F.floor(F.col("chq_tsns") / 1_000_000).cast("long")] if "chq_tsns" in df.columns else []
        tags = [c for c in df.columns if c not in ("chq_timestamp", "chq_tsns", "metric_name")]
        pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in tags]), lambda e: e["col2"].isNotNull()))
        return df.select(F.coalesce(*times).alias("timestamp"), pairs.alias("tags"))

    # Ingestion into the store

    def read(self, path: str, signal: str | None = None, spark: SparkSession | None = None) -> DataFrame:
        """A raw file or folder as rows of its signal (by the path unless named): read by format and translated, not stored."""
        signal = signal or ingest.signal_of(path)
        spark = spark or self.store.spark
        raw = ingest.read_file(spark, path, signal)
        if signal == "logs" and ".binpb" not in path:
            return ingest.translate_logs(raw, path, csv=path.removesuffix(".gz").endswith(".csv"))
        return ingest.translate_spans(raw, path) if signal == "spans" else raw

    def ingest(self, path: str, signal: str | None = None) -> int:
        """Store a raw file or folder; the catalog's version that has it."""
        signal = signal or ingest.signal_of(path)
        return self.store.ingest(self.read(path, signal), signal)

    def rollup(self) -> list[int]:
        return self.store.rollup()

    def compact(self, signal: str) -> int | None:
        return self.store.compact(signal)

    def tag_names(self, signal: str = "logs", query: str | None = None, start: int = 0, end: int = 1 << 62) -> DataFrame:
        return metadata.tag_names(self._scoped(signal, query, start, end))

    def tag_values(self, tag: str, signal: str = "logs", query: str | None = None, start: int = 0, end: int = 1 << 62) -> DataFrame:
        return metadata.tag_values(self._scoped(signal, query, start, end, (tag,)), tag)

    def log_series(self, matchers: list[str], start: int, end: int, field: str = "resource_service_name") -> DataFrame:
        return metadata.series(self._scoped("logs", None, start, end), field, [parse_logql(m).matchers for m in matchers])

    def metrics_metadata(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Names with the type that each first had, of the last hour unless a time is stated."""
        end = int(time.time() * 1000) if end is None else end
        start = end - 3_600_000 if start is None else start
        return metadata.metrics_metadata(self._scoped("metrics", None, start, end))

    def services(self, start: int = 0, end: int = 1 << 62) -> DataFrame:
        """Services of every signal that is there."""
        found = None
        for signal in ("logs", "metrics", "spans"):
            if getattr(self, signal) is not None or (self.store and not self.store.live().where(F.col("signal") == signal).isEmpty()):
                one = self.tag_values("resource_service_name", signal, None, start, end)
                found = one if found is None else found.unionByName(one)
        return found.distinct().orderBy("tag_value")

    def validate_promql(self, query: str, exemplar: dict | None = None) -> dict:
        return metadata.validate_promql(query, exemplar)

    def validate_logql(self, query: str, exemplar: dict | None = None, spark: SparkSession | None = None, stream: str | None = None) -> dict:
        return metadata.validate_logql(query, exemplar, spark or (self.logs.sparkSession if self.logs is not None else None), stream)

    def _scoped(self, signal: str, query: str | None, start: int, end: int, extra: tuple[str, ...] = ()) -> DataFrame:
        """Rows in the closed range [start, end], within the query's selector."""
        node = None if query is None else parse_promql(query) if signal == "metrics" else parse_logql(query)
        table = self._rows(signal, selectors(node)[:1] if node is not None else [], start, end + 1)
        if query is None:
            return table
        if signal == "metrics":
            return metadata.metric_scope(table, node)
        scope = selectors(node)[0]
        return apply_selector(table, scope, extra, "log_message" if signal == "logs" else "span_name", lines=signal == "logs")
