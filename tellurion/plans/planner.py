"""From parsed queries to lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketch
from ..operators import vectors as V
from ..operators.vectors import Vector
from ..sources.views import label_columns
from .pipeline import UNWRAPPED, apply_selector, matcher_column
from .syntax import Aggregate, Binary, Call, Number, QueryError, Selector

#: The column of line counts in tables that a store keeps beside the lines.
COUNTS = "chq_lines"
RANGE_FUNCTIONS = ("rate", "irate", "increase", "sum_over_time", "avg_over_time", "count_over_time", "min_over_time", "max_over_time", "last_over_time")
LOG_FUNCTIONS = {"count_over_time": "sum_over_time", "rate": "rate", "bytes_over_time": "sum_over_time", "bytes_rate": "rate", "rate_counter": "rate", "sum_over_time": "sum_over_time", "avg_over_time": "avg_over_time", "min_over_time": "min_over_time", "max_over_time": "max_over_time", "last_over_time": "last_over_time"}
UNWRAP_FUNCTIONS = ("rate_counter", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "last_over_time")


def auto_step(start: int, end: int) -> int:
    """Step in ms by the length of the query: 10 s up to 65 minutes, then 1 m, 5 m, 20 m, 1 h."""
    span = end - start
    for limit, step in ((65 * 60_000, 10_000), (12 * 3_600_000, 60_000), (86_400_000, 300_000), (3 * 86_400_000, 1_200_000)):
        if span <= limit:
            return step
    return 3_600_000


@dataclass
class Planner:
    """Plans one query over [start, end) in ms. Equal leaves share one DataFrame."""

    table: DataFrame | Callable[..., DataFrame]
    start: int
    end: int
    step: int
    logs: bool = False
    keep_series: bool = False
    body: str = "log_message"
    _leaves: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession if isinstance(self.table, DataFrame) else SparkSession.active()

    def vector(self, node) -> Vector:
        out = self.plan(node, None)
        if isinstance(out, float):
            steps = self.spark.range(self.start - self.start % self.step, self.end, self.step)
            return Vector(steps.select(F.col("id").alias("bucket_ts"), F.lit(out).alias("value")), [])
        if isinstance(out, DataFrame):
            return Vector(out, [])
        return out.valued()

    def run(self, node) -> DataFrame:
        """(bucket_ts, labels, value) of the steps in [start, end), in their order; NaN results are left out."""
        v = self.vector(node)
        return v.df.where((F.col("bucket_ts") >= self.start - self.start % self.step) & (F.col("bucket_ts") < self.end) & ~F.isnan("value")).select("bucket_ts", *v.labels, "value").orderBy("bucket_ts")

    def plan(self, node, by: tuple[str, ...] | None, without: tuple[str, ...] | None = None):
        """A Vector, a float, or a (bucket_ts, value) table of scalars. `by` are the labels that the expression above groups by."""
        if isinstance(node, Number):
            return node.value
        if isinstance(node, Selector):
            if self.logs:
                raise QueryError("a log selector needs a range function here")
            return self._metric_leaf(node, by, without)
        if isinstance(node, Aggregate):
            return self._aggregate(node, by, without)
        if isinstance(node, Call):
            return self._call(node, by, without)
        if isinstance(node, Binary):
            return self._binary(node, by, without)
        raise QueryError(f"cannot plan {node!r}")

    def _labels(self, df: DataFrame, by, without) -> list[str]:
        have = label_columns(df)
        if without is not None:
            return [c for c in have if c not in without]
        if by is None:
            return have if self.keep_series else []
        return [c for c in by if c in df.columns]

    def _scan(self, s: Selector, by=(), counts: bool = False) -> DataFrame:
        """Rows of the time that a selector needs: of the table, or of what a store picks for the selector and step."""
        lo, hi = self.start - s.offset_ms - s.range_ms, self.end - s.offset_ms
        table = self.table if isinstance(self.table, DataFrame) else self.table(s, lo, hi, self.step, by, counts)
        return table.where((F.col("chq_timestamp") >= lo) & (F.col("chq_timestamp") < hi))

    def _metrics(self, s: Selector) -> DataFrame:
        """Stored rows of a metric that pass the matchers; a matcher on a label that no row has leaves none."""
        df = self._scan(s)
        if s.metric is not None:
            df = df.where(F.col("metric_name") == s.metric)
        for m in s.matchers:
            df = df.where(matcher_column(m) if m.label in df.columns else F.lit(False))
        return df

    def _metric_leaf(self, s: Selector, by, without) -> Vector:
        key = (s, by, without)
        if key not in self._leaves:
            df = self._metrics(s)
            leaf = V.step_partials(df, self.step, self._labels(df, by, without), F.col("chq_rollup_sum"), F.col("chq_rollup_count"), F.col("chq_rollup_min"), F.col("chq_rollup_max"))
            self._leaves[key] = self._shifted(leaf, s)
        return self._leaves[key]

    def _shifted(self, leaf: Vector, s: Selector) -> Vector:
        return Vector(leaf.df.withColumn("bucket_ts", F.col("bucket_ts") + s.offset_ms), leaf.labels, raw=True) if s.offset_ms else leaf

    def _log_leaf(self, func: str, s: Selector, by, without) -> Vector:
        key = (func in UNWRAP_FUNCTIONS, func.startswith("bytes"), s, by, without)
        if key not in self._leaves:
            counted = func in ("count_over_time", "rate") and not s.stages and without is None and not self.keep_series and not isinstance(self.table, DataFrame)
            df = apply_selector(self._scan(s, tuple(by or ()), counted), s, tuple(by or ()), self.body)
            if counted and COUNTS in df.columns:
                self._leaves[key] = self._shifted(V.step_partials(df, self.step, self._labels(df.drop(COUNTS), by, without), F.col(COUNTS), F.col(COUNTS), F.col(COUNTS), F.col(COUNTS)), s)
                return self._leaves[key]
            if func in UNWRAP_FUNCTIONS:
                if UNWRAPPED not in df.columns:
                    raise QueryError(f"{func} needs unwrap")
                df = df.where(F.col(UNWRAPPED).isNotNull())
                one = F.col(UNWRAPPED)
            else:
                one = F.length(F.coalesce(F.col(self.body), F.lit(""))) if func.startswith("bytes") else F.lit(1)
            labels = [c for c in self._labels(df, by, without) if c != UNWRAPPED]
            self._leaves[key] = self._shifted(V.step_partials(df, self.step, labels, one, F.lit(1), one, one), s)
        return self._leaves[key]

    def _aggregate(self, node: Aggregate, by, without) -> Vector:
        if node.op in ("topk", "bottomk"):
            return V.ranked(self._need_vector(self.plan(node.expr, by, without)), int(node.param), node.op == "topk")
        inner_by, inner_without = node.by, node.without
        if inner_by is None and inner_without is None:
            inner_by = ()
        inner = self._need_vector(self.plan(node.expr, inner_by, inner_without))
        if node.op == "count" and inner.raw:
            inner = V.dense(inner, self.start, self.end, self.step)
        return V.aggregate(inner, node.op, list(node.by) if node.by is not None else None, list(node.without) if node.without is not None else None)

    def _need_vector(self, value) -> Vector:
        if not isinstance(value, Vector):
            raise QueryError("expected a vector, found a number")
        return value

    def _call(self, node: Call, by, without):
        func, args = node.func, node.args
        if func in ("histogram_quantile", "quantile_over_time"):
            if len(args) != 2 or not isinstance(args[0], Number):
                raise QueryError(f"{func} takes a number and a vector")
            return self._quantile(func, args[0].value, args[1], by if not node.by else node.by, without)
        if func in ("clamp_min", "clamp_max"):
            if len(args) != 2 or not isinstance(args[1], Number):
                raise QueryError(f"{func} takes a vector and a number")
            return V.clamp(self._need_vector(self.plan(args[0], by, without)), func, args[1].value)
        if len(args) != 1:
            raise QueryError(f"unsupported function {func} with {len(args)} arguments")
        arg = args[0]
        if func in V.UNARY:
            return V.unary(self._need_vector(self.plan(arg, by, without)), func)
        if func == "scalar":
            inner = self.plan(arg, by, without)
            return inner if not isinstance(inner, Vector) else V.scalar_of(inner)
        if not isinstance(arg, Selector):
            raise QueryError(f"unsupported function {func}")
        if self.logs:
            if func not in LOG_FUNCTIONS:
                raise QueryError(f"unsupported function {func}")
            if not arg.range_ms:
                raise QueryError(f"{func} needs a range")
            leaf = self._log_leaf(func, arg, node.by or by, without)
            return V.range_function(leaf, LOG_FUNCTIONS[func], arg.range_ms, self.step)
        if func not in RANGE_FUNCTIONS:
            raise QueryError(f"unsupported function {func}")
        leaf = self._metric_leaf(arg, by, without)
        if not arg.range_ms:
            if func in ("rate", "irate"):
                return V.plain_rate(leaf, self.step)
            raise QueryError(f"{func} needs a range")
        return V.range_function(leaf, func, arg.range_ms, self.step)

    def _quantile(self, func: str, q: float, arg, by, without) -> Vector:
        """Quantiles of the samples' sketches per step (histogram_quantile), or over the range before it where the selector has
        one. Aggregations merge sketches; rate, increase and sum_over_time of sketches are their sums, whose quantiles are the
        same; anything else around the selector is refused."""
        inner, labels_by = arg, by
        while isinstance(inner, (Aggregate, Call)):
            if isinstance(inner, Aggregate) and inner.op == "sum":
                labels_by, without = inner.by if inner.by is not None else (() if inner.without is None else None), inner.without
                inner = inner.expr
            elif isinstance(inner, Call) and func == "histogram_quantile" and inner.func in ("rate", "increase", "sum_over_time") and len(inner.args) == 1:
                inner = inner.args[0]
            else:
                raise QueryError(f"{func} cannot be taken of {inner.op if isinstance(inner, Aggregate) else inner.func}")
        if not isinstance(inner, Selector):
            raise QueryError(f"{func} takes a selector")
        s = inner
        if self.logs:
            df = apply_selector(self._scan(s), s, tuple(labels_by or ()), self.body)
            if UNWRAPPED not in df.columns:
                raise QueryError(f"{func} needs unwrap")
            df = df.withColumn("value", F.col(UNWRAPPED))
        else:
            df = self._metrics(s)
            if "value" not in df.columns:
                raise QueryError(f"{func} needs sketches or raw samples")
        df = df.where("value is not null")
        labels = self._labels(df.drop("value", UNWRAPPED), labels_by, without)
        keys = ["bucket_ts", *labels]
        binned = sketch.bins(df.withColumn("bucket_ts", V.bucket("chq_timestamp", self.step)), keys)
        if s.range_ms > self.step:
            # A bucket's bins count for each of the range's steps after it that have a window, and whose window reaches back to it.
            one = F.lit(1)
            valid = V.windows(V.step_partials(df, self.step, labels, one, one, one, one), s.range_ms, self.step)
            moved = binned.withColumnRenamed("bucket_ts", "of").withColumn("bucket_ts", F.explode(F.expr(f"sequence(of, of + {s.range_ms - self.step}, {self.step})")))
            on = moved["bucket_ts"] == valid["bucket_ts"]
            for c in labels:
                on = on & moved[c].eqNullSafe(valid[c])
            binned = sketch.merge(moved.join(valid, on & (moved["of"] >= valid["floor"])).select(moved["bucket_ts"], *[moved[c] for c in labels], "bin", "n"), keys)
        out = sketch.quantiles(binned, keys, {"value": q})
        return Vector(out.withColumn("bucket_ts", F.col("bucket_ts") + s.offset_ms), labels).mapped(F.col("value"))

    def _binary(self, node: Binary, by, without):
        keys = node.on if node.on else by
        left, right = self.plan(node.left, keys, without), self.plan(node.right, keys, without)
        scalars = (isinstance(left, (float, DataFrame)), isinstance(right, (float, DataFrame)))
        if node.op in V.SETS:
            if any(scalars):
                raise QueryError(f"{node.op} takes two vectors")
            return V.set_operation(left, right, node.op, node.on, node.ignoring)
        if all(scalars):
            return self._two_scalars(node, left, right)
        if scalars[1]:
            return V.with_scalar(left, right, node.op, True, node.as_bool)
        if scalars[0]:
            return V.with_scalar(right, left, node.op, False, node.as_bool)
        return V.binary(left, right, node.op, node.on, node.ignoring, node.as_bool)

    def _two_scalars(self, node: Binary, left, right):
        if isinstance(left, float) and isinstance(right, float):
            try:
                out = {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: left / right}.get(node.op)
                value = out() if out else float({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "==": left == right, "!=": left != right}[node.op])
            except ZeroDivisionError:
                value = float("nan")
            return value
        table, other, first = (left, right, True) if isinstance(left, DataFrame) else (right, left, False)
        return V.with_scalar(Vector(table, []), other, node.op, first, node.as_bool).df
