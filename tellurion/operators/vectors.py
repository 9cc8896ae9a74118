"""Instant vectors and the operators on them.

A vector is a lazy DataFrame (bucket_ts long, label columns, value double, or the partial columns of a raw leaf) with its
label names; every operator maps vectors to vectors, so a whole expression is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..plans.syntax import QueryError

PARTIAL = ("v_sum", "v_count", "v_min", "v_max", "v_rows")


@dataclass
class Vector:
    df: DataFrame
    labels: list[str]
    raw: bool = False

    def valued(self) -> Vector:
        """A raw leaf as an instant vector: the bucket's mean."""
        if not self.raw:
            return self
        return Vector(self.df.select("bucket_ts", *self.labels, F.try_divide("v_sum", "v_count").alias("value")).where("value is not null"), self.labels)

    def mapped(self, value: Column) -> Vector:
        return Vector(self.df.select("bucket_ts", *self.labels, value.cast("double").alias("value")).where("value is not null"), self.labels)


def bucket(ts: str | Column, step: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(step))


def step_partials(df: DataFrame, step: int, labels: list[str], sum_col: Column, count_col: Column, min_col: Column, max_col: Column, ts: str = "chq_timestamp") -> Vector:
    """Sum, count, minimum, maximum and rows per step bucket and labels (one partial and one final aggregation). Doubles add up
    exactly, so that rounding and comparing a sum does not depend on the order of the rows."""
    keys = {"bucket_ts": bucket(ts, step), **{c: F.col(f"`{c}`") for c in labels}}
    more = {"v_count": (F.coalesce(count_col, F.lit(0)), F.sum), "v_min": (min_col, F.min), "v_max": (max_col, F.max), "v_rows": (count_col, F.count)}
    if df.select(sum_col).dtypes[0][1] in ("double", "float"):
        out = exact.summed(df, keys, sum_col, "v_sum", more)
    else:
        out = df.groupBy(*[c.alias(name) for name, c in keys.items()]).agg(F.sum(sum_col).alias("v_sum"), *[f(c).alias(name) for name, (c, f) in more.items()])
    out = out.select("bucket_ts", *[F.col(f"`{c}`") for c in labels], *[F.col(c).cast("double").alias(c) for c in PARTIAL])
    return Vector(out, labels, raw=True)


def dense(vector: Vector, start: int, end: int, step: int) -> Vector:
    """Every bucket of [start, end) for every label set, absent ones as 0 counts. Buckets are exploded per label set, so
    nothing is joined without a key."""
    first = start - start % step
    if not vector.labels:
        grid = vector.df.sparkSession.range(first, end, step).withColumnRenamed("id", "bucket_ts")
        joined = grid.join(vector.df, "bucket_ts", "left")
    else:
        grid = vector.df.select(*vector.labels).distinct().withColumn("bucket_ts", F.explode(F.sequence(F.lit(first), F.lit(end - 1), F.lit(step))))
        known = vector.df.select(F.col("bucket_ts").alias("_t"), *[F.col(f"`{c}`").alias(f"_l{k}") for k, c in enumerate(vector.labels)], *PARTIAL)
        on = F.col("bucket_ts") == F.col("_t")
        for k, c in enumerate(vector.labels):
            on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_l{k}"))
        joined = grid.join(known, on, "left").select("bucket_ts", *vector.labels, *PARTIAL)
    return Vector(joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in PARTIAL}), vector.labels, raw=True)


def covered(leaf: Vector, range_ms: int, step: int, more: dict[str, Column] | None = None) -> tuple[DataFrame, Window]:
    """The leaf's rows with `eff`, the span of their bucket, and `floor`, the first time in their window.

    A bucket spans at least `step`, or the gap since the series' previous bucket. A window drops the buckets that fall out of
    the range by any span seen so far. `more` are columns over the series' order.
    """
    order = Window.partitionBy(*leaf.labels).orderBy("bucket_ts")
    df = leaf.df.withColumn("eff", F.greatest(F.lit(step), F.coalesce(F.col("bucket_ts") - F.lag("bucket_ts").over(order), F.lit(step))))
    floor = F.max(F.least(F.col("bucket_ts") + F.col("eff") - range_ms, F.col("bucket_ts") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"floor": floor, **(more or {})}), order


def windows(leaf: Vector, range_ms: int, step: int) -> DataFrame:
    """(bucket_ts, labels, floor) of the steps that have a value: those whose window covers the range."""
    return _found(leaf, range_ms, step, {}, {}).select("bucket_ts", *leaf.labels, "floor")


def _found(leaf: Vector, range_ms: int, step: int, kept: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """Rows whose window covers the range, each with `before`, what the series' last row before the window holds.

    Each row is looked up at its floor among the rows themselves: rows and lookups are sorted together and the last row is
    carried on, so a window costs the same whatever its length, and no list of its entries is made. `running` are columns over
    the series' order that `before` has too, `kept` other columns of the leaf that the caller needs.
    """
    order = Window.partitionBy(*leaf.labels).orderBy("bucket_ts")
    df, _ = covered(leaf, range_ms, step, {"start": F.first("bucket_ts").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("bucket_ts").over(order), **running})
    own = F.struct("bucket_ts", "eff", "floor", "start", *kept, *running)
    held = F.struct("next", *running)
    events = F.array(F.struct(F.col("bucket_ts").alias("t"), F.lit(1).alias("kind"), held.alias("held"), F.lit(None).alias("own")), F.struct(F.col("floor").alias("t"), F.lit(0).alias("kind"), F.lit(None).alias("held"), own.alias("own")))
    both = df.select(*leaf.labels, F.explode(events).alias("e")).select(*leaf.labels, "e.*")
    at = Window.partitionBy(*leaf.labels).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("before", F.last("held", True).over(at)).where("kind = 0").select(*leaf.labels, "own.*", "before")
    first = F.coalesce(F.col("before.next"), F.col("start"))
    return out.where((F.col("floor") <= F.col("bucket_ts")) & (F.col("bucket_ts") - first + F.col("eff") >= range_ms))


def _extreme(leaf: Vector, range_ms: int, step: int, column: str, pick) -> Vector:
    """Minimum or maximum of windows from extremes of runs of 1, 2, 4 ... rows: two runs that overlap make up a window."""
    order = Window.partitionBy(*leaf.labels).orderBy("bucket_ts")
    levels = (range_ms // step + 1).bit_length()
    df = leaf.df.withColumns({"b0": F.col(column), "f0": F.col(column)})
    for k in range(1, levels):
        far = 1 << (k - 1)
        df = df.withColumns({f"b{k}": pick(F.col(f"b{k - 1}"), F.lag(f"b{k - 1}", far).over(order)), f"f{k}": pick(F.col(f"f{k - 1}"), F.lead(f"f{k - 1}", far).over(order))})
    running = {"n": F.row_number().over(order), "ahead": F.lead(F.array(*[f"f{k}" for k in range(levels)])).over(order), "start_ahead": F.first(F.array(*[f"f{k}" for k in range(levels)])).over(order.rowsBetween(Window.unboundedPreceding, 0))}
    back = Vector(df.withColumn("back", F.array(*[f"b{k}" for k in range(levels)])).drop(*[f"{x}{k}" for x in "b" for k in range(levels)]), leaf.labels)
    out = _found(back, range_ms, step, {"back": F.col("back")}, running)
    size = F.col("n") - F.coalesce(F.col("before.n"), F.lit(0))
    level = F.floor(F.log2(size.cast("double") + 0.5)).cast("int")
    ahead = F.coalesce(F.col("before.ahead"), F.col("start_ahead"))
    return Vector(out, leaf.labels).mapped(pick(F.get("back", level), F.get(ahead, level)))


def range_function(leaf: Vector, func: str, range_ms: int, step: int, quantile: float | None = None) -> Vector:
    """rate, increase, *_over_time over a sliding range of step buckets, as running sums that are subtracted. A value that is no
    number makes every window that holds it none."""
    if func in ("min_over_time", "max_over_time"):
        return _extreme(leaf, range_ms, step, "v_min" if func == "min_over_time" else "v_max", F.least if func == "min_over_time" else F.greatest)
    order = Window.partitionBy(*leaf.labels).orderBy("bucket_ts").rowsBetween(Window.unboundedPreceding, 0)
    plain = F.coalesce(F.col("v_sum"), F.lit(0.0))
    odd = F.isnan(plain) | (F.abs(plain) == F.lit(float("inf")))
    running = {"p_sum": F.sum(F.when(odd, 0.0).otherwise(plain)).over(order), "p_count": F.sum(F.coalesce("v_count", F.lit(0.0))).over(order), "p_odd": F.sum(odd.cast("long")).over(order)}
    out = _found(leaf, range_ms, step, {"v_sum": F.col("v_sum"), "v_count": F.col("v_count")}, running)
    since = lambda c: F.col(c) - F.coalesce(F.col(f"before.{c}"), F.lit(0))
    total = F.when(since("p_odd") > 0, F.lit(float("nan"))).otherwise(since("p_sum"))
    values = {
        "rate": lambda: total / (range_ms / 1000), "increase": lambda: total, "sum_over_time": lambda: total, "count_over_time": lambda: since("p_count"),
        "avg_over_time": lambda: F.try_divide(total, since("p_count")), "last_over_time": lambda: F.try_divide("v_sum", "v_count"), "irate": lambda: F.col("v_sum") / (F.col("eff") / 1000),
    }
    if func not in values:
        raise QueryError(f"unsupported function {func}")
    return Vector(out, leaf.labels).mapped(values[func]())


def plain_rate(leaf: Vector, step: int) -> Vector:
    """rate without a range: the bucket's sum by the span of the bucket in seconds."""
    order = Window.partitionBy(*leaf.labels).orderBy("bucket_ts")
    eff = F.greatest(F.lit(step), F.coalesce(F.col("bucket_ts") - F.lag("bucket_ts").over(order), F.lit(step)))
    return Vector(leaf.df.withColumn("eff", eff), leaf.labels).mapped(F.col("v_sum") / (F.col("eff") / 1000))


def aggregate(vector: Vector, op: str, by: list[str] | None, without: list[str] | None) -> Vector:
    """sum, avg, min, max, count over label sets; a raw leaf's partials merge (count counts its stored rows), values that are NaN
    are skipped."""
    labels = [c for c in vector.labels if c not in without] if without is not None else [c for c in (by or []) if c in vector.labels]
    keys = ["bucket_ts", *[F.col(f"`{c}`") for c in labels]]
    if vector.raw:
        value = {"sum": F.sum("v_sum"), "avg": F.try_divide(F.sum("v_sum"), F.sum("v_count")), "min": F.min("v_min"), "max": F.max("v_max"), "count": F.sum("v_rows")}[op]
        out = vector.df.groupBy(*keys).agg(value.alias("value"))
    else:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[op]("value")
        out = vector.df.where(~F.isnan("value")).groupBy(*keys).agg(value.alias("value"))
    return Vector(out, labels).mapped(F.col("value"))


def ranked(vector: Vector, k: int, largest: bool) -> Vector:
    """topk and bottomk per step; ties by label values; NaN skipped."""
    v = vector.valued()
    order = Window.partitionBy("bucket_ts").orderBy(F.desc("value") if largest else F.asc("value"), *[F.asc_nulls_first(f"`{c}`") for c in v.labels])
    return Vector(v.df.where(~F.isnan("value")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k"), v.labels)


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Null (no sample) for a division by zero."""
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()


def comparison(op: str, a: Column, b: Column) -> Column:
    return {">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b, "==": lambda: a == b, "!=": lambda: a != b}[op]()


COMPARISONS, ARITHMETIC, SETS = (">", ">=", "<", "<=", "==", "!="), ("+", "-", "*", "/"), ("and", "or", "unless")


def _operate(op: str, a: Column, b: Column, kept: Column, as_bool: bool) -> Column:
    if op in ARITHMETIC:
        return arithmetic(op, a, b)
    test = comparison(op, a, b)
    return F.when(test, 1.0).otherwise(0.0) if as_bool else F.when(test, kept)


def with_scalar(vector: Vector, scalar: float | DataFrame, op: str, left: bool, as_bool: bool) -> Vector:
    """Vector with a number, or with a one-value-per-step table (joined on the step); `left`: the vector is on the left."""
    v = vector.valued()
    if isinstance(scalar, DataFrame):
        df = v.df.join(scalar.withColumnRenamed("value", "_s"), "bucket_ts")
        other = F.col("_s")
    else:
        df, other = v.df, F.lit(float(scalar))
    a, b = (F.col("value"), other) if left else (other, F.col("value"))
    return Vector(df, v.labels).mapped(_operate(op, a, b, F.col("value"), as_bool))


def match_labels(left: Vector, right: Vector, on: tuple[str, ...] | None, ignoring: tuple[str, ...] | None) -> list[str]:
    every = [c for c in dict.fromkeys([*left.labels, *right.labels]) if c not in ("name", "__name__", "metric_name")]
    return [c for c in every if c in on] if on else [c for c in every if c not in (ignoring or ())]


def _with(v: Vector, labels: list[str]) -> DataFrame:
    return v.df.withColumns({c: F.lit(None).cast("string") for c in labels if c not in v.labels})


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = a["bucket_ts"] == b["bucket_ts"]
    for c in keys:
        on = on & a[c].eqNullSafe(b[c])
    return on


def binary(left: Vector, right: Vector, op: str, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] | None = None, as_bool: bool = False) -> Vector:
    """Vector with vector: an inner join per step on the matching labels; keys that the right side repeats match nothing."""
    left, right = left.valued(), right.valued()
    keys = match_labels(left, right, on, ignoring)
    a, b = _with(left, keys), _with(right, keys)
    unique = b.groupBy("bucket_ts", *keys).agg(F.count("*").alias("_n"), F.first("value").alias("_r")).where("_n = 1").drop("_n")
    joined = a.join(unique, _same(a, unique, keys)).select(a["bucket_ts"], *[a[c] for c in left.labels], a["value"], unique["_r"])
    return Vector(joined, left.labels).mapped(_operate(op, F.col("value"), F.col("_r"), F.col("value"), as_bool))


def set_operation(left: Vector, right: Vector, op: str, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] | None = None) -> Vector:
    """and, unless, or: semi, anti and union-with-anti joins on the label sets."""
    left, right = left.valued(), right.valued()
    keys = match_labels(left, right, on, ignoring)
    a, b = _with(left, keys), _with(right, keys)
    if op != "or":
        return Vector(a.join(b.select("bucket_ts", *keys), _same(a, b, keys), "left_semi" if op == "and" else "left_anti").select("bucket_ts", *left.labels, "value"), left.labels)
    labels = list(dict.fromkeys([*left.labels, *right.labels]))
    a, b = _with(left, labels), _with(right, labels)
    rest = b.join(a.select("bucket_ts", *keys), _same(b, a, keys), "left_anti")
    return Vector(a.select("bucket_ts", *labels, "value").unionByName(rest.select("bucket_ts", *labels, "value")), labels)


_UNARY = {
    "abs": lambda v: F.abs(v), "ceil": lambda v: F.ceil(v), "floor": lambda v: F.floor(v), "exp": lambda v: F.exp(v), "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)), "sgn": lambda v: F.signum(v),
    "ln": lambda v: F.when(v > 0, F.log(v)), "log2": lambda v: F.when(v > 0, F.log2(v)), "log10": lambda v: F.when(v > 0, F.log10(v)),
}


def unary(vector: Vector, func: str) -> Vector:
    """Mathematical functions; outside their domain there is no sample."""
    return vector.valued().mapped(_UNARY[func](F.col("value")))


def clamp(vector: Vector, func: str, limit: float) -> Vector:
    pick = F.greatest if func == "clamp_min" else F.least
    return vector.valued().mapped(pick(F.col("value"), F.lit(limit)))


def scalar_of(vector: Vector) -> DataFrame:
    """(bucket_ts, value) of steps at which the vector has exactly one sample."""
    return vector.valued().df.groupBy("bucket_ts").agg(F.count("*").alias("_n"), F.first("value").alias("value")).where("_n = 1").drop("_n")


UNARY = tuple(_UNARY)
