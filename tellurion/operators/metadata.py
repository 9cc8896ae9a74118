"""Tag and series discovery, summaries, catalogs with file pruning, and validation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact, sketch
from ..plans import syntax
from ..plans.pipeline import apply_selector, condition_names, made, matcher_column, matches
from ..plans.syntax import Aggregate, Binary, Call, Matcher, Number, QueryError, Selector, selectors
from ..sources.views import label_columns


def tag_names(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Names of columns with any non-null, non-empty value: one aggregation over all columns, no unpivot of rows."""
    names = [c for c in df.columns if c not in skip]
    if not names:
        return df.sparkSession.createDataFrame([], "tag_name string")
    seen = df.agg(*[F.max(F.col(f"`{c}`").cast("string") != "").alias(f"c{k}") for k, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("tag_name"), F.coalesce(F.col(f"c{k}"), F.lit(False)).alias("has")) for k, c in enumerate(names)])
    return seen.select(F.explode(pairs).alias("p")).where("p.has").select("p.tag_name")


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    """Distinct non-null values of a tag, sorted; none if the tag does not exist."""
    if tag not in df.columns:
        return df.sparkSession.createDataFrame([], "tag_value string")
    return df.select(F.col(f"`{tag}`").cast("string").alias("tag_value")).where("tag_value is not null and tag_value <> ''").distinct().orderBy("tag_value")


def metric_scope(df: DataFrame, node) -> DataFrame:
    scope = selectors(node)[0]
    if scope.metric is not None:
        df = df.where(F.col("metric_name") == scope.metric)
    for m in scope.matchers:
        df = df.where(matcher_column(m)) if m.label in df.columns else df.where(F.lit(False))
    return df


def series(df: DataFrame, field: str, groups: list[tuple[Matcher, ...]]) -> DataFrame:
    """Distinct streams that pass any of the matcher groups; regular expressions are anchored here."""
    streams = df.select(F.col(field).alias("stream")).where("stream is not null").groupBy("stream").agg(F.count("*").alias("lines"))
    keep = F.lit(not groups)
    for group in groups:
        one = F.lit(True)
        for m in group:
            one = one & (matches(F.col("stream"), m.op, m.value, anchored=True) if m.label == field else F.lit(False))
        keep = keep | one
    return streams.where(keep)


def metrics_metadata(df: DataFrame) -> DataFrame:
    kind = F.min_by("chq_metric_type", "chq_timestamp") if "chq_metric_type" in df.columns else F.lit("gauge")
    return df.groupBy("metric_name").agg(kind.alias("metric_type"), F.min("chq_timestamp").alias("first_ts"), F.max("chq_timestamp").alias("last_ts"))


_STATS = {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "count": "count"}


def summary(df: DataFrame, node, start: int, end: int, step: int, keep_series: bool = False) -> DataFrame:
    """count, sum, min, max, avg, p50, p90, p95, p99 per series over [start, end).

    A comparison with a number at the top keeps the series whose statistic (the aggregation's, else the average) passes.
    Tables with raw samples get sketch quantiles; rollups only get the exact statistics; other expressions get the
    statistics of their evaluated points.
    """
    test = None
    if isinstance(node, Binary) and isinstance(node.right, Number) and node.op in (">", ">=", "<", "<=", "==", "!="):
        test, node = (None if node.as_bool else (node.op, node.right.value)), node.left
    stat, inner, by = "avg", node, None
    if isinstance(node, Aggregate) and node.op in _STATS:
        stat, inner, by = _STATS[node.op], node.expr, node.by or ()
    if isinstance(inner, Selector):
        scoped = metric_scope(df.where((F.col("chq_timestamp") >= start) & (F.col("chq_timestamp") < end)), inner)
        labels = [c for c in (by if by is not None else label_columns(scoped)) if c in scoped.columns]
        if "value" in scoped.columns:
            plain = scoped.groupBy(*labels).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))
            tail = sketch.quantiles(sketch.bins(scoped, labels), labels, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
            if labels:
                on = None
                for c in labels:
                    one = plain[c].eqNullSafe(tail[c])
                    on = one if on is None else on & one
                out = plain.join(tail, on, "left").select(*[plain[c] for c in plain.columns], "p50", "p90", "p95", "p99")
            else:
                out = plain.withColumn("_k", F.lit(1)).join(tail.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
        else:
            more = {"count": (F.col("chq_rollup_count"), F.sum), "min": (F.col("chq_rollup_min"), F.min), "max": (F.col("chq_rollup_max"), F.max)}
            sums = exact.summed(scoped, {c: F.col(f"`{c}`") for c in labels}, F.col("chq_rollup_sum"), "sum", more)
            out = sums.select(*[F.col(f"`{c}`") for c in labels], F.col("count").cast("long").alias("count"), "sum", "min", "max", F.try_divide("sum", "count").alias("avg"))
    else:
        from ..plans.planner import Planner

        planner = Planner(df, start, end, step, keep_series=keep_series)
        points = planner.run(node)
        labels = [c for c in points.columns if c not in ("bucket_ts", "value")]
        out = points.groupBy(*labels).agg(F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))
    if test:
        from .vectors import comparison

        out = out.where(comparison(test[0], F.col(stat), F.lit(test[1])))
    return out


# Catalog of files: a row per file with its time range and fingerprints, used to read only files that can match.

#: Values of a label that a file's fingerprints hold at most.
MOST_VALUES = 10_000
INDEXED = ("metric_name", "log_level", "resource_service_name", "span_name", "span_kind", "resource_k8s_pod_name")


def trigrams(column):
    """Distinct runs of three characters."""
    return F.array_distinct(F.when(F.length(column) >= 3, F.transform(F.sequence(F.lit(1), F.length(column) - 2), lambda i: F.substring(column, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def fingerprints(label: str, column):
    """Hashes of label:value, of label:trigram for each trigram, and of the label's presence."""
    own = F.array(F.xxhash64(F.lit(f"{label}=*")), F.xxhash64(F.concat(F.lit(f"{label}={{"), column)))
    return F.when(column.isNotNull(), F.concat(own, F.transform(trigrams(column), lambda t: F.xxhash64(F.concat(F.lit(f"{label}~"), t))))).otherwise(F.array().cast("array<bigint>"))


def file_catalog(df: DataFrame, labels: tuple[str, ...] = INDEXED, ts: str = "chq_timestamp", most: int = MOST_VALUES) -> DataFrame:
    """(path, lo, hi, rows, bytes, fingerprints) of a stored table's files, in one pass: values are made distinct per file and
    label before they are hashed. A label with more than `most` values in a file is only marked as such, and never prunes it."""
    have = [c for c in labels if c in df.columns]
    named = [F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("v")) for c in have] or [F.struct(F.lit("").alias("label"), F.lit(None).cast("string").alias("v"))]
    rows = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col(ts).alias("ts"), F.explode(F.array(*named)).alias("e"))
    values = rows.groupBy("path", "e.label", "e.v").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
    held = values.groupBy("path", "label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"), F.max("bytes").alias("bytes"), F.count("v").alias("n"), F.collect_set("v").alias("vs"))
    prints = F.lit([]).cast("array<bigint>")
    for c in have:
        many = F.array(F.xxhash64(F.lit(f"{c}=*")), F.xxhash64(F.lit(f"{c}=#")))
        own = F.array_distinct(F.flatten(F.transform("vs", partial(fingerprints, c))))
        prints = F.when(F.col("label") == c, F.when(F.col("n") > most, many).otherwise(own)).otherwise(prints)
    out = held.withColumn("prints", prints).groupBy("path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rows").alias("rows"), F.max("bytes").alias("bytes"), F.array_distinct(F.flatten(F.collect_list("prints"))).alias("fingerprints"))
    return out


_BREAKS = "dDwWsSbBhHvVRXAZzGtnrfae"  # escapes of one letter that stand for no literal of their own


def regex_trigrams(pattern: str) -> list[str]:
    """Trigrams that every match must hold (of the literal runs outside groups, classes and repeats); may be none.

    None are demanded of alternatives, inline flags, and escapes or classes whose extent is not plain.
    """
    if "|" in pattern or re.search(r"\(\?[^:=!<>]", pattern):
        return []
    runs, at, depth = [""], 0, 0
    while at < len(pattern):
        c, literal = pattern[at], ""
        if c == "\\":
            c = pattern[at + 1 : at + 2]
            at += 1
            if not c or (c.isascii() and c.isalnum() and c not in _BREAKS):
                return []
            literal = "" if c in _BREAKS else c
        elif c in "[{":
            whole = re.compile(r"\[\^?(?:\\[^Q]|[^\[\]\\])+\]" if c == "[" else r"\{[^{}]*\}", re.S).match(pattern, at)
            if not whole:
                return []
            at = whole.end() - 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$*+?":
            literal = c
        at += 1
        if literal and not depth and pattern[at : at + 1] not in ("*", "?", "{"):
            runs[-1] += literal
        else:
            runs.append("")
    return [r[k : k + 3] for r in runs for k in range(len(r) - 2)]


def prune(catalog: DataFrame, selector: Selector | list[Selector], start: int, end: int, labels: tuple[str, ...] = INDEXED) -> DataFrame:
    """Catalog rows whose files may hold rows of any of the selectors in [start, end): a superset is always safe."""
    out = catalog.where((F.col("lo") < end) & (F.col("hi") >= start))
    every = [selector] if isinstance(selector, Selector) else selector
    test = F.lit(not every)
    for s in every:
        test = test | may_hold(s, labels)
    return out.where(test)


def may_hold(selector: Selector, labels: tuple[str, ...] = INDEXED) -> Column:
    """Whether a file's fingerprints may have rows that pass a selector's metric and matchers, all of them. `!=` and `!~` need the
    label to be there at all, as a null passes no matcher. Labels that stages make are not looked up."""
    has = lambda text: F.array_contains("fingerprints", F.xxhash64(F.lit(text)))
    made_later = {n for s in selector.stages for n in made(s)} | ({m.label for m in selector.matchers} if any(s.kind in ("json", "logfmt") for s in selector.stages) else set())
    matchers = [*selector.matchers, *([Matcher("metric_name", "=", selector.metric)] if selector.metric else [])]
    out = F.lit(True)
    for m in matchers:
        if m.label not in labels or m.label in made_later:
            continue
        if m.op == "=":
            test = has(f"{m.label}={{{m.value}")
        elif m.op == "=~":
            words = re.fullmatch(r"\^?\(?(?:\?:)?([\w\-|]+)\)?\$?", m.value)
            options = words[1].split("|") if words and "|" in m.value else None
            runs = [[w[k : k + 3] for k in range(len(w) - 2)] for w in options] if options else [regex_trigrams(m.value)]
            test = F.lit(False)
            for own in runs:
                one = F.lit(True)
                for t in own:
                    one = one & has(f"{m.label}~{t}")
                test = test | one
        else:
            test = has(f"{m.label}=*")
        out = out & (test | has(f"{m.label}=#"))
    return out


def pruned_table(spark: SparkSession, catalog: DataFrame, selector: Selector, start: int, end: int) -> DataFrame | None:
    """The table over the files that may match; None if no file may. The list of paths is metadata, one per file."""
    paths = [r["path"] for r in prune(catalog, selector, start, end).select("path").collect()]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def can_use_aggregate(agg_fields: list[str], group_by: list[str], matchers: list[str]) -> bool:
    """Whether counts kept by `agg_fields` answer a query grouped and matched by these labels."""
    return bool(agg_fields) and set(group_by) | set(matchers) <= set(agg_fields)


# Validation


@dataclass
class Stagewise:
    stage: str
    rows: int
    missing: list[str]


def validate_promql(query: str, exemplar: dict | None = None) -> dict:
    """Parse and, with an exemplar, check that its fields cover the query's labels."""
    try:
        node = syntax.parse_promql(query)
        _check_functions(node)
    except QueryError as error:
        return {"valid": False, "error": str(error), "missing": []}
    missing: list[str] = []
    if exemplar:
        have = {re.sub(r"[^a-z0-9]", "_", k.lower()) for k in _flat(exemplar)}
        wanted = [m.label for s in selectors(node) for m in s.matchers] + _groupings(node)
        missing = [w for w in dict.fromkeys(wanted) if w not in have and w != "metric_name"]
        names = [s.metric for s in selectors(node) if s.metric]
        if "metric_name" in exemplar and names and exemplar["metric_name"] not in names:
            missing.append("metric_name")
    return {"valid": not missing, "error": "unknown fields: " + ", ".join(missing) if missing else "", "missing": missing}


def validate_logql(query: str, exemplar: dict | None = None, spark: SparkSession | None = None, stream: str | None = None, start: int = 0, end: int = 1 << 62) -> dict:
    """Parse; require an equality matcher in every selector (on `stream` if named); run stages one by one over the exemplar."""
    try:
        node = syntax.parse_logql(query)
        for s in selectors(node):
            equal = [m.label for m in s.matchers if m.op == "="]
            if not equal:
                raise QueryError("every selector needs an equality matcher")
            if stream and stream not in equal:
                raise QueryError(f"every selector needs an equality matcher on {stream}")
    except QueryError as error:
        return {"valid": False, "error": str(error), "stages": []}
    stages: list[Stagewise] = []
    if exemplar and spark is not None:
        row = {k: (v if isinstance(v, (str, int, float, bool)) or v is None else str(v)) for k, v in _flat(exemplar).items()}
        table = spark.createDataFrame([{k.replace(".", "_"): v for k, v in row.items() if v is not None}])
        s = selectors(node)[0]
        for k in range(len(s.stages) + 1):
            part = Selector(s.metric, s.matchers, stages=s.stages[:k])
            later = tuple(n for x in s.stages[k:] for n in ((condition_names(x.params[0])) if x.kind == "filter" else ()))
            df = apply_selector(table, part, later)
            rows = df.count()
            expected = made(s.stages[k - 1]) if k else []
            empty = [c for c in expected if c not in df.columns or not df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).count()]
            stages.append(Stagewise("selector" if not k else s.stages[k - 1].kind, rows, empty))
            if not rows:
                break
    bad = next((x for x in stages if not x.rows or x.missing), None)
    return {"valid": bad is None, "error": f"stage {bad.stage} yields {bad.rows} rows, lacks {bad.missing}" if bad else "", "stages": stages}


def _flat(d: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in d.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def _groupings(node) -> list[str]:
    if isinstance(node, Aggregate):
        return [*(node.by or ()), *_groupings(node.expr)]
    if isinstance(node, Call):
        return [*node.by, *[g for a in node.args for g in _groupings(a)]]
    if isinstance(node, Binary):
        return [*(node.on or ()), *_groupings(node.left), *_groupings(node.right)]
    return []


def _check_functions(node) -> None:
    from ..plans.planner import RANGE_FUNCTIONS
    from .vectors import UNARY

    if isinstance(node, Call):
        if node.func not in (*RANGE_FUNCTIONS, *UNARY, "scalar", "clamp_min", "clamp_max", "histogram_quantile", "quantile_over_time"):
            raise QueryError(f"unsupported function {node.func}")
        for a in node.args:
            _check_functions(a)
    elif isinstance(node, Aggregate):
        _check_functions(node.expr)
    elif isinstance(node, Binary):
        _check_functions(node.left)
        _check_functions(node.right)
