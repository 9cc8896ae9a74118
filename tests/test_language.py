"""Parsers, templates, units, validation."""

import pytest
from pyspark.sql import functions as F

from tellurion.functions import units
from tellurion.functions.template import compile_template
from tellurion.operators import metadata
from tellurion.plans.syntax import Aggregate, Binary, QueryError, duration_ms, parse_logql, parse_promql, selectors
from tellurion.session import Engine


def test_precedence():
    node = parse_promql("a + b * c > bool 2 and d or e")
    assert isinstance(node, Binary) and node.op == "or" and node.left.op == "and" and node.left.left.as_bool
    assert node.left.left.left.op == "+" and node.left.left.left.right.op == "*"


def test_selector_parts():
    s = selectors(parse_promql('sum by (pod) (rate(http.requests{a="x", b!~"y|z"}[1h30m] offset 5m))'))[0]
    assert (s.metric, s.range_ms, s.offset_ms, [m.op for m in s.matchers]) == ("http.requests", 5_400_000, 300_000, ["=", "!~"])
    assert duration_ms("2d") == 172_800_000


@pytest.mark.parametrize("query", ["", "sum(", "stddev(m)", "a % b", "a ^ 2", "a * on (x) group_left (y) b", "quantile(0.5, m)", "m[5", "m @ 5", '{a="b"'])
def test_bad_promql(query):
    with pytest.raises(QueryError):
        parse_promql(query)


def test_log_stages():
    s = parse_logql('{a="b"} |= "x|y" != `z` | json k="a.b[0]" | json | level=~"e.*" or (k > 5 and m != "q") | line_format "{{ .a | upper }}" | unwrap duration(d)')
    assert [x.kind for x in s.stages] == ["line", "line", "json", "filter", "line_format", "unwrap"]
    assert s.stages[3].params[0][0] == "or" and s.stages[5].params == ("duration", "d")
    agg = parse_logql('sum by (level) (rate({a="b"} | logfmt [5m] offset 1m)) / 2')
    assert isinstance(agg.left, Aggregate) and selectors(agg)[0].range_ms == 300_000 and selectors(agg)[0].offset_ms == 60_000


def test_templates(spark):
    df = spark.createDataFrame([("err", "Abc", None)], "level string, msg string, none string")
    resolve = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    text = '{{ if eq .level "err" }}E:{{ .msg | lower | hasPrefix "a" }}{{ else if .none }}n{{ else }}x{{ end }}-{{ .absent }}{{ index . "msg" }}-{{ len .msg }}'
    assert df.select(compile_template(text, resolve)).first()[0] == "E:true-Abc-3"
    with pytest.raises(QueryError):
        compile_template("{{ $x := 1 }}", resolve)


def test_units(spark):
    df = spark.createDataFrame([("1h30m",), ("250ms",), ("2",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(units.duration_seconds(F.col("v"))).collect()] == [5400.0, 0.25, 2.0, None, None]
    df = spark.createDataFrame([("3MiB",), ("10 kB",), ("7",), ("?",)], "v string")
    assert [r[0] for r in df.select(units.size_bytes(F.col("v"))).collect()] == [3 * 2**20, 10_000.0, 7.0, None]

    texts = ["1.5h2m3s4ms5us6µs7ns", "-90s", "1.2.3s", "1d", "", " 4m ", "5x3s", "s", "\u0661s"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(units.duration_seconds(F.col("v"))).collect()] == [pytest.approx(5523.004011007, abs=1e-12), -90.0, 0.0, 1.0, None, 240.0, None, None, None]
    df = spark.createDataFrame([(f"2{u}",) for u in ("", "b", "KB", "Mb", "gb", "tb", "pb", "eb", "kib", "gib", "tib", "pib", "eib", "xb")] + [(None,)], "v string")
    assert [r[0] for r in df.select(units.size_bytes(F.col("v"))).collect()] == [2.0 * k for k in (1, 1, 10**3, 10**6, 10**9, 10**12, 10**15, 10**18, 2**10, 2**30, 2**40, 2**50, 2**60)] + [None, None]


@pytest.mark.parametrize("unwrap", ["bytes(size)", "duration(size)", "size"])
def test_unwrap_parses_a_line_once(spark, unwrap):
    lines = spark.createDataFrame([(1, "ERROR", "a=1 size=3"), (2, "ERROR", "size=5"), (3, "ERROR", "size=?"), (4, "INFO", "a=1")], "chq_timestamp long, log_level string, log_message string")
    df = Engine(logs=lines).logql(f'sum by (log_level) (min_over_time({{log_level=~".+"}} | logfmt | unwrap {unwrap} [10s]))', 0, 10_000, 10_000)
    assert [tuple(r) for r in df.collect()] == [(0, "ERROR", 3.0)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("size=([^") == 1


def test_validation(spark):
    assert metadata.validate_promql('sum by (pod) (m{a="x"})', {"metric_name": "m", "pod": "p", "a": "x"})["valid"]
    assert metadata.validate_promql('sum by (zone) (m)', {"metric_name": "m", "pod": "p"})["missing"] == ["zone"]
    assert not metadata.validate_promql("deriv(m[5m])")["valid"]
    exemplar = {"chq_timestamp": 1, "log_message": '{"k": 5}', "app": "x"}
    assert metadata.validate_logql('{app="x"} | json | k > 3', exemplar, spark)["valid"]
    assert not metadata.validate_logql('{app="x"} | json | k > 7', exemplar, spark)["valid"]
    assert not metadata.validate_logql('{app=~"x"}')["valid"]


def test_scalars_and_duplicates(spark):
    rows = [(0, "a", "x", 6.0), (0, "b", "x", 3.0)]
    df = spark.createDataFrame(rows, "chq_timestamp long, p string, q string, chq_rollup_sum double").withColumns({"metric_name": F.lit("m"), "chq_rollup_count": F.lit(1), "chq_rollup_min": F.col("chq_rollup_sum"), "chq_rollup_max": F.col("chq_rollup_sum")})
    e = Engine(metrics=df)
    assert [r.value for r in e.promql("1 + 2 * 3", 0, 10_000, 10_000).collect()] == [7.0]
    # The right side repeats q=x, so nothing matches there.
    assert e.promql("sum by (q) (m) + on (q) sum by (p, q) (m)", 0, 10_000, 10_000).collect() == []
    assert sorted(r.value for r in e.promql("sum by (p, q) (m) + on (q) sum by (q) (m)", 0, 10_000, 10_000).collect()) == [12.0, 15.0]
    assert e.promql("ln(sum(m) - 10)", 0, 10_000, 10_000).collect() == []
