"""Readers, promotion, translation, rollups, pruning, streams."""

import re

import pytest
from pyspark.sql import functions as F

from tellurion.operators import metadata
from tellurion.plans.syntax import parse_logql
from tellurion.sources import ingest
from tellurion.streaming import jobs


def test_promotion():
    assert [ingest.promote(*p) for p in [("int", "bigint"), ("bigint", "double"), ("boolean", "bigint"), ("binary", "string"), ("string", "string")]] == ["bigint", "double", "string", "string", "string"]


def test_csv_drops_rows_of_other_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,t\n1,1.5,a\n2,2,"b, c"\n3,3\n4,4,d,e\n')
    df = ingest.read_file(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("t", "string")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1.5, "a"), (2, 2.0, "b, c")]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        ingest.read_file(spark, "x.txt")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"msg": "hi", "level": "warn", "ts": 1700000000, "host.name": "h", "deep": {"a": 1}}\n')
    row = ingest.translate_logs(ingest.read_file(spark, str(tmp_path / "a.json")), "f").first()
    assert (row.chq_timestamp, row.log_message, row.log_level, row.resource_host_name, row.resource_file) == (1_700_000_000_000, "hi", "WARN", "h", "f")
    assert "resource_deep" not in row.asDict()


def test_rollup_keeps_earliest(spark):
    df = spark.createDataFrame([(1000, 1, "m", "a", 2.0), (9000, 9, "m", "a", 4.0), (11_000, 11, "m", "a", 1.0)], "chq_timestamp long, chq_tsns long, metric_name string, resource_x string, value double")
    out = sorted((r.chq_timestamp, r.chq_rollup_sum, r.chq_rollup_count, r.chq_rollup_avg) for r in ingest.rollup(df, 10_000, True).collect())
    assert out == [(0, 6.0, 2, 3.0), (10_000, 1.0, 1, 1.0)]
    assert ingest.next_tier(10_000) == 60_000 and ingest.next_tier(3_600_000) is None and ingest.tier_for(600_000) == 300_000


def test_pruning_is_a_superset(spark, tmp_path):
    rows = [(k * 1000, "ERROR" if k % 7 == 0 else "INFO", f"svc-{k // 50}") for k in range(200)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "chq_timestamp long, log_level string, resource_service_name string").repartitionByRange(4, "chq_timestamp").write.parquet(path)
    catalog = metadata.file_catalog(spark.read.parquet(path))
    for query, most in [('{resource_service_name="svc-1"}', 2), ('{resource_service_name=~"svc-(0|3)"}', 4), ('{resource_service_name="none"}', 0), ('{log_level="ERROR"}', 4)]:
        selector = parse_logql(query)
        kept = metadata.prune(catalog, selector, 0, 200_000).count()
        assert kept <= most
        want = spark.createDataFrame(rows, "chq_timestamp long, log_level string, resource_service_name string")
        table = metadata.pruned_table(spark, catalog, selector, 0, 200_000)
        from tellurion.plans.pipeline import apply_selector

        assert apply_selector(want, selector).count() == (apply_selector(table, selector).count() if table is not None else 0)
    assert metadata.prune(catalog, parse_logql("{}"), 0, 40_000).count() == 1


def test_regex_trigrams():
    assert metadata.regex_trigrams("pod-1.*") == ["pod", "od-", "d-1"]
    assert metadata.regex_trigrams("a|b") == [] and metadata.regex_trigrams("ab?cde") == ["cde"]


def test_regex_trigrams_are_in_every_match():
    values = ["pod-1-api", "pod-12-api", "pod-x-api", "foo", "a foo b", "ERROR", "error", "a1bcd", "abcd", "abcxyz", "xyz", "a.bcd", "aaab", "A-b-c", "tab\there", "abbbc", "foo]bar"]
    patterns = [r"pod-\d-api", r"pod-\d+-api", r"pod-\w-api", r"\bfoo", r".*\bfoo\b.*", "(?i)error", "(?i:err)or", r"a\dbcd", "(abc(d)?)?xyz", "((abc)?d)?xyz", r"a\.bcd", r"a\.?bcd", "a{3}b", "ab{1,3}c", "ab+c", r"\x61bcd", r"\Qa.b\Ecd", r"tab\there", r"foo[\]x]bar", "pod-1.*"]
    for p in patterns:
        hits = [v for v in values if not p.startswith(r"\Q") and re.search(p, v)]
        assert hits or p.startswith(r"\Q"), p
        assert all(t in v for v in hits for t in metadata.regex_trigrams(p)), p
    assert metadata.regex_trigrams(r"pod-\d-api") == ["pod", "od-", "-ap", "api"] and metadata.regex_trigrams(r"a\.bcd") == ["a.b", ".bc", "bcd"]
    assert metadata.regex_trigrams("(?i)error") == metadata.regex_trigrams(r"\Qa.b\Ecd") == []


def test_prune_keeps_files_of_regex_matches(spark):
    prints = metadata.fingerprints("log_level", F.col("v"))
    catalog = spark.createDataFrame([("a", 0, 9, 1, "ERROR"), ("b", 0, 9, 1, "pod-1-api")], "path string, lo long, hi long, rows long, v string").withColumn("fingerprints", prints)
    kept = lambda text: sorted(r.path for r in metadata.prune(catalog, parse_logql(text), 0, 10).collect())
    assert "a" in kept('{log_level=~"(?i)error"}') and kept("{log_level=~`pod-\\d-api`}") == ["b"]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "chq_timestamp long, k string, value double"
    for n, rows in enumerate([[(0, "a", 1.0), (600_000, "a", 2.0)], [(900_000, "a", 3.0)], [(5_000, "a", 7.0), (950_000, "a", 4.0)], [(1_800_000, "a", 0.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.windowed_rollup(stream, 10_000, ["k"], "10 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = {r.chq_timestamp: r.chq_rollup_sum for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The late row of the third batch finds its window closed.
    assert out[0] == 1.0 and out[600_000] == 2.0 and out[900_000] == 3.0


def test_retention(spark):
    df = spark.createDataFrame([(0,), (10 * 86_400_000,)], "chq_timestamp long")
    assert ingest.retained(df, 12 * 86_400_000, 3).count() == 1


def test_compaction_unions_by_name(spark):
    a, b = spark.createDataFrame([(1, 5)], "chq_timestamp long, v long"), spark.createDataFrame([(2, "x", True)], "chq_timestamp long, v string, w boolean")
    out = ingest.compact([a, b], "logs").orderBy("chq_timestamp").collect()
    assert [tuple(r) for r in out] == [(1, "5", None), (2, "x", True)]
    assert ingest.log_counts(spark.createDataFrame([(1, "I", "s"), (9_999, "I", "s")], "chq_timestamp long, log_level string, resource_service_name string")).withColumn("count", F.col("count")).first()["count"] == 2
