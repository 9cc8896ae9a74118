"""The store: pruning, tiers, counts, upkeep; and binary OTLP."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from tellurion.plans.syntax import parse_logql
from tellurion.session import Engine
from tellurion.sources import ingest, otlp
from tellurion.sources.store import Conflict, Store
from tellurion.streaming import jobs

DAY = 86_400_000


def lines(spark, n=400, days=4):
    df = spark.range(n).select((F.col("id") * (days * DAY // n)).alias("chq_timestamp"), F.col("id").cast("string").alias("chq_id"), F.when(F.col("id") % 7 == 0, "ERROR").otherwise("INFO").alias("log_level"), F.concat(F.lit("svc-"), F.floor(F.col("id") * 4 / n).cast("string")).alias("resource_service_name"), F.lit("hello").alias("log_message"))
    return df.withColumn("chq_tsns", F.col("chq_timestamp") * 1_000_000)


def test_queries_read_the_files_that_matter(spark, tmp_path):
    store, table = Store(spark, f"file://{tmp_path}/s"), lines(spark)
    store.ingest(table, "logs")
    with_store, without = Engine(store=store), Engine(logs=table)
    for query, files in (('{resource_service_name="svc-2"}', 1), ('{log_level="ERROR"}', 4), ('{resource_service_name=~"svc-(0|3)"}', 4), ('{resource_service_name="none"}', 0), ('{resource_service_name!="svc-0"} |= "hello"', 4)):
        ids = lambda e, q=query: [r.chq_id for r in e.logql(q, 0, 4 * DAY).collect()]
        assert ids(with_store) == ids(without), query
        assert store.files("logs", [parse_logql(query)], 0, 4 * DAY).count() <= files, query
    both = [parse_logql('{resource_service_name="svc-0"}'), parse_logql('{resource_service_name="svc-3"}')]
    assert store.files("logs", both, 0, 4 * DAY).count() == 2 and store.files("logs", both, DAY, 2 * DAY).count() == 0
    counted = 'sum by (log_level) (count_over_time({resource_service_name=~"svc-[12]"}[1d]))'
    plan = lambda e: e.logql(counted, 0, 4 * DAY, DAY)
    assert sorted(map(tuple, plan(with_store).collect())) == sorted(map(tuple, plan(without).collect()))
    assert all("/counts/" in f for f in plan(with_store).inputFiles())
    store.add(table.where("chq_id = '5'"), "logs")  # lines without counts: the lines are read again
    assert not any("/counts/" in f for f in plan(with_store).inputFiles()) and sum(r.value for r in plan(with_store).collect()) == sum(r.value for r in plan(without).collect())


def test_tiers_by_day(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    samples = spark.range(2000).select((F.col("id") * (2 * DAY // 2000)).alias("chq_timestamp"), F.lit("m").alias("metric_name"), F.concat(F.lit("z"), (F.col("id") % 2).cast("string")).alias("zone"), (F.col("id") % 13).cast("double").alias("value"))
    store.ingest(samples.where(F.col("chq_timestamp") < DAY), "metrics")
    store.rollup()
    store.ingest(samples.where(F.col("chq_timestamp") >= DAY), "metrics")
    assert set(store.tiers(0, 2 * DAY, 3_600_000).values()) == {3_600_000, 10_000} and set(store.tiers(0, 2 * DAY, 3_600_000, 90_000).values()) == {10_000}
    mixed = Engine(store=store).promql("sum by (zone) (rate(m[2h]))", 0, 2 * DAY, 3_600_000).collect()
    store.rollup()
    assert store.rollup() == [] and set(store.tiers(0, 2 * DAY, 3_600_000).values()) == {3_600_000}
    plain = Engine(metrics=ingest.rollup(samples, 10_000, True)).promql("sum by (zone) (rate(m[2h]))", 0, 2 * DAY, 3_600_000).collect()
    again = Engine(store=store).promql("sum by (zone) (rate(m[2h]))", 0, 2 * DAY, 3_600_000)
    key = lambda rows: sorted((r.bucket_ts, r.zone, round(r.value, 9)) for r in rows)
    assert key(mixed) == key(plain) == key(again.collect()) and len(again.inputFiles()) == 2
    late = samples.where("id < 1").withColumn("chq_timestamp", F.lit(5_000))
    store.ingest(late, "metrics")  # a late row makes the day's coarser tiers stale
    assert store.tiers(0, DAY, 3_600_000)[19700101] == 10_000
    store.rollup()
    assert store.tiers(0, DAY, 3_600_000)[19700101] == 3_600_000


def test_rollups_hash_their_groups(spark, tmp_path):
    """Series that are hashes of their labels need no sort; ids from elsewhere keep the labels of the earliest row."""
    samples = spark.createDataFrame([(0, "m", "a", 1.0), (11_000, "m", "a", 2.0), (12_000, "m", None, 4.0)], "chq_timestamp long, metric_name string, zone string, value double")
    first = ingest.rollup(samples, 10_000, True)
    chain = ingest.rollup_chain(samples, 60_000)
    for df in (first, chain, ingest.rollup(first, 60_000, own=ingest.own_series(first))):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(((r.chq_timestamp, r.zone, r.chq_rollup_sum, r.chq_rollup_count) for r in df.collect()), key=str)
    assert key(first) == [(0, "a", 1.0, 1), (10_000, "a", 2.0, 1), (10_000, None, 4.0, 1)]
    assert key(chain) == key(ingest.rollup(first, 60_000)) == [(0, "a", 3.0, 2), (0, None, 4.0, 1)]
    foreign = samples.withColumn("chq_tid", F.lit(7).cast("long"))
    store = Store(spark, f"file://{tmp_path}/s")
    store.ingest(foreign, "metrics")
    assert not ingest.own_series(ingest.rollup(foreign, 10_000, True)) and len(store.rollup()) == 4
    hourly = store.read([r.path for r in store.live().where("frequency = 3600000").collect()])
    assert key(hourly) == [(0, "a", 7.0, 3)]


def test_changes_are_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for part in range(3):
        store.ingest(lines(spark).where(F.col("chq_id") % 3 == part), "logs", counts=False)
    before = store.versions()[-1]
    assert store.candidates("logs", 1000).count() == 12 and [r.hi for r in store.candidates("logs", 1000).collect()] == sorted((r.hi for r in store.candidates("logs", 1000).collect()), reverse=True)
    store.compact("logs")
    assert store.live().count() == 4 and store.live(before).count() == 12 and store.compact("logs") is None
    assert Engine(store=store).logql('{log_level=~".+"}', 0, 4 * DAY).count() == 400
    with pytest.raises(Conflict):
        store.commit(removed=["x"], after=before)
    assert store.vacuum() == 12 and Engine(store=store).logql('{log_level=~".+"}', 0, 4 * DAY).count() == 400
    gone = store.expire(4 * DAY, 1)
    assert len(gone) == 2 and store.live().count() == 2 and len(store.wipe("logs", 3 * DAY, 4 * DAY)) == 1


def test_empty_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/none")
    assert store.live().count() == 0 and store.compact("logs") is None and store.expire(0, 1) == [] and store.vacuum() == 0


def field(number, value, kind=2):
    key = varint(number << 3 | kind)
    return key + (varint(len(value)) + value if kind == 2 else varint(value) if kind == 0 else value)


def varint(n):
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def attribute(number, key, value):
    inner = field(1, value.encode()) if isinstance(value, str) else field(2, int(value), 0) if isinstance(value, bool) else field(3, value, 0) if isinstance(value, int) else field(4, struct.pack("<d", value), 1)
    return field(number, field(1, key.encode()) + field(2, inner))


def message(record_field, *records):
    resource, scope = field(1, attribute(1, "service.name", "shop") + attribute(1, "Host Name", "h1")), field(1, field(1, b"lib") + field(2, b"1.0"))
    return field(1, field(1, resource[2:]) + field(2, scope + b"".join(field(record_field, r) for r in records)))


def fixed(number, n):
    return field(number, n.to_bytes(8, "little"), 1)


def test_otlp_logs(spark, tmp_path):
    array = field(5, field(1, field(1, b"a")) + field(1, field(3, -2, 0)))
    one = fixed(1, 1_700_000_000_123_456_789) + field(3, b"warn") + field(5, field(1, b"hello")) + attribute(6, "http.status", 503) + attribute(6, "ok", True) + attribute(6, "took", 1.5) + field(6, field(1, b"list") + field(2, array))
    two = fixed(11, 5_000_000) + field(2, 17, 0) + field(5, field(6, field(1, field(1, b"k") + field(2, field(1, b"v")))))
    (tmp_path / "a.binpb").write_bytes(message(2, one))
    (tmp_path / "b.binpb.gz").write_bytes(gzip.compress(message(2, two)))
    rows = {r.chq_timestamp: r for name in ("a.binpb", "b.binpb.gz") for r in ingest.read_file(spark, str(tmp_path / name), "logs").collect()}
    a, b = rows[1_700_000_000_123], rows[5]
    assert (a.chq_tsns, a.log_level, a.log_message, a.resource_service_name, a.resource_host_name, a.scope_name) == (1_700_000_000_123_456_789, "WARN", "hello", "shop", "h1", "lib")
    assert (a.attr_http_status, a.attr_ok, a.attr_took, a.attr_list) == ("503", "true", "1.5", '["a",-2]')
    assert (b.log_level, b.log_message) == ("ERROR", '{"k":"v"}')
    (tmp_path / "bad.binpb").write_bytes(message(2, one)[:-3])
    with pytest.raises(Exception, match="cut short"):
        ingest.read_file(spark, str(tmp_path / "bad.binpb"), "logs").count()


def test_otlp_traces(spark, tmp_path):
    span = field(1, bytes(range(16))) + field(2, bytes(8)) + field(5, b"GET /u") + field(6, 2, 0) + fixed(7, 10_000_000) + fixed(8, 35_000_000) + attribute(9, "http.request.method", "GET") + field(15, field(2, b"no") + field(3, 2, 0))
    (tmp_path / "traces-raw").mkdir()
    (tmp_path / "traces-raw" / "t.binpb").write_bytes(message(2, span))
    row = Engine().read(str(tmp_path / "traces-raw" / "t.binpb"), spark=spark).first()
    assert (row.span_name, row.span_kind, row.span_duration, row.span_status_code, row.span_status_message, row.chq_timestamp) == ("GET /u", "server", 25, "ERROR", "no", 10)
    assert row.span_trace_id == bytes(range(16)).hex() and row.chq_fingerprint is not None and row.chq_telemetry_type == "traces"


def test_otlp_metrics(spark, tmp_path):
    at = fixed(3, 60_000_000_000)
    gauge = field(1, b"temp") + field(5, field(1, at + field(4, struct.pack("<d", 2.5), 1) + attribute(7, "zone", "a")) + field(1, at + field(6, struct.pack("<q", -3), 1)))
    histogram = field(1, b"lat") + field(9, field(1, at + fixed(4, 4) + field(6, struct.pack("<3Q", 1, 3, 0)) + field(7, struct.pack("<2d", 10, 20)) + attribute(9, "zone", "b")))
    summary = field(1, b"size") + field(11, field(1, at + fixed(4, 3) + field(5, struct.pack("<d", 9.0), 1) + field(6, field(1, struct.pack("<d", 0.0), 1) + field(2, struct.pack("<d", 1.0), 1)) + field(6, field(1, struct.pack("<d", 1.0), 1) + field(2, struct.pack("<d", 5.0), 1))))
    wide = field(1, b"exp") + field(10, field(1, at + fixed(4, 2) + field(5, struct.pack("<d", 6.0), 1) + field(6, 0, 0) + field(8, field(1, 2, 0) + field(2, varint(0) + varint(2)))))
    (tmp_path / "m.binpb").write_bytes(message(2, gauge, histogram, summary, wide))
    rows = {(r.metric_name, r.attr_zone, r.chq_rollup_sum): (r.chq_metric_type, r.chq_rollup_count, r.chq_rollup_min, r.chq_rollup_max) for r in otlp.read(spark, str(tmp_path / "m.binpb"), "metrics").collect()}
    assert rows == {("temp", "a", 2.5): ("gauge", 1, 2.5, 2.5), ("temp", None, -3.0): ("gauge", 1, -3.0, -3.0), ("lat", "b", 55.0): ("histogram", 4, 10.0, 20.0), ("size", None, 9.0): ("summary", 3, 1.0, 5.0), ("exp", None, 6.0): ("exponential_histogram", 2, 4.0, 8.0)}
    store = Store(spark, f"file://{tmp_path}/s")
    engine = Engine(store=store)
    engine.ingest(str(tmp_path / "m.binpb"), "metrics")
    engine.rollup()
    assert [(r.bucket_ts, r.value) for r in engine.promql('sum(temp{attr_zone="a"})', 0, 120_000, 60_000).collect()] == [(60_000, 2.5)]
    assert {(r.metric_name, r.metric_type) for r in engine.metrics_metadata(0, 120_000).collect()} == {("temp", "gauge"), ("lat", "histogram"), ("size", "summary"), ("exp", "exponential_histogram")}


def test_signals_by_path():
    paths = {"s3://b/logs-raw/x.json": "logs", "s3://b/traces-raw/a/b.binpb": "spans", "gs://b/otel-raw/org/metrics_123.binpb.gz": "metrics", "file:///x/other/y.csv": "logs", "s3://b/db/org/x.parquet": None}
    assert {p: ingest.signal_of(p) for p in paths} == paths


def test_ingest_debug_and_exemplar(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Data,Host,host\n1700000000,hi,h1,h2\n")
    row = Engine().read(str(tmp_path / "a.csv"), "logs", spark).first()
    assert (row.chq_timestamp, row.log_message, row.log_host, row.log_host_2) == (1_700_000_000_000, "hi", "h1", "h2")
    one = Engine(logs=lines(spark)).exemplar('{log_level="ERROR"}', 0, DAY).first()
    assert one.timestamp % (4 * DAY // 400) == 0 and one.tags["log_level"] == "ERROR" and "chq_timestamp" not in one.tags


def test_translators_and_names(spark):
    df = spark.createDataFrame([(1, "x")], "chq_timestamp long, resource_k8s_pod_name string")
    out = ingest.chained(ingest.constant_tags(env="prod"), ingest.constant_tags(team="a"))(df).first()
    assert (out.env, out.team) == ("prod", "a") and ingest.chained()(df) is df
    assert ingest.label_map(df) == {"resource.k8s.pod.name": "resource_k8s_pod_name"}


def test_json_lines_rules(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n  \n{"a": 2, "b": "x"}\n')
    assert sorted((r.a, r.b) for r in ingest.read_file(spark, str(tmp_path / "a.json")).collect()) == [(1, None), (2, "x")]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        ingest.read_file(spark, str(tmp_path / "bad.json")).count()
    (tmp_path / "long.json").write_text('{"a": "' + "y" * (1 << 20) + '"}\n')
    with pytest.raises(Exception, match="longer than"):
        ingest.read_file(spark, str(tmp_path / "long.json")).collect()


def test_groups_stay_in_one_file(spark, tmp_path):
    df = spark.range(3000).select(F.lit(0).cast("long").alias("chq_timestamp"), (F.col("id") % 40).alias("g"), F.col("id").alias("chq_tsns"))
    ingest.write_segments(df, str(tmp_path / "t"), "logs", max_rows=10, whole="g", order=[F.desc("chq_tsns")])
    files = spark.read.parquet(str(tmp_path / "t")).groupBy("g").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n"))
    assert files.count() == 40 and files.agg(F.max("n")).first()[0] == 1


def test_segments_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "b", "t1"), (1, "b", "t2"), (2, None, "t1"), (0, "a", "t1")], "chq_timestamp long, resource_service_name string, span_trace_id string")
    for signal, want in (("logs", [0, 1, 3, 2]), ("spans", [0, 2, 3, 1])):
        ingest.write_segments(df, str(tmp_path / signal), signal)
        assert [r.chq_timestamp for r in spark.read.parquet(str(tmp_path / signal)).collect()] == want


def test_accumulation_by_size_and_age(spark, tmp_path):
    schema, clock = "chq_timestamp long, k string", [0]
    for n, rows in enumerate([[(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (5, "c")], [(6, "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.accumulate(stream, out, str(tmp_path / "cp"), "logs", "k", 3, 1000, now=lambda: clock[0])
    written = lambda: sorted(r.chq_timestamp for r in spark.read.schema("chq_timestamp long, k string").option("recursiveFileLookup", "true").parquet(f"{out}/segments").collect())
    assert written() == [1, 2, 4] and sorted(r.chq_timestamp for r in jobs.waiting(spark, out, stream.schema).collect()) == [3, 5, 6]
    clock[0] = 2000  # the next batch finds b and c too old
    spark.createDataFrame([(7, "d")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "3"))
    jobs.accumulate(stream, out, str(tmp_path / "cp"), "logs", "k", 3, 1000, now=lambda: clock[0])
    assert written() == [1, 2, 3, 4, 5, 6]
    jobs.flush(spark, out, stream.schema, "logs")
    assert written() == [1, 2, 3, 4, 5, 6, 7]


def test_raw_objects(spark, tmp_path):
    for name in ("logs-raw/a.json", "metrics-raw/b.binpb", "otel-raw/o/traces_1.binpb", "db/x.parquet"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    jobs.run_once(jobs.raw_objects(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = {r.path.rsplit("/", 1)[1]: r.signal for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"a.json": "logs", "b.binpb": "metrics", "traces_1.binpb": "spans"}
