"""Sums that do not depend on the order of the rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tellurion import catalog

BIG = [1e16, -1e16, 3e15, -3e15, 7e16, -7e16]
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, values, user=lambda i: i):
    """An `events` table of one type, its rows 11 seconds apart on 2024-01-01."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=11 * i), user(i), "view", v, '{"k": 1}') for i, v in enumerate(values)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return folder


def test_sums_are_rounded_once(spark):
    from tellurion.functions import exact

    random.seed(3)
    groups = {"cents": [round(random.uniform(0.01, 490), 2) for _ in range(500)], "wide": [math.ldexp(random.uniform(-1, 1), random.randint(-1074, 900)) for _ in range(80)]}
    groups |= {"lost": [1e16, 1.0, -1e16], "tie": [1.0, 2**-53], "above": [1.0, 2**-53, 2**-110], "below": [1 + 2**-52, 2**-53, -(2**-110)], "tiny": [5e-324, 5e-324, 1e-310], "slots": [65536.0, -65535.99999999999, 2.0**-16], "one": [0.1], "zero": [0.0, -0.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("null", None), ("some", None), ("some", 2.5), ("inf", math.inf), ("inf", 1.0), ("over", 1.7e308), ("over", 1.7e308)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r.k: (r.total, r.n) for r in exact.summed(df, {"k": F.col("k")}, F.col("v"), "total", {"n": (F.lit(1), F.count)}).collect()}
    assert found == {k: (math.fsum(v), len(v)) for k, v in groups.items()} | {"null": (None, 1), "some": (2.5, 2), "inf": (math.inf, 2), "over": (math.inf, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_unary_math_in_any_order(spark, tmp_path, seed):
    values = [7.3] * 40 + BIG
    random.Random(seed).shuffle(values)
    (row,) = catalog.queries()["unary_math"](spark, events(spark, tmp_path, values)).collect()
    s = math.fsum(values)
    assert (row.event_type, row.value) == ("view", round(math.sqrt(abs(math.ceil(s) - 200)) + math.log2(s) - math.copysign(1, math.floor(s) - 300), 6))


def test_rollups_of_the_metric_in_any_order(spark, tmp_path):
    """Values of one user within 10 s."""
    rows = [(i, datetime(2024, 1, 1), 1, "view", v, "{}") for i, v in enumerate([1e16, 1.0, -1e16])]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    from tellurion.sources import views

    (row,) = views.metrics(spark, tmp_path).collect()
    assert (row.chq_rollup_sum, row.chq_rollup_count, row.chq_rollup_min, row.chq_rollup_max) == (1.0, 3, -1e16, 1e16)


@pytest.mark.parametrize("values, total, mean", [([7.3] * 40 + BIG, 292.0, 6.3478), ([50.0] * 54 + [200.0, 218.29], 3118.29, 55.6838)])
def test_summary_filter_in_any_order(spark, tmp_path, values, total, mean):
    """Sums that adding in some order loses, and a mean of 55.68375 that no double holds."""
    random.Random(1).shuffle(values)
    (row,) = catalog.queries()["summary_filter"](spark, events(spark, tmp_path, values, lambda i: 1)).collect()
    assert (row.resource_k8s_pod_name, row["count"], row["sum"], row.avg) == ("pod-1", len(values), total, mean)
