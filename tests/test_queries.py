"""A sample of the engine's queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from tellurion import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ["bucket_sum", "matchers", "rate_range", "sparse_range", "offset_diff", "binop_on", "set_or", "set_unless", "topk_per_step", "scalar_of", "histogram_quantile", "summary_filter", "log_count_by_level", "json_filter", "regexp_extract", "label_format_if", "line_format", "unwrap_duration", "unwrap_bytes", "raw_logs_limit", "spans_filter", "tag_names", "rollup_chain", "type_promotion", "segments_write_read", "stream_rollup"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str), sorted(columns)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    other = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(other.fetchall(), columns)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
