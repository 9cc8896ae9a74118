"""Identities of spans and log messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def span_parts(df: DataFrame) -> Column:
    """What a span is known by, joined by ##: cluster, namespace and service (unknown where empty) and kind; then the system,
    operation and destination of messaging, the name, system, namespace, operation, server and collection of databases, the
    method and URL template of HTTP, or else the name."""
    p = lambda name: _part(df, name)
    known = lambda name: F.when(p(name) == "", "unknown").otherwise(p(name))
    base = [known("resource_k8s_cluster_name"), known("resource_k8s_namespace_name"), known("resource_service_name"), p("span_kind")]
    joined = lambda *names: F.concat_ws("##", *base, *map(p, names))
    return (
        F.when(p("attr_messaging_system") != "", joined("attr_messaging_system", "attr_messaging_operation_type", "attr_messaging_destination_name"))
        .when(p("attr_db_system_name") != "", joined("span_name", "attr_db_system_name", "attr_db_namespace", "attr_db_operation_name", "attr_server_address", "attr_db_collection_name"))
        .when(p("attr_http_request_method") != "", joined("attr_http_request_method", "attr_url_template"))
        .otherwise(joined("span_name"))
    )


def span_fingerprint(df: DataFrame) -> Column:
    return F.xxhash64(span_parts(df))


_MASKS = (
    (r"\x1B\[[0-9;]*[A-Za-z]", ""), (r'"(?:\\.|[^"\\])*"', "<quoted>"), (r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b", "<uuid>"), (r"\b\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*", "<time>"),
    (r"\b\w+://\S+", "<url>"), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<email>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"), (r"(?<![\w/])/[\w./-]+", "<path>"), (r"\b0x[0-9a-fA-F]+\b", "<hex>"), (r"\b\d+(?:\.\d+)?(?:ns|us|ms|s|m|h)\b", "<duration>"), (r"\b\w*\d\w*\b", "<number>"),
)


def message_template(message: Column, tokens: int = 15) -> Column:
    """The message's first tokens with variable parts masked: quoted text, ids, times, addresses, paths, numbers."""
    text = message
    for pattern, mask in _MASKS:
        text = F.regexp_replace(text, pattern, mask)
    words = F.filter(F.split(F.lower(text), r"[\s,;=()\[\]{}]+"), lambda w: w != "")
    return F.concat_ws(" ", F.slice(words, 1, tokens))


def message_fingerprint(message: Column) -> Column:
    return F.xxhash64(message_template(message))
