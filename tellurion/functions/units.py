"""Durations and sizes in text columns as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_SIZES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "eb": 10**18, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50, "eib": 2**60}


def duration_seconds(text: Column) -> Column:
    """'1h30m', '250ms', '-2s' in seconds; a bare number counts as seconds; null where the text is neither."""
    t = F.trim(text.cast("string"))
    # a unit that the text lacks costs no expression, and casting no text would throw and catch an error
    parts = []
    for u, k in _SECONDS.items():
        pattern = rf"(?:^|[a-zµ-])([0-9.]+){u}(?![a-zµ])"
        number = F.when(t.contains(u) & F.regexp_like(t, F.lit(pattern)), F.regexp_extract(t, pattern, 1).try_cast("double"))
        parts.append(F.coalesce(number, F.lit(0.0)) * F.lit(k))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    whole = F.regexp_like(t, F.lit(r"^-?([0-9.]+(ns|us|µs|ms|s|m|h))+$"))
    return F.when(whole, F.when(t.startswith("-"), -total).otherwise(total)).otherwise(t.try_cast("double"))


def size_bytes(text: Column) -> Column:
    """'3MiB', '10 kB' in bytes, units in any case; a bare number counts as bytes; null where the text is neither."""
    t = F.lower(F.trim(text.cast("string")))
    number, unit = F.regexp_extract(t, r"^([0-9.]+)\s*([a-z]*)$", 1).try_cast("double"), F.regexp_extract(t, r"^([0-9.]+)\s*([a-z]*)$", 2)
    factors = F.create_map(*[F.lit(x) for u, k in {"": 1, **_SIZES}.items() for x in (u, float(k))])
    return number * F.try_element_at(factors, unit)
