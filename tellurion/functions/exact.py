"""Sums of doubles that are the same in every order of the rows: the exact sum of the values, rounded once.

A value is cut into three integers of 24 bits at a power of 2^16 near it, its slot. Integers add up without rounding, per key and
slot; a key has one row per slot that its values reach, and these are added with their rounding errors kept. Counts of up to 2^39
rows a key fit; beyond that a session with ANSI errors fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = (6, 30, 54)


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def _limbs(value: Column, slot: Column) -> list[Column]:
    """Integers a, b, c with value = 2^(16 slot) * (a / 2^6 + b / 2^30 + c / 2^54); scaled in two steps, as 2^1088 is no double."""
    scaled = value * _power(slot * -8) * _power(slot * -8) * 64.0
    second = (scaled - F.floor(scaled)) * float(1 << 24)
    return [F.floor(scaled), F.floor(second), F.floor((second - F.floor(second)) * float(1 << 24))]


def _terms(slots: str) -> str:
    """Slots' integer sums as doubles whose exact sum they are: halves of 32 bits, as a long may hold more than a double."""
    halves = [f"signum(e.s{k}) * {half} * pow(2D, e.slot * 8) * pow(2D, e.slot * 8 - {unit})" for k, unit in enumerate(_UNITS) for half in (f"shiftright(abs(e.s{k}), 32) * 4294967296D", f"cast(abs(e.s{k}) & 4294967295 AS double)")]
    return f"filter(flatten(transform({slots}, e -> array({', '.join(halves)}))), x -> x != 0)"


def _grown(terms: str) -> str:
    """Partials with the terms' exact sum, by rising size, none overlapping another: what rounding leaves of each addition is kept."""
    total = "(a.x + y)"
    part = f"({total} - a.x)"
    rest = f"((a.x - ({total} - {part})) + (y - {part}))"
    step = f"named_struct('x', {total}, 'kept', CASE WHEN {rest} != 0 THEN concat(a.kept, array({rest})) ELSE a.kept END)"
    none = "cast(array() AS array<double>)"
    return f"aggregate({terms}, {none}, (p, t) -> aggregate(p, named_struct('x', t, 'kept', {none}), (a, y) -> {step}, a -> concat(a.kept, array(a.x))))"


def _rounded(partials: str) -> str:
    """The double nearest to the partials' sum: added from the largest on until one leaves a rest, whose tie the next one decides."""
    step = "named_struct('hi', if(a.lo = 0, a.hi + y, a.hi), 'lo', if(a.lo = 0, y - ((a.hi + y) - a.hi), a.lo), 'next', if(a.lo != 0 AND a.next = 0, y, a.next))"
    last = "if(a.lo * signum(a.next) > 0 AND (a.hi + a.lo * 2D) - a.hi = a.lo * 2D, a.hi + a.lo * 2D, a.hi)"
    return f"aggregate(reverse({partials}), named_struct('hi', 0D, 'lo', 0D, 'next', 0D), (a, y) -> {step}, a -> {last})"


# sums beyond the largest double leave no number among the partials
_TERMS = _terms("sort_array(collect_list(if(n > 0, struct(slot, s0, s1, s2), null)))")
_TOTAL = f"CASE WHEN count(odd) > 0 THEN sum(odd) WHEN sum(n) = 1 THEN min(one) WHEN sum(n) > 1 THEN nanvl({_rounded(_grown(_TERMS))}, aggregate({_TERMS}, 0D, (a, x) -> a + x)) END"


def summed(df: DataFrame, keys: dict[str, Column], value: Column, name: str, more: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """df grouped by `keys` with `name`, the sum of `value` (null without values), and `more`: columns with their aggregate
    (sum, count, min or max). A value that is no number or infinite makes the sum what such values add up to."""
    value = value.cast("double")
    odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    plain = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())], F.when(~odd, value).alias("v"), F.when(odd, value).alias("odd"), *[c.alias(f"m{i}") for i, (c, _) in enumerate(more.values())])
    placed = plain.withColumn("slot", F.coalesce(F.floor(F.log2(F.abs("v")) / 16), F.lit(0)))
    names = [f"k{i}" for i in range(len(keys))]
    made = [f(F.col(f"m{i}")).alias(f"m{i}") for i, (_, f) in enumerate(more.values())]
    merged = [(F.sum if f is F.count else f)(F.col(f"m{i}")).alias(f"m{i}") for i, (_, f) in enumerate(more.values())]
    limbs = [F.sum(c).alias(f"s{k}") for k, c in enumerate(_limbs(F.col("v"), F.col("slot")))]
    slots = placed.groupBy(*names, "slot").agg(*limbs, F.count("v").alias("n"), F.min("v").alias("one"), F.sum("odd").alias("odd"), *made)
    # made within the aggregation: filters on a sum stay above it, and do not work it out again
    out = slots.groupBy(*names).agg(F.expr(_TOTAL).alias("v"), *merged)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("v").alias(name), *[F.col(f"m{i}").alias(c) for i, c in enumerate(more)])
