"""Relational DDSketches: bins of logarithmic width as rows or arrays; merging adds counts per bin."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def bin_of(value: Column) -> Column:
    """Bin number; null for zero, negative and null values, which count apart."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(log(GAMMA))).cast("int"))


def bin_value(index: Column) -> Column:
    return F.pow(F.lit(GAMMA), index) * F.lit(2 / (GAMMA + 1))


def bins(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows (keys, bin, n) of a sketch per key; zero and negative values get the lowest bin."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.coalesce(bin_of(F.col(value)), F.lit(-(1 << 30))).alias("bin")).agg(F.count("*").alias("n"))


def merge(binned: DataFrame, keys: list[str]) -> DataFrame:
    return binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def quantiles(binned: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """One row per key with the named quantiles: the first bin whose running count exceeds q * (total - 1)."""
    order = Window.partitionBy(*keys).orderBy("bin")
    run = binned.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.when(F.col("bin") == -(1 << 30), F.lit(0.0)).otherwise(bin_value(F.col("bin")))
    pick = [F.min(F.when(F.col("_upto") > F.lit(min(max(q, 0.0), 1.0)) * (F.col("_all") - 1), value)).alias(name) for name, q in wanted.items()]
    return run.groupBy(*keys).agg(*pick)


#: log2 of the registers of cardinality sketches.
REGISTERS = 14


def cardinality(column: Column | str) -> Column:
    """Aggregate: a mergeable sketch (bytes, fit for storing) of a column's distinct values."""
    return F.hll_sketch_agg(column, F.lit(REGISTERS))


def merged(sketches: Column | str) -> Column:
    """Aggregate: the union of stored sketches."""
    return F.hll_union_agg(sketches)


def estimate(sketched: Column | str) -> Column:
    """The number of distinct values that a sketch has seen, as a double."""
    return F.hll_sketch_estimate(sketched).cast("double")
