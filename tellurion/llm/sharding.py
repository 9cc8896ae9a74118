"""Operator 4: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The blocks are the input's partitions. How many rows of each block go to each shard follows the multivariate hypergeometric
law, drawn on the driver from the blocks' row counts alone (one number per partition); each block is permuted in place and
cut at the drawn counts, rows move to their shards, and each shard is permuted again. Every assignment that keeps the shard
sizes is then equally likely, and sizes are exact: they differ by one row at most. Permuted blocks are a table in the shared
folder, and permutations order rows by seeded 64-bit hashes of their numbers, so lost executors change nothing and equal
rows stay apart.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Room

_HALF_LOG_2PI = Decimal("0.91893853320467274178032973640561763986139747363778341282")


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Entry (b, s): rows of block b that go to shard s; block sums are `rows`, shard sums differ by one at most."""
    total = sum(rows)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.zeros((len(rows), shards), np.int64)
    for b, n in enumerate(rows):
        out[b] = _draw(rng, left, n)
        left -= out[b]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n rows without replacement from shards with `left` free places, by halves of the shard list."""
    total = int(left.sum())
    if n == 0 or len(left) == 1 or n == total:
        return left.copy() if n == total else np.array([n] if len(left) == 1 else [0] * len(left), np.int64)
    half = len(left) // 2
    a, b = int(left[:half].sum()), int(left[half:].sum())
    k = _hypergeometric(rng, a, b, n)
    return np.concatenate([_draw(rng, left[:half], k), _draw(rng, left[half:], n - k)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n places drawn without replacement are good: numpy's sampler up to its bound, `_large` above it."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _large(rng, good, bad, n)


def _log_factorials(*numbers: int) -> Decimal:
    """Sum of log k! by Stirling's series to about 40 digits (small k are multiplied out)."""
    total = Decimal(0)
    for k in numbers:
        shift, x = Decimal(1), k + 1
        while x < 200:
            shift, x = shift * x, x + 1
        z = Decimal(x)
        series, power = Decimal(0), z
        for a, b in ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400)):
            series += Decimal(a) / (b * power)
            power *= z * z
        total += (z - Decimal("0.5")) * z.ln() - z + _HALF_LOG_2PI + series - shift.ln()
    return total


def _large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The hypergeometric law of any size by rejection under a table mountain: a normal-like proposal around the mode and an
    exact test. Log-chances are compared in double precision, and where that cannot decide, with 50 digits."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    # Ratio of uniforms: k = mode + width * (v / u), accepted where u * u <= p(k) / p(mode).
    width = 2.0 * (sd + 1.0)
    parts = lambda k: (k, good - k, n - k, bad - n + k)
    with localcontext() as context:
        context.prec = 50
        top = None
        while True:
            u, v = 1.0 - rng.random(), 2.0 * rng.random() - 1.0
            k = mode + int(np.floor(width * v / u + 0.5))
            if not lo <= k <= hi:
                continue
            limit = 2.0 * log(u)
            # p(k) <= p(mode), and log-concave: the sum of ratios' logs between them, from double-double friendly differences.
            rough, slack = _log_ratio(parts(mode), parts(k))
            if rough - slack >= limit:
                return k
            if rough + slack < limit:
                continue
            top = _log_factorials(*parts(mode)) if top is None else top
            if float(top - _log_factorials(*parts(k))) >= limit:
                return k


def _log_ratio(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[float, float]:
    """log of the product of a! over the product of b!, and a bound of its rounding error."""
    first, second = sum(lgamma(x + 1.0) for x in a), sum(lgamma(x + 1.0) for x in b)
    return first - second, 1e-14 * (abs(first) + abs(second) + 1.0)


def numbered(rows: DataFrame, group: str, order: Column, sub_rows: int, most: int, name: str) -> DataFrame:
    """Adds `name`: the gapless position of each row in its group by `order` (a hash from 0 to 2**62), with no task that
    holds a whole group: groups, of `most` rows at most, are cut into ranges of the hash of about `sub_rows` rows, counted first."""
    parts = max(1, -(-most // sub_rows))
    cut = rows.withColumn("o", order).withColumn("p", F.floor(F.col("o") / F.lit((1 << 62) // parts + 1)).cast("int"))
    inside = F.row_number().over(Window.partitionBy(group, "p").orderBy("o", "b", "k")) - 1
    before = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(group, "p").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return cut.withColumn("i", inside).join(base, [group, "p"]).withColumn(name, (F.col("i") + F.col("base")).cast("long")).drop("o", "p", "i", "base")


def shard(rows: DataFrame, shards: int = 40, seed: int = 42, sub_rows: int = 20_000) -> DataFrame:
    """`rows` with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    Sizes of shards differ by one row at most. Equal rows spread over the shards as any others, so a group of copies, however
    large, never gathers in one task or shard. Nulls are values like others; an empty table gives no rows. Columns may have
    any names; input columns named shard or slot are replaced. Blocks are the input's partitions, so the draw depends on how the
    input is cut into partitions, not only on its rows.
    """
    spark, room = rows.sparkSession, Room(rows.sparkSession, "shards")
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    packed = rows.select(F.struct(*[rows[c] for c in own]).alias("row") if own else F.struct(F.lit(None).alias("none")).alias("row"))
    # A partition is permuted by sorting on hashes of its row numbers; row numbers taken again then hold block and position.
    mixed = packed.withColumn("h", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).sortWithinPartitions("h").withColumn("at", F.monotonically_increasing_id())
    source = room.write(mixed.select("row", F.shiftright("at", 33).cast("int").alias("b"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("k")), "blocks")
    counts = sorted((r["b"], r["count"]) for r in source.groupBy("b").count().collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = spark.createDataFrame([(b, own) for (b, _), own in zip(counts, np.cumsum(matrix, axis=1).tolist())], "b int, ends array<long>")
    # One short row per partition: up to a million numbers are broadcast, more are joined by a shuffle.
    ends = F.broadcast(ends) if matrix.size <= 1_000_000 else ends
    moved = source.join(ends, "b").withColumn("shard", F.expr("size(filter(ends, e -> e <= k))").cast("int")).drop("ends")
    most = int(matrix.sum(axis=0).max(initial=0))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "b", "k"), 2)
    return numbered(moved, "shard", order, sub_rows, most, "slot").select(*([F.col("row.*")] if own else []), "shard", "slot")
