"""A stored set of telemetry tables with a versioned file catalog.

Files lie below `<root>/data`, and the catalog's versions are folders `<root>/catalog/v=<n>` of rows that add or remove files.
A version is written aside and renamed into place, so a change of many files is seen whole or not at all, and two writers
cannot both make the same version. Queries take the files of the fitting signal and tier whose time and fingerprints may match.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata
from ..plans.planner import COUNTS
from ..plans.syntax import Selector
from . import ingest
from .ingest import TIERS
from .views import label_columns

_SCHEMA = "action string, path string, signal string, frequency int, dateint int, lo long, hi long, rows long, bytes long, fingerprints array<bigint>, version long"
#: Labels that counts of log lines are kept by.
COUNT_LABELS = ("log_level", "resource_service_name")
SIGNALS = ("logs", "metrics", "spans")


class Conflict(RuntimeError):
    """Another writer made this version first."""


class Store:
    """Tables of logs, metrics (by tier) and spans below `root`, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, labels: tuple[str, ...] = metadata.INDEXED):
        self.spark, self.root, self.labels = spark, root.rstrip("/"), labels

    # Files

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def delete(self, paths: list[str]) -> int:
        """Delete files; how many were there."""
        found = 0
        for path in paths:
            fs, where = self._path(path)
            found += bool(fs.delete(where, True))
        return found

    def versions(self) -> list[int]:
        fs, where = self._path(f"{self.root}/catalog")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v="))

    # Catalog

    def live(self, version: int | None = None) -> DataFrame:
        """Catalog rows of the files that are there, now or as of a version."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return self.spark.createDataFrame([], _SCHEMA).drop("action")
        every = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.root}/catalog/v={v}" for v in known])
        gone = every.where("action = 'remove'").select("path").distinct()
        return every.where("action = 'add'").join(gone, "path", "left_anti").drop("action")

    def commit(self, added: DataFrame | None = None, removed: list[str] | None = None, after: int | None = None) -> int:
        """One more version with these changes; `after` is the version they were decided on, a later one is a Conflict."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        if after is not None and version != after + 1:
            raise Conflict(f"version {version - 1} came after {after}")
        parts = []
        if added is not None:
            parts.append(added.withColumn("action", F.lit("add")))
        if removed:
            parts.append(self.spark.createDataFrame([("remove", p) for p in removed], "action string, path string"))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("version", F.lit(version).cast("long"))
        have = dict(rows.dtypes)
        rows = rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in _SCHEMA.split(", "))])
        aside = f"{self.root}/catalog/.{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        fs, source = self._path(aside)
        target = self._path(f"{self.root}/catalog/v={version}")[1]
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise Conflict(f"version {version} is taken")
        return version

    def _write(self, df: DataFrame, signal: str, frequency: int, max_rows: int, order: list[Column] | None) -> DataFrame:
        """Files of rows, and their catalog. A column has one type in all files: labels are text, whole numbers long, others double."""
        folder = f"{self.root}/data/{signal}/{uuid.uuid4().hex}"
        labels = set(label_columns(df)) - {"frequency_ms", "span_duration", "span_end_ns", "hour"}
        kinds = {c: "string" if c in labels and not t.startswith(("map", "array", "struct")) else ingest.promote(t, t) for c, t in df.dtypes if c != "frequency_ms"}
        df = df.select(*[F.col(f"`{c}`").cast(kinds.get(c, "int")).alias(c) for c in df.columns])
        ingest.write_segments(df, folder, "logs" if signal == "counts" else signal, max_rows, order=order)
        stored = self.spark.read.parquet(folder)
        catalog = metadata.file_catalog(stored, self.labels)
        dated = F.regexp_extract("path", r"dateint=(\d+)", 1).cast("int")
        return catalog.withColumns({"signal": F.lit(signal), "frequency": F.lit(frequency), "dateint": dated})

    def add(self, df: DataFrame, signal: str, frequency: int = 0, max_rows: int = 1_000_000, order: list[Column] | None = None) -> int:
        """Write rows as segments and publish them."""
        return self.commit(self._write(df, signal, frequency, max_rows, order))

    # Ingestion and upkeep

    def ingest(self, df: DataFrame, signal: str, counts: bool = True) -> int:
        """Publish translated rows: metrics as 10 s rollups, logs with their counts per 10 s beside them (then the catalog gives the
        lines' files that frequency, else 0)."""
        if signal == "metrics":
            return self.add(ingest.rollup(df, TIERS[0], from_samples="value" in df.columns), signal, TIERS[0])
        if signal == "logs" and counts and set(COUNT_LABELS) <= set(df.columns):
            counted = df.groupBy((F.col("chq_timestamp") - F.pmod("chq_timestamp", F.lit(10_000))).alias("chq_timestamp"), *COUNT_LABELS).agg(F.count("*").alias(COUNTS))
            return self.commit(self._write(df, signal, 10_000, 1_000_000, None).unionByName(self._write(counted, "counts", 10_000, 1_000_000, None)))
        return self.add(df, signal)

    def rollup(self, upto: int = TIERS[-1]) -> list[int]:
        """Rebuild the coarser tiers of the days whose finer tier changed since; each tier from the one before."""
        made: list[int] = []
        own: set[int] = set()  # days whose series are known to be hashes of their labels, which rollups keep
        for fine, coarse in zip(TIERS, TIERS[1:]):
            if coarse > upto:
                break
            now = self.versions()[-1]
            live = self.live().where("signal = 'metrics'")
            newest = live.where(F.col("frequency") == fine).groupBy("dateint").agg(F.max("version").alias("fine"))
            there = live.where(F.col("frequency") == coarse).groupBy("dateint").agg(F.min("version").alias("coarse"))
            days = [r[0] for r in newest.join(there, "dateint", "left").where("coarse is null or coarse < fine").select("dateint").collect()]
            if not days:
                continue
            inputs = [r[0] for r in live.where((F.col("frequency") == fine) & F.col("dateint").isin(days)).select("path").collect()]
            old = [r[0] for r in live.where((F.col("frequency") == coarse) & F.col("dateint").isin(days)).select("path").collect()]
            rows = self.read(inputs).drop("hour")
            own |= set(days) if not own >= set(days) and ingest.own_series(rows) else set()
            rows = ingest.rollup(rows, coarse, own=own >= set(days))
            made.append(self.commit(self._write(rows, "metrics", coarse, 1_000_000, None), old, now))
        return made

    def candidates(self, signal: str, small: int, now_version: int | None = None) -> DataFrame:
        """Files of fewer than `small` rows, those of the latest time first: what recompaction takes."""
        return self.live(now_version).where((F.col("signal") == signal) & (F.col("rows") < small)).orderBy(F.desc("hi"), "path")

    def compact(self, signal: str, small: int = 500_000, max_rows: int = 1_000_000) -> int | None:
        """Rewrite the small files of each day and tier that has several, and swap them for the new ones in one version."""
        known = self.versions()
        if not known:
            return None
        several = self.candidates(signal, small).groupBy("frequency", "dateint").agg(F.collect_list("path").alias("paths")).where("size(paths) > 1")
        groups: dict[int, list[str]] = {}
        for r in several.collect():
            groups.setdefault(r["frequency"], []).extend(r["paths"])
        if not groups:
            return None
        added = []
        for frequency, paths in groups.items():
            rows = self.read(paths).drop("hour")
            rows = ingest.rollup(rows, frequency) if signal == "metrics" else rows
            added.append(self._write(rows, signal, frequency, max_rows, None))
        return self.commit(reduce(DataFrame.unionByName, added), [p for paths in groups.values() for p in paths], known[-1])

    def expire(self, now_ms: int, days: int, signals: tuple[str, ...] = (*SIGNALS, "counts")) -> list[str]:
        """Unpublish the files of days before day(now) - days - 1; returns their paths, which `vacuum` may delete."""
        oldest = int(self.spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(now_ms - (days + 1) * 86_400_000)), "yyyyMMdd")).first()[0])
        known = self.versions()
        old = [r[0] for r in self.live().where(F.col("signal").isin(*signals) & (F.col("dateint") < oldest)).select("path").collect()]
        if old:
            self.commit(removed=old, after=known[-1])
        return old

    def wipe(self, signal: str, start: int, end: int) -> list[str]:
        """Unpublish the files of a signal that overlap [start, end)."""
        known = self.versions()
        old = [r[0] for r in self.live().where((F.col("signal") == signal) & (F.col("lo") < end) & (F.col("hi") >= start)).select("path").collect()]
        if old:
            self.commit(removed=old, after=known[-1])
        return old

    def vacuum(self) -> int:
        """Delete the files that some version removed; queries planned on older versions then fail."""
        known = self.versions()
        if not known:
            return 0
        every = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.root}/catalog/v={v}" for v in known])
        return self.delete([r[0] for r in every.where("action = 'remove'").select("path").distinct().collect()])

    # Reading

    def read(self, paths: list[str]) -> DataFrame:
        """Rows of files, by name; files that were deleted meanwhile are passed over."""
        return self.spark.read.option("mergeSchema", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], "chq_timestamp long")

    def tiers(self, lo: int, hi: int, step: int, range_ms: int = 0) -> dict[int, int]:
        """For each day the coarsest tier that divides the step, the range and both ends, and is not older than the finer ones."""
        live = self.live().where((F.col("signal") == "metrics") & (F.col("lo") < hi) & (F.col("hi") >= lo - TIERS[-1]))
        known: dict[int, dict[int, tuple[int, int]]] = {}
        for r in live.groupBy("dateint", "frequency").agg(F.min("version").alias("a"), F.max("version").alias("b")).collect():
            known.setdefault(r["dateint"], {})[r["frequency"]] = (r["a"], r["b"])
        chosen = {}
        for day, there in known.items():
            best, newest = min(there), there[min(there)][1]
            for t in sorted(there):
                fresh = there[t][0] >= newest or t == min(there)
                newest = max(newest, there[t][1])
                if fresh and all(x % t == 0 for x in (step, range_ms, lo, hi)):
                    best = t
            chosen[day] = best
        return chosen

    def files(self, signal: str, selectors: list[Selector], start: int, end: int, tiers: dict[int, int] | None = None) -> DataFrame:
        """Catalog rows of the files that may hold rows of any of the selectors; of metrics those of each day's tier."""
        live = self.live().where(F.col("signal") == signal)
        if tiers is not None:
            live = live.where(F.concat_ws(":", "dateint", "frequency").isin([f"{d}:{f}" for d, f in tiers.items()]))
        longest = max((tiers or {0: 1}).values())  # a rollup's row stands at the start of its bucket
        return metadata.prune(live, selectors, start - longest + 1, end, self.labels)

    def scan(self, signal: str, selectors: list[Selector], start: int, end: int, tiers: dict[int, int] | None = None) -> DataFrame:
        """The table over these files. The list of paths, one per file that may match, is what the planner gathers. Without any,
        the table has the columns of some file and no rows."""
        paths = [r[0] for r in self.files(signal, selectors, start, end, tiers).select("path").collect()]
        if paths:
            return self.read(paths).drop("hour")
        some = self.live().where(F.col("signal") == signal).select("path").limit(1).collect()
        return self.read([r[0] for r in some]).drop("hour").where(F.lit(False))

    def source(self, signal: str):
        """What a planner reads leaves of queries from."""

        def table(s: Selector, lo: int, hi: int, step: int, by: tuple[str, ...], counts: bool) -> DataFrame:
            if signal == "metrics":
                return self.scan(signal, [s], lo, hi, self.tiers(lo, hi, step, s.range_ms))
            aligned = all(x % 10_000 == 0 for x in (step, lo, hi))
            if counts and aligned and metadata.can_use_aggregate(list(COUNT_LABELS), list(by), [m.label for m in s.matchers]) and self.counted(lo, hi):
                return self.scan("counts", [s], lo, hi)
            return self.scan(signal, [s], lo, hi)

        return table

    def counted(self, start: int, end: int) -> bool:
        """Whether all lines of the time have counts beside them."""
        return self.live().where("signal = 'logs' and frequency = 0").where((F.col("lo") < end) & (F.col("hi") >= start)).isEmpty()
