"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The whole `documents` table, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


#: Rows of an Arrow batch, unless the session names another number than Spark's own.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Spark's 10,000 rows a batch are much memory, on both sides of the pipe to Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim
        return None


def trim() -> None:
    """Give freed memory of this process back to the machine, on which the JVM and other workers live too."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller zero-copy slices, so that Python never holds a whole Arrow batch as objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        trim()


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict], schema: str, arrow: pa.Schema, rows: int = 512) -> DataFrame:
    """mapInArrow of `kernel` (slice -> columns) over every row; narrow, no shuffle."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, rows):
            cols = kernel(piece)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name] for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(key, make: Callable):
    """What `make` gives for `key`, kept until this process asks for another key: of models with memos of words, a Python
    worker that serves many stages and operators holds one at a time."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def gathered(known: list[bytes], code: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `known[c]`, each an array as bytes, for every c of `code`, end to end, and how many each c gave."""
    whole = np.frombuffer(b"".join(known), kind)
    size = np.array(list(map(len, known)), np.int64) // np.dtype(kind).itemsize
    n = size[code]
    first = (np.cumsum(size) - size)[code]
    return whole[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fold(column: str, n: int):
    """crc32(column as text) mod n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may leave it unset, for tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or (spark.sparkContext.getCheckpointDir() or "")
    if not path and spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path.rstrip("/") or "file:///tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tellurion-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Room:
    """Tables of one operator's run in the shared folder, by name; those no longer needed are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_rows(df: DataFrame, mask: Callable[[list[str]], list[bool]], text_col: str = "text", rows: int = 256) -> DataFrame:
    """The rows of `df`, all its columns, whose text passes `mask` (texts -> booleans; null as the empty text); no shuffle."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, rows):
            if piece.num_rows:
                yield piece.filter(pa.array([bool(x) for x in mask(texts(piece, text_col))]))

    return df.mapInArrow(run, df.schema)
