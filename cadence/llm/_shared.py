"""Helpers shared by the operators of this subpackage: shared tables and Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may run without that setting (tests): it gets a temporary folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="cadence-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


_OPEN: ContextVar[list["Scratch"] | None] = ContextVar("scratch folders of a stage", default=None)


@contextmanager
def passing() -> Iterator[None]:
    """Delete the intermediate tables made inside; whatever reads them is to be written inside too."""
    made: list[Scratch] = []
    before = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for scratch in made:
            scratch.drop("")


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive a lost executor.

    They stay until ``drop``, or until the end of a ``passing`` block: a result that is read later
    still needs them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/cadence-{name}-{uuid.uuid4().hex}"
        if (made := _OPEN.get()) is not None:
            made.append(self)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}" if table else self.base

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` as a Parquet table and return a DataFrame that reads it."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Numbers that ``likely`` broadcasts at most.
FILTER = 1 << 20


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``wanted``, so that a join moves few of them.

    Keys are hashed to FILTER numbers, and the ones that occur are broadcast: their number is bounded
    whatever ``wanted`` holds.  The join is still needed.
    """
    (number,) = free_names(rows, "number")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(FILTER)).cast("int")
    return rows.withColumn(number, bucket).join(F.broadcast(wanted.select(bucket.alias(number)).distinct()), number, "left_semi").drop(number)


def crc32_of_id(column: str) -> "F.Column":
    """CRC-32 of an id written as text, for fold rules."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and the n + 1 offsets of its values.

    A null counts as an empty text.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return the memory that Arrow and the C library keep for later; workers are many and live long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        sizes = np.asarray(column.cast(pa.large_binary()).fill_null(b"").to_numpy(zero_copy_only=False))
        ends = np.cumsum([len(x) for x in sizes])
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()
