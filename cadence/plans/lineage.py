"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables of each ``scratch`` that is open.
_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master may run without that setting: it gets a temporary folder.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = context._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="cadence-checkpoints-")
        context.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder.

    A lost executor costs nothing that is written; the tables stay until the folder is cleaned, or to
    the end of ``scratch``.  Joins deal the table out by key: Spark would judge by the size of the
    compressed files whether to broadcast it, and rows of a few of these MB can fill a driver.
    """
    path = f"{shared_folder(df.sparkSession)}/cadence-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _made[-1:]:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut within go at the end, and so do shuffle files that nothing refers to."""
    _made.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _made.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        jvm.System.gc()
