"""Tables written to the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ROOTS: list[str] = []
_TIDIED = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset (tests, a laptop) a local master gets a temporary folder;
    any other master must name one, as executors do not share local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomflow-"))


class Staged:
    """Tables written to the shared folder, to cut lineage and to be read again.

    A lost executor loses nothing of a written table. drop() removes a table
    that no later plan reads. rest is the least number of seconds between two calls
    of the collectors, for operators of many small tables.
    """

    def __init__(self, spark: SparkSession, name: str, rest: float = 0.0) -> None:
        self.spark, self.root, self.n, self.rest = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, rest
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        """df from where it was written; options are those of the parquet writer."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**options).parquet(path)
        self._tidied()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def _tidied(self) -> None:
        """What a table replaces leaves its shuffle files to the cleaner, which waits for the collectors: call them."""
        global _TIDIED
        if time.monotonic() - _TIDIED >= self.rest:
            gc.collect()
            self.spark._jvm.System.gc()
            _TIDIED = time.monotonic()

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df.staged_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, what operators stage inside: for results that are written there and read from where they were written."""
    before = len(_ROOTS)
    try:
        yield
    finally:
        for root in _ROOTS[before:]:
            delete(spark, root)
        del _ROOTS[before:]
