"""A graph derived from tables, kept as files and brought up to date file by file.

A graph is made of pieces. Each takes the rows of one table and makes triples of
them, key by key: rows of one key go into nothing but that key's triples. A store
holds segments: the triples of a piece, a folder for each predicate, with their
keys, and which keys each source file had. A snapshot names the files, by length
and time of change, and the segments.

Where files have come, changed or gone, the keys that they have, or had, are made
anew from the table as it is now and written as one more segment, which hides
those keys in the segments before it. Past MOST_SEGMENTS the piece is written
anew as a whole. Snapshots that are being read stay as they are.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.operators.graph import TRIPLE, Graph
from loomflow.stage import delete, shared_dir

MOST_SEGMENTS = 6
#: Name of the column that tells a triple's key.
KEY = "_key"


@dataclass(frozen=True)
class Piece:
    """Triples of a table's rows: make takes rows with the column KEY and returns triples with it."""

    table: str
    key: Callable[[], Column]
    make: Callable[[DataFrame], DataFrame]

    def rows(self, df: DataFrame) -> DataFrame:
        return df.withColumn(KEY, self.key().cast("string"))


def files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """(length, time of change) of the data files of a file or folder, by their paths without the store's name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = {}
    while found.hasNext():
        one = found.next()
        if not one.getPath().getName().startswith(("_", ".")):
            out[one.getPath().toUri().getRawPath()] = (one.getLen(), one.getModificationTime())
    return out


@dataclass
class _Segment:
    """A written part of a piece; hidden: folders of the keys that later segments make anew."""

    path: str
    hidden: list[str] = field(default_factory=list)


class Store:
    """The graph of a data folder, as large as its tables, in the shared folder of a session."""

    def __init__(self, spark: SparkSession, folder: str, pieces: list[Piece]) -> None:
        self.spark, self.folder, self.pieces = spark, folder, pieces
        self.root, self.n, self.lock = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", 0, threading.Lock()
        self.seen: list[dict] = [{} for _ in pieces]
        self.segments: list[list[_Segment]] = [[] for _ in pieces]

    def _path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def _write(self, piece: Piece, rows: DataFrame, sources: DataFrame) -> _Segment:
        out = _Segment(self._path())
        made = piece.make(rows)
        made.select(KEY, *TRIPLE.names).write.partitionBy("p").parquet(out.path + "/triples")
        name = F.parse_url(F.col("_metadata.file_path"), F.lit("PATH")).alias("file")
        sources.select(name, piece.key().cast("string").alias(KEY)).distinct().write.parquet(out.path + "/sources")
        return out

    def _refresh(self, n: int) -> None:
        piece, path = self.pieces[n], f"{self.folder}/{self.pieces[n].table}.parquet"
        now, before = files(self.spark, path), self.seen[n]
        if now == before:
            return
        self.spark.catalog.refreshByPath(path)
        whole = self.spark.read.parquet(path)
        come = [f for f in now if now[f] != before.get(f)]
        gone = [f for f in before if before[f] != now.get(f)]
        if not before or len(self.segments[n]) >= MOST_SEGMENTS or len(gone) == len(before):
            self.segments[n] = [self._write(piece, piece.rows(whole), whole)]
        else:
            name = F.parse_url(F.col("_metadata.file_path"), F.lit("PATH"))
            fresh = whole.where(name.isin(come))
            # a file's keys are those of the last segment that read it
            had = [self.spark.read.parquet(s.path + "/sources").where(F.col("file").isin(gone)).select(KEY) for s in self.segments[n]] if gone else []
            keys = self._path()
            reduce(DataFrame.union, had, fresh.select(piece.key().cast("string").alias(KEY))).where(f"{KEY} is not null").distinct().write.parquet(keys)
            changed = self.spark.read.parquet(keys)
            segment = self._write(piece, piece.rows(whole).join(changed, KEY, "left_semi"), fresh)
            for s in self.segments[n]:
                s.hidden = [*s.hidden, keys]
            self.segments[n] = [*self.segments[n], segment]
        self.seen[n] = now

    def graph(self) -> Graph:
        """The graph of the files as they are now; a pattern reads only the folders of its predicates."""
        parts = []
        with self.lock:
            for n in range(len(self.pieces)):
                self._refresh(n)
                for s in self.segments[n]:
                    rows = self.spark.read.schema(f"{KEY} string, " + ", ".join(f"{c} string" for c in TRIPLE.names)).parquet(s.path + "/triples")
                    for keys in s.hidden:
                        rows = rows.join(self.spark.read.parquet(keys), KEY, "left_anti")
                    parts.append(rows.select(*TRIPLE.names))
        return Graph(reduce(DataFrame.unionByName, parts))

    def drop(self) -> None:
        delete(self.spark, self.root)


_STORES: dict[tuple, Store] = {}
_LOCK = threading.Lock()


def stored(spark: SparkSession, folder: str, name: str, pieces: list[Piece]) -> Graph:
    """The graph of a data folder from the session's store, up to date with its files."""
    key = (spark.sparkContext.applicationId, name, folder)
    with _LOCK:
        store = _STORES.setdefault(key, Store(spark, folder, pieces))
    return store.graph()


def drop_stores(spark: SparkSession) -> None:
    """Delete what the session's stores have written."""
    with _LOCK:
        for key in [k for k in _STORES if k[0] == spark.sparkContext.applicationId]:
            _STORES.pop(key).drop()
