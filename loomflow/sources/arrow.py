"""Arrow record batches as a data source: batch and stream reads by record batch, writes by task.

    spark.dataSource.register(ArrowBatches)
    spark.read.format("arrow_batches").schema("k int, v string").load(folder)
    df.write.format("arrow_batches").mode("append").save(folder)

Files are in Arrow's file format, whose footer tells where each batch begins: a
partition is one batch, read by its place, and no file is read as one value. Paths
are those of any store that pyarrow knows (local or shared folders, object stores).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIX = ".arrow"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def _files(path: str) -> list[str]:
    """The Arrow files at a path, by name."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.is_file:
        return [at]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(SUFFIX) and not f.base_name.startswith(("_", ".")))


def _batches(path: str, file: str) -> int:
    with _store(path)[0].open_input_file(file) as source, pa.ipc.open_file(source) as reader:
        return reader.num_record_batches


@dataclass
class _Batch(InputPartition):
    file: str
    number: int


def _read(path: str, schema: StructType, one: _Batch) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    with _store(path)[0].open_input_file(one.file) as source, pa.ipc.open_file(source) as reader:
        batch = reader.get_batch(one.number)
        columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in want]
        yield pa.RecordBatch.from_arrays(columns, names=want.names)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        found = [_Batch(f, n) for f in _files(self.path) for n in range(_batches(self.path, f))]
        return found or [_Batch("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are a file and a batch in it: all batches of the files of smaller names, and the file's before that one, are past.

    Files come in the order of their names, as writers name them by time.
    """

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "batch": 0}

    def latestOffset(self, *args) -> dict:  # noqa: ANN002, N802
        files = _files(self.path)
        return {"file": files[-1], "batch": _batches(self.path, files[-1])} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for f in _files(self.path):
            if start["file"] <= f <= end["file"]:
                first = start["batch"] if f == start["file"] else 0
                last = end["batch"] if f == end["file"] else _batches(self.path, f)
                out += [_Batch(f, n) for n in range(first, last)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition)


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _Writer(DataSourceArrowWriter):
    """Each task writes a file beside the folder's others and gives it its name when all have ended."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        import time

        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.stamp = f"{time.time_ns():020d}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        file = f"{at}/_{self.stamp}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
        want = to_arrow_schema(self.schema)
        n = 0
        with fs.open_output_stream(file) as sink, pa.ipc.new_file(sink, want) as writer:
            for batch in iterator:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, want.types, strict=True)], schema=want))
                n += batch.num_rows
        if not n:
            fs.delete_file(file)
        return _Written(file if n else "")

    def commit(self, messages: list) -> None:
        fs, _ = _store(self.path)
        for file in _files(self.path) if self.overwrite else []:
            fs.delete_file(file)
        for m in messages:
            if m and m.file:
                folder, _, name = m.file.rpartition("/")
                fs.move(m.file, f"{folder}/{name.lstrip('_')}")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.file:
                _store(self.path)[0].delete_file(m.file)


class ArrowBatches(DataSource):
    """Options: path. Without a schema it is the first file's."""

    @classmethod
    def name(cls) -> str:
        return "arrow_batches"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        path = self.options["path"]
        files = _files(path)
        if not files:
            raise FileNotFoundError(path)
        with _store(path)[0].open_input_file(files[0]) as source, pa.ipc.open_file(source) as reader:
            return from_arrow_schema(reader.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def read(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Rows of the Arrow files at a path, a task for each record batch. Columns that a file lacks are null; others are left out."""
    spark.dataSource.register(ArrowBatches)
    reader = spark.read.format("arrow_batches")
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The record batches of a folder as they come."""
    spark.dataSource.register(ArrowBatches)
    return spark.readStream.format("arrow_batches").schema(schema).load(path)


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows as Arrow files, one for each task that has rows."""
    rows.sparkSession.dataSource.register(ArrowBatches)
    rows.write.format("arrow_batches").mode(mode).save(path)
