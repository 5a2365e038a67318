"""Sources and sinks of the pipelines: CSV, folders of files, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.sources import arrow


def read_csv(spark: SparkSession, path: str, schema: str, names: list[str] | None = None, header: bool = False, rows: int | None = None) -> DataFrame:
    """CSV files by a schema; names rename the columns, rows limits them."""
    out = spark.read.schema(schema).option("header", header).csv(path)
    out = out.toDF(*names) if names else out
    return out if rows is None else out.limit(rows)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("size"))


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Arrow IPC files, a task for each record batch."""
    return arrow.read(spark, path, schema)


def write_arrow(rows: DataFrame, path: str) -> None:
    """Arrow IPC files in a folder, one for each task."""
    arrow.write(rows, path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
