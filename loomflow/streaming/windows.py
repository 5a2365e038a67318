"""The time-series operators on streams.

Each takes a streaming table and gives a streaming table, with a watermark that
bounds the state; rows later than it are dropped. to_end() runs a query over
what is there now and returns the result as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def source(spark: SparkSession, path: str, schema: T.StructType | str, files_at_once: int = 1) -> DataFrame:
    """The files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every batch to a function, each once even after a restart where the function is idempotent by number; until the end of what is there."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def time_windows(stream: DataFrame, by: list[str], ts: str, size: str, slide: str | None, late: str, **features: Column) -> DataFrame:
    """Features of tumbling or sliding windows; a window closes when the watermark passes it."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    found = stream.withWatermark(ts, late).groupBy(*by, window.alias("window")).agg(*[c.alias(n) for n, c in features.items()])
    return found.select(*by, F.col("window.start").alias("start"), *features)


def chunks(stream: DataFrame, by: list[str], ts: str, gap: str, late: str, part: str = "hour") -> DataFrame:
    """(by, start, end, n): parts of the stretches in which each row follows less than a gap after the one before.

    A stretch ends with each hour, or other part of time, so that one key's rows
    are in many tasks and states; series.sessions() joins the parts of the result.
    """
    slice_of = F.date_trunc(part, F.col(ts)).alias("_slice")
    found = stream.withWatermark(ts, late).groupBy(*by, slice_of, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return found.select(*by, "start", "end", "n")


class _Intervals(StatefulProcessor):
    """Keeps the open interval of a key: its state, first and last time, and rows."""

    def __init__(self, ts: str, state: str) -> None:
        self.ts, self.column = ts, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string, start timestamp, last timestamp, n bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        now = self.open.get() if self.open.exists() else None
        out = []
        for pdf in rows:
            for at, value in pdf.sort_values(self.ts)[[self.ts, self.column]].itertuples(index=False):
                if now is not None and now[0] == value:
                    now = (value, now[1], at, now[3] + 1)
                    continue
                if now is not None:
                    out.append((*key, now[0], now[1], at, now[3]))
                now = (value, at, at, 1)
        if now is not None:
            self.open.update(now)
        yield pd.DataFrame(out, columns=["key", "state", "start", "end", "n"])

    def close(self) -> None:
        pass


def state_intervals(stream: DataFrame, by: str, ts: str, state: str) -> DataFrame:
    """(key, state, start, end, n) of the intervals that another state has ended; the open one of each key is carried between batches.

    Rows of a key are in order from batch to batch. Start the query inside rocks_db().
    """
    kind = stream.schema[by].dataType.simpleString()
    rows = stream.select(by, F.col(ts).cast("timestamp").alias(ts), F.col(state).cast("string").alias(state))
    return rows.groupBy(by).transformWithStateInPandas(
        statefulProcessor=_Intervals(ts, state), outputStructType=f"key {kind}, state string, start timestamp, end timestamp, n bigint", outputMode="append", timeMode="None"
    )


def to_end(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """The result over all that is there now, in parquet files beside the checkpoint; for results of any size.

    Where every batch tells the whole result, it takes the place of the one before.
    """
    path = checkpoint.rstrip("/") + "-result"
    if mode == "append":
        return to_table(stream, path, checkpoint)
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)
    told = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    told.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def to_table_counted(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """to_table(), and how many rows the watermark dropped before they reached a state: groups of a batch where partial sums come first."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(path), dropped


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """What state_intervals() needs: the state store on RocksDB, for queries that start inside. The session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The result over all that is there now, appended to parquet files; for results of any size."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
