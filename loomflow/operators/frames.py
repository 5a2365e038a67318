"""Operators of time-series and table pipelines.

Everything that depends on an order takes the ordering columns. Series whose keys
may be few and long (windows of rows, chunks, filters) are cut into segments by
series.py; the other windows are partitioned by a key with many values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.operators import series
from loomflow.stage import Staged

# joins


def axis_merge(rows: DataFrame, axis: str, axes: dict[str, Column], on: list[str], value: str) -> DataFrame:
    """One row for each key that all axes have: the inner merge of the rows of each axis.

    axes names the columns and tells which rows they take. Where an axis has
    several rows for a key, each combines with each, as in a merge.
    """
    frames = [rows.where(test).select(*on, F.col(value).alias(name)) for name, test in axes.items()]
    return reduce(lambda a, b: a.join(b, on), frames)


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """rows with the value that a mapping table has for the key; null where it has none."""
    found = table.select(F.col(key).alias("_key"), F.col(value).alias(into)).dropDuplicates(["_key"])
    return rows.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, into: str) -> DataFrame:
    """left with the latest value of right at or before its time, by key: one union and one window, no join of ranges."""
    own = left.withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    other = right.select(*by, ts, F.col(value).alias("_value")).withColumn("_left", F.lit(0))
    order = Window.partitionBy(*by).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other, allowMissingColumns=True)
    return both.withColumn(into, F.last("_value", ignorenulls=True).over(order)).where("_left = 1").drop("_left", "_value")


# aggregates


def most_frequent(rows: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones; nulls do not count.

    Counts are summed by value before groups, so a large group is not gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_best"))
    return best.select(*by, F.col("_best.v").alias(into))


def last_value(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last value of each column that is not null, by an explicit order."""
    at = F.struct(*order)
    return rows.groupBy(*by).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values])


def accuracy(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    return rows.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def at_least(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of the groups with at least n rows."""
    big = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")
    return rows.join(big, by, "left_semi")


def cardinality(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n, kind) for each key: none, one or many of the rows have it."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return keys.distinct().join(counts, key, "left").select(key, n.alias("n"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("kind"))


def aggregate_of(function: Callable[[list], object], returns: str):
    """A Python callable on the list of a group's values as an aggregate; a group's values are in one task."""

    @F.arrow_udf(returns)
    def each(values: pa.Array) -> float:
        return function(values.to_pylist())

    return each


# ordered analytics


def changed(value: str, by: list[str], order: list[str]) -> Column:
    """Whether a value differs from the one before; the first row counts as changed."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return before.isNull() | (F.col(value) != before)


def state_intervals(rows: DataFrame, by: list[str], ts: str, state: str, order: list[str] | None = None) -> DataFrame:
    """(by, state, start, end, n): maximal runs of one state, each up to the start of the next; the last ends at the last row."""
    order = order or [ts]
    w = Window.partitionBy(*by).orderBy(*order)
    runs = rows.withColumn("_run", F.sum(changed(state, by, order).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*by, "_run").agg(F.first(state).alias(state), F.min(ts).alias("start"), F.max(ts).alias("_last"), F.count("*").alias("n"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("_run")), F.col("_last"))
    return found.select(*by, state, "start", end.alias("end"), "n")


def count_windows(rows: DataFrame, by: list[str], order: list[str], value: str, size: int, step: int) -> DataFrame:
    """(by, start, values): windows of size rows that begin every step rows; what is left at the end is dropped.

    Each row goes to the windows it is in, size / step at most, so windows of a
    long series are gathered in parallel.
    """
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step).cast("long"))
    starts = F.transform(F.sequence(first, F.floor(F.col("_i") / step).cast("long")), lambda k: k * step)
    rows = series.numbered(rows.select(*by, *[c for c in order if c not in by], F.col(value).alias("_v")), by, order)
    dealt = rows.select(*by, "_v", "_i").withColumn("start", F.explode(F.filter(starts, lambda s: s > F.col("_i") - size)))
    lists = dealt.groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_rows"))
    return lists.where(F.size("_rows") == size).select(*by, "start", F.transform("_rows", lambda r: r["_v"]).alias("values"))


def time_windows(rows: DataFrame, by: list[str], ts: str, size: str, slide: str | None, **features: Column) -> DataFrame:
    """Features of tumbling or sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(*by, window.alias("window")).agg(*[c.alias(n) for n, c in features.items()])


def chunks(rows: DataFrame, by: list[str], ts: str, gap: str, least: str | None = None) -> DataFrame:
    """(by, start, end, n): stretches in which each row follows less than a gap after the one before, of at least a duration; null times count for none."""
    parts = rows.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.count("*").alias("n"))
    found = series.sessions(parts.select(*by, F.col(ts).alias("start"), F.col(ts).alias("end"), "n"), by, gap)
    return found.where(F.expr(f"end - start >= INTERVAL {least}")) if least else found


def first_and_last(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy(*by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def classified(rows: DataFrame, into: str, tests: list[Column], every: bool = True) -> DataFrame:
    """rows with 1 where all, or any, of the thresholds hold, else 0."""
    test = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests)
    return rows.withColumn(into, F.coalesce(test, F.lit(False)).cast("int"))


# signal filters


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> tuple[list[float], list[float]]:
    """Coefficients (b, a) of a digital Butterworth low-pass (high only) or band-pass filter.

    Poles of the analogue prototype, moved to the band and through the bilinear
    transform with prewarped edges.
    """
    import numpy as np

    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if low is None:
        edge = warp(high)
        poles, zeros, gain = poles * edge, np.zeros(0), edge**order
    else:
        a, b = warp(low), warp(high)
        width, centre = b - a, np.sqrt(a * b)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    fast = 2 * rate
    gain = gain * np.real(np.prod(fast - zeros) / np.prod(fast - poles))
    z = np.concatenate([(fast + zeros) / (fast - zeros), -np.ones(len(poles) - len(zeros))])
    p = (fast + poles) / (fast - poles)
    return (gain * np.real(np.poly(z))).tolist(), np.real(np.poly(p)).tolist()


def filtered(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, b: list[float], a: list[float]) -> DataFrame:
    """rows of each series through a recursive filter, from rest; series of any length."""
    return series.filtered(rows, by, order, value, into, b, a)


def gaussian(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """A Gaussian-weighted mean of the neighbours, as a window over a segment and the neighbours in reach; at the ends over those there are."""
    import math

    reach = int(truncate * sigma + 0.5)
    near, w = series.neighbours(rows, by, order, reach)
    terms = [(math.exp(-0.5 * (k / sigma) ** 2), F.lag(value, -k).over(w) if k else F.col(value)) for k in range(-reach, reach + 1)]
    total = reduce(lambda x, y: x + y, [F.coalesce(c * g, F.lit(0.0)) for g, c in terms])
    weight = reduce(lambda x, y: x + y, [F.when(c.isNotNull(), g).otherwise(0.0) for g, c in terms])
    return near.withColumn(into, total / weight).where("_own").select(*rows.columns, into)


# sorting and limits


def placed(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """rows with their places, from 0, in the order of the columns; ties take places of their own, in any order.

    Rows are dealt to ranges of the order and numbered in each; the sizes of the
    ranges, a row each, say where a range begins.
    """
    part = "_part"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(into, F.monotonically_increasing_id())
    ranged = Staged(rows.sparkSession, "placed").save(ranged).withColumn(part, F.shiftright(into, 33)).withColumn(into, F.col(into).bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy(F.col(part).alias("_of")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return ranged.join(F.broadcast(starts), F.col(part) == F.col("_of")).withColumn(into, F.col(into) + F.col("_first")).select(*rows.columns, into)


def head(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


# columns


def parse_time(text: Column) -> Column:
    """A time of day such as 13:05:59.25, on the first day of 1900."""
    return F.to_timestamp_ntz(F.concat(F.lit("1900-01-01 "), text), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def drop_null_columns(rows: DataFrame) -> DataFrame:
    """rows without the columns that hold any null; one pass that counts them all."""
    counts = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns]).first()
    return rows.select(*[f"`{c}`" for c in rows.columns if not counts[c]])


def flatten_json(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with JSON columns, by their schemas, spread into columns named column.field."""
    out = rows
    for c, schema in columns.items():
        parsed = out.withColumn(c, F.from_json(c, schema))
        out = parsed.select(*[f"`{x}`" for x in parsed.columns if x != c], *[F.col(c).getField(f.name).alias(f"{c}.{f.name}") for f in parsed.schema[c].dataType.fields])
    return out


def label_codes(rows: DataFrame, value: str, into: str) -> DataFrame:
    """rows with the place of each value among the sorted distinct ones, from 0.

    Distinct values are numbered apart from the rows and joined.
    """
    kinds = rows.select(F.col(value).alias("_v")).where("_v is not null").distinct()
    codes = placed(kinds, ["_v"], into)
    return rows.join(codes, F.col(value) == F.col("_v"), "left").drop("_v")


def inverted(mapping: Column) -> Column:
    """A map from values to keys; of equal values the last key, in the order of the map, counts."""
    entries = F.map_entries(mapping)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["value"] == e["value"]))
    return F.map_from_arrays(F.transform(last, lambda e: e["value"]), F.transform(last, lambda e: e["key"]))


def inverted_rows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(value, key) of a mapping held as rows: of equal values the largest key counts; null values map to nothing."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.max(key).alias(key))


def stacked(*axes: str) -> Column:
    """Arrays of equal length as an array of structs."""
    return F.arrays_zip(*axes)
