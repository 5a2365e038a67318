"""Series of any length in many tasks.

A series is the rows of one key in an order. Rows are dealt to ranges of the key
and the order, so that one key's rows are in as many tasks as they fill; numbers
of rows at the ranges' ends, two for each range, tell where a range begins in its
series. Numbered rows fall into segments of SEGMENT rows. What needs neighbours
gets copies of those at the ends of the segments beside it; what carries a state
on, such as a session or a recursive filter, is worked out in each segment by
itself, combined over the segments and then finished.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.stage import Staged

#: Rows of a segment.
SEGMENT = 1 << 16


def _key(by: list[str]) -> Column:
    """One value for the key's columns; nulls are alike."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "_i") -> DataFrame:
    """rows with their places, from 0, in the series of their key; ties take places of their own, in any order."""
    ranged = rows.repartitionByRange(*by, *order) if by or order else rows
    ranged = ranged.sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = Staged(rows.sparkSession, "series").save(ranged).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    blocks = ranged.groupBy(_key(by).alias("_key"), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    # a key goes on from one range to the next: the first and the last block of each range tell
    edges = blocks.join(sizes, "_part").where("_first = 0 or _first + _n = _size").select("_part", "_key", "_first", "_n", "_size").collect()
    carried, run, last = [], 0, None
    for r in sorted(edges, key=lambda r: (r["_part"], r["_first"])):
        if r["_first"] == 0:
            run = run if repr(r["_key"]) == last else 0
            carried.append((r["_part"], run))
        if r["_first"] + r["_n"] == r["_size"]:
            run, last = (run if r["_first"] == 0 else 0) + r["_n"], repr(r["_key"])
    starts = rows.sparkSession.createDataFrame(carried, "_part bigint, _carry bigint")
    if not by:
        return ranged.join(starts, "_part").withColumn(into, F.col("_at") + F.col("_carry")).select(*rows.columns, into)
    own = blocks.select(F.col("_key").alias("_of"), F.col("_part").alias("_in"), "_first")
    placed = ranged.join(own, (_key(by) == F.col("_of")) & (F.col("_part") == F.col("_in"))).join(starts, "_part")
    at = F.col("_at") - F.col("_first") + F.when(F.col("_first") == 0, F.col("_carry")).otherwise(0)
    return placed.withColumn(into, at).select(*rows.columns, into)


def segmented(rows: DataFrame, reach: int, at: str = "_i") -> DataFrame:
    """Numbered rows with their segment `_seg`, and copies, not `_own`, for segments that have rows within reach."""
    last = F.floor((F.col(at) + reach) / SEGMENT).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col(at) - reach) / SEGMENT).cast("long"))
    return rows.withColumn("_seg", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_seg") == F.floor(F.col(at) / SEGMENT).cast("long"))


def neighbours(rows: DataFrame, by: list[str], order: list[str], reach: int) -> tuple[DataFrame, Window]:
    """Rows in segments with the neighbours in reach, and a window over one; `_own` rows have all of their neighbours."""
    return segmented(numbered(rows, by, order), reach), Window.partitionBy(*by, "_seg").orderBy("_i")


def sessions(parts: DataFrame, by: list[str], gap: str) -> DataFrame:
    """(by, start, end, n): disjoint parts of stretches (by, start, end, n) joined where the next one begins less than a gap after the end.

    Segments join their own parts. Only a stretch at a segment's end may go on in
    the next one; those are numbered and joined again, fewer by a segment's size
    each time.
    """
    stage = Staged(parts.sparkSession, "sessions")
    done, now = None, parts.select(*by, "start", "end", "n")
    while True:
        rows = numbered(now, by, ["start", "end"]).withColumn("_seg", F.floor(F.col("_i") / SEGMENT).cast("long"))
        w = Window.partitionBy(*by, "_seg").orderBy("_i")
        new = F.coalesce(F.col("start") >= F.lag("end").over(w) + F.expr(f"INTERVAL '{gap}'"), F.lit(True))
        runs = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = runs.groupBy(*by, "_seg", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max("_i").alias("_i"))
        edge = ((F.col("_run") == 1) & (F.col("_seg") > 0)) | (F.col("_i") == (F.col("_seg") + 1) * SEGMENT - 1)
        found = stage.save(found.select(*by, "start", "end", "n", edge.alias("_edge")))
        inner = found.where("not _edge").drop("_edge")
        done = inner if done is None else done.unionByName(inner)
        now = found.where("_edge").drop("_edge")
        if now.isEmpty():
            return done


class Recurrence:
    """A recursive filter's step, as a product: the state after a stretch is that of the stretch from rest, and the state before it times a power of `move`."""

    def __init__(self, b: list[float], a: list[float]) -> None:
        self.n = max(len(a), len(b)) - 1
        self.b, self.a = (np.array([float(v) for v in c] + [0.0] * (self.n + 1 - len(c))) for c in (b, a))
        self.move = np.zeros((self.n, self.n))
        if self.n:
            self.move[:, 0] = -self.a[1:]
            self.move[np.arange(self.n - 1), np.arange(1, self.n)] = 1

    def run(self, x: list[float], state: list[float]) -> tuple[list[float], list[float]]:
        """(output, last state); nulls count as not there: their output is null and the state stays."""
        b, a, state, out = self.b.tolist(), self.a.tolist(), [*state, 0.0], []
        for v in x:
            if v is None:
                out.append(None)
                continue
            y = b[0] * v + state[0]
            for k in range(self.n):
                state[k] = state[k + 1] + b[k + 1] * v - a[k + 1] * y
            out.append(y)
        return out, state[: self.n]

    def after(self, rows: int, before: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.move, rows) @ before + rest


def _before(parts: DataFrame, by: list[str], step: Recurrence) -> DataFrame:
    """(by, _seg, _state): the state before each of the stretches (by, _seg, _rows, _rest), which follow each other by _seg."""
    size, zero = SEGMENT, [0.0] * step.n
    grouped = parts.withColumn("_of", F.floor(F.col("_seg") / size).cast("long"))
    keys = parts.select(*by, "_seg").schema.fields
    if (parts.agg(F.max("_seg")).first()[0] or 0) < size:
        grouped = grouped.withColumn("_first", F.lit(None).cast("array<double>"))
    else:

        def fold(group: pa.Table) -> pa.Table:
            group = group.sort_by("_seg")
            state = np.array(zero)
            for n, rest in zip(group.column("_rows").to_pylist(), group.column("_rest").to_pylist(), strict=True):
                state = step.after(n, state, np.array(rest))
            rows = {c: group.column(c)[:1] for c in by}
            return pa.table(rows | {"_seg": group.column("_of")[:1], "_rows": pa.array([sum(group.column("_rows").to_pylist())], pa.int64()), "_rest": pa.array([state.tolist()], pa.list_(pa.float64()))})

        larger = grouped.groupBy(*by, "_of").applyInArrow(fold, parts.schema)
        first = _before(Staged(parts.sparkSession, "recurrence").save(larger), by, step)
        first = first.select(_key(by).alias("_for"), F.col("_seg").alias("_at"), F.col("_state").alias("_first"))
        grouped = grouped.join(first, (_key(by) == F.col("_for")) & (F.col("_of") == F.col("_at"))).drop("_for", "_at")

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("_seg")
        state, out = np.array(group.column("_first")[0].as_py() or zero), []
        for n, rest in zip(group.column("_rows").to_pylist(), group.column("_rest").to_pylist(), strict=True):
            out.append(state.tolist())
            state = step.after(n, state, np.array(rest))
        return group.select([f.name for f in keys]).append_column("_state", pa.array(out, pa.list_(pa.float64())))

    schema = parts.select(*by, "_seg", F.col("_rest").alias("_state")).schema
    return grouped.groupBy(*by, "_of").applyInArrow(scan, schema)


def filtered(rows: DataFrame, by: list[str], order: list[str], value: str, into: str, b: list[float], a: list[float]) -> DataFrame:
    """rows of each series through a recursive filter, from rest.

    Segments run from rest at first, which gives the state that each adds; those
    are combined over the segments, by segments again where there are many; then
    segments run from the states that they really begin with.
    """
    step, stage, zero, names = Recurrence(b, a), Staged(rows.sparkSession, "filtered"), [0.0] * max(len(a) - 1, len(b) - 1), rows.columns
    base = stage.save(numbered(rows, by, order).withColumn("_seg", F.floor(F.col("_i") / SEGMENT).cast("long")))

    def rest(group: pa.Table) -> pa.Table:
        x = group.sort_by("_i").column(value).to_pylist()
        keys = {c: group.column(c)[:1] for c in [*by, "_seg"]}
        return pa.table(keys | {"_rows": pa.array([len(x) - x.count(None)], pa.int64()), "_rest": pa.array([step.run(x, zero)[1]], pa.list_(pa.float64()))})

    shape = base.select(*by, "_seg", F.lit(0).cast("long").alias("_rows"), F.lit(None).cast("array<double>").alias("_rest")).schema
    before = _before(stage.save(base.groupBy(*by, "_seg").applyInArrow(rest, shape)), by, step)
    before = before.select(_key(by).alias("_for"), F.col("_seg").alias("_of"), "_state")
    joined = base.join(before, (_key(by) == F.col("_for")) & (F.col("_seg") == F.col("_of"))).drop("_for", "_of")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_i")
        out = step.run(group.column(value).to_pylist(), group.column("_state")[0].as_py())[0]
        return group.select(names).append_column(into, pa.array(out, pa.float64()))

    return joined.groupBy(*by, "_seg").applyInArrow(run, rows.withColumn(into, F.lit(None).cast("double")).schema)
