"""Paths inside small groups of edges, in one row for each group.

Where no path leaves a group (a composition, an order), a group of up to MOST edges
is closed at once: its nodes are bits of a long, and a level of a search is a row of
such longs. No round is staged, and a table of edges is dealt once. What a group of
MOST edges gives is bounded by its nodes times MOST. Larger groups are for the
operators that double paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges of a group; its nodes, twice as many at most, fit a long.
MOST = 32


def sized(edges: DataFrame, by: list[str], ends: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(edges of small groups, all others), as plans; edges with nulls, and those of their groups, are others."""
    group = Window.partitionBy(*by)
    whole = F.lit(True)
    for c in (*by, *ends):
        whole = whole & F.col(c).isNotNull()
    told = edges.withColumn("_small", (F.count("*").over(group) <= MOST) & F.every(whole).over(group))
    return told.where("_small").drop("_small"), told.where("not _small").drop("_small")


def _shift(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def closed(edges: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, a, b, steps) of small groups of edges (by, a, b): the pairs that edges of the group link, by the fewest steps."""
    zero = F.lit(0).cast("long")
    rows = edges.groupBy(*by).agg(F.collect_set(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("edges"))
    rows = rows.withColumn("nodes", F.array_distinct(F.concat(F.transform("edges", lambda e: e["a"]), F.transform("edges", lambda e: e["b"]))))
    rows = rows.withColumn("at", F.sequence(F.lit(0), F.size("nodes") - 1))
    place = lambda x: F.array_position("nodes", x) - 1
    rows = rows.withColumn("arcs", F.transform("edges", lambda e: F.struct(place(e["a"]).alias("i"), _shift(place(e["b"])).alias("bit"))))
    rows = rows.withColumn("next", F.transform("at", lambda i: F.aggregate("arcs", zero, lambda bits, e: F.when(e["i"] == i, bits.bitwiseOR(e["bit"])).otherwise(bits))))

    def further(levels: Column, _: Column) -> Column:
        """The levels and one more: what the last one's nodes lead to and no level has, until there is nothing."""
        last = F.element_at(levels, -1)

        def step(bits: Column, i: Column) -> Column:
            led = F.aggregate("at", zero, lambda found, j: F.when(F.getbit(bits, j) == 1, found.bitwiseOR(F.get("next", j))).otherwise(found))
            fresh = led.bitwiseAND(F.bitwise_not(F.aggregate(levels, zero, lambda seen, level: seen.bitwiseOR(F.get(level, i)))))
            return F.when(bits == 0, bits).otherwise(fresh)

        return F.when(F.exists(last, lambda bits: bits != 0), F.concat(levels, F.array(F.transform(last, step)))).otherwise(levels)

    rows = rows.withColumn("levels", F.aggregate("nodes", F.array("next"), further))

    def pairs(level: Column, k: Column) -> Column:
        return F.flatten(F.transform(level, lambda bits, i: F.transform(F.filter("at", lambda j: F.getbit(bits, j) == 1), lambda j: F.struct(F.get("nodes", i).alias(a), F.get("nodes", j).alias(b), (k + 1).alias("steps")))))

    return rows.select(*by, F.inline(F.flatten(F.transform("levels", pairs))))


def walked(starts: DataFrame, successors: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, depth, node) along (by, node, to) of small groups from each (by, node), until there is no successor or a node comes again."""
    steps = successors.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("node", "to"))).alias("_steps"))
    rows = starts.select(*by, F.col("node").alias("start")).distinct().join(steps, by, "left")

    def further(path: Column, _: Column) -> Column:
        to = F.get(F.filter("_steps", lambda s: s["node"] == F.element_at(path, -1)), F.lit(0))["to"]
        return F.when(to.isNull() | F.array_contains(path, to), path).otherwise(F.concat(path, F.array(to)))

    path = F.when(F.col("_steps").isNull(), F.array("start")).otherwise(F.aggregate("_steps", F.array("start"), further))
    return rows.select(*by, "start", F.posexplode(path).alias("depth", "node")).withColumn("depth", F.col("depth").cast("long"))
