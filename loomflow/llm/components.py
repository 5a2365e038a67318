"""Connected components of a graph held in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged

#: Twice the rounds that the longest path of 2**62 nodes takes.
MOST_ROUNDS = 130
#: Edges that a task writes, about.
TASK_EDGES = 1 << 19


def connected(edges: DataFrame, stage: Staged) -> DataFrame:
    """(node, component) for each node of the edges (a, b), both bigint; a component is named by its smallest node.

    Alternates two star operations until nothing changes: each node links its
    larger neighbours to its smallest one, then its smaller neighbours and
    itself. Nodes are joined with one minimum for each, never gathered, so a
    node of any degree is dealt over many tasks.
    """
    # no fewer tasks than can run at a time, and no more files
    cores = max(1, stage.spark.sparkContext.defaultParallelism)
    now = stage.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(cores))
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = mark
        # a round makes at most two edges of each, two numbers a row: as many tasks write them as their number asks for
        tasks = -(-2 * mark[0] // TASK_EDGES) or 1
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        then = stage.save(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(tasks))
        stage.drop(now)
        now = then
    raise RuntimeError("the components did not settle")


class Forest:
    """Union-find over 0 to n-1 by arrays; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[i] and b[i], for every i."""
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up
