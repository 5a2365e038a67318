"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and each shard has a
weight; a rack's or region's weight is the sum below it. A row descends level by
level: among the children of its node it takes the one with the smallest draw
``-ln(u) / weight``, where u is a hash of the row's key and the child's name.
A child's chance is its share of the weight, and a draw depends on that child
alone, so a change of weights moves rows only into or out of the subtrees whose
weights change. A new shard enters as a region of its own; thus rows move into
it and nowhere else.

Only Spark's built-in functions run; one narrow shuffle numbers the slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.llm.common import column, free_name

#: Rows of a shard are numbered in so many independent parts.
PARTS = 256


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 16, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Shards 0 to shards-1: the first base of them in racks and regions, each later one a region of its own."""
    per_region = per_rack * racks
    regions = -(-min(shards, base) // per_region)
    out = [Shard(s // per_region, s % per_region // per_rack, s) for s in range(min(shards, base))]
    return out + [Shard(regions + s - base, 0, s) for s in range(base, shards)]


def _children(shards: list[Shard], depth: int) -> dict[str, dict[int, float]]:
    """The children of each node at a depth, with the weights below them."""
    out: dict[str, dict[int, float]] = {}
    for s in shards:
        path = (s.region, s.rack, s.shard)
        level = out.setdefault("".join(f"/{p}" for p in path[:depth]), {})
        level[path[depth]] = level.get(path[depth], 0.0) + s.weight
    return out


def descend(df: DataFrame, key: Column, shards: list[Shard], into: str) -> DataFrame:
    """df with the shard of each row in the int column into; equal draws go to the smaller number."""
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has weight")
    path, child = F.lit(""), None
    at = free_name(df, "at")
    for depth in range(3):
        # a literal of the tree's size, not of the data's
        nodes = F.create_map(*[
            x
            for parent, below in sorted(_children(live, depth).items())
            for x in (F.lit(parent), F.array(*[F.struct(F.lit(f"{parent}/{c}").alias("name"), F.lit(float(w)).alias("weight"), F.lit(c).alias("child")) for c, w in sorted(below.items())]))
        ])

        def draw(x: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, x["name"]), 11)
            u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
            return F.struct((-F.log(u) / x["weight"]).alias("draw"), x["child"].alias("child"))

        child = F.array_min(F.transform(F.element_at(nodes, path), draw))["child"]
        df = df.withColumn(at, F.concat(path, F.lit("/"), child.cast("string")))
        path = F.col(at)
    return df.withColumn(into, F.substring_index(F.col(at), "/", -1).cast("int")).drop(at)


def assign(
    docs: DataFrame,
    shards: list[Shard],
    grown: list[Shard] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, shard, slot and, with grown, grown_shard.

    Null text counts as no bytes and has the checksum of the empty text. Rows
    with a null id take the text's checksum as their key. Repeated rows share
    a shard and get slots of their own; an empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    base = docs.select(
        column(docs, id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(column(docs, id_col).isNull(), F.crc32(text)).alias("other"),
    )
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text:"), F.col("other").cast("string")))
    base = base.withColumn("part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(PARTS)).cast("int"))
    base = descend(base, key, shards, "shard")
    if grown is not None:
        base = descend(base, key, grown, "grown_shard")
    # at most PARTS rows for each shard, whatever the number of documents
    sizes = base.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    rows = base.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "part"])
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
        *(["grown_shard"] if grown is not None else []),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 15 under the law ``key``, and where each would be with one shard more."""
    from loomflow.session import table

    out = assign(table(spark, sf_dir, "documents"), tree(16), tree(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
