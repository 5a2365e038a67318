"""Mixing sources to target weights by Pfair scheduling.

Documents of a source stand in the order of a hash and form blocks of a fixed
number of rows. Block j of a source that weighs the share w of all may not run
before slot floor(j / w) and must run before slot ceil((j + 1) / w); earliest
deadline first among the released blocks then keeps each source within one block
of its share at every slot, over the whole table: weights are exact fractions,
nothing is rounded to slots of a cycle.

The schedule is a table of blocks, not of rows. Blocks are as large as it takes
for there to be MOST_BLOCKS full ones at most, so the table has a bound that does
not grow with the rows, and it is joined.

When a source has no more blocks its slots stay empty and the others go on, so
no row is dropped. ``balanced`` marks the rows before the first such slot.

Only DataFrame functions run on the rows: two narrow shuffles number the rows
of each source in hash parts, so that a source of any size is dealt over many
tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column, free_name

#: Rows of a block, at least.
BLOCK_ROWS = 16
#: Full blocks of a table, at most: blocks double until no more remain.
MOST_BLOCKS = 1 << 20
#: More sources than this are refused: a number for each is held on the driver.
MAX_SOURCES = 100_000
#: Binary places of a weight that is a square root.
ROOT_PLACES = 20


def rows_of_a_block(n: int, least: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> int:
    """least, doubled until n rows make at most so many full blocks."""
    while n > least * most:
        least *= 2
    return least


def shares(weights: list[float | Fraction]) -> tuple[list[int], int]:
    """Whole numbers in the ratio of the weights, taken as the decimals they are written as, and their sum."""
    exact = [w if isinstance(w, Fraction) else Fraction(str(w)) for w in weights]
    if any(not w > 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    return whole, sum(whole)


def exact_schedule(blocks: list[int], weights: list[float | Fraction]) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of all blocks: earliest deadline first among released blocks, ties by the order of sources."""
    whole, total = shares(weights)
    waiting = [(0, s) for s, n in enumerate(blocks) if n]
    ready: list[tuple[int, int]] = []
    done, slot = [0] * len(blocks), 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // whole[s]), s))
        s = heapq.heappop(ready)[1]
        yield slot, s, done[s]
        slot += 1
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // whole[s], s))


def _placed(stage: Staged, counts: dict[str | None, int], weights: dict[str | None, float | Fraction], block_rows: int) -> tuple[DataFrame, int]:
    """(of, at, slot, first) of each source's blocks, and the first slot in which a source has no full block."""
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    sizes = [counts[s] for s in names]
    whole, total = shares([weights[s] for s in names])
    full = [n // block_rows for n in sizes]
    # where a source has no rest, its next block would be released here
    least = min((k * total // w for w, k, n in zip(whole, full, sizes, strict=True) if n == k * block_rows), default=1 << 62)
    rows, first = [], 0
    for slot, s, block in exact_schedule([-(-n // block_rows) for n in sizes], [Fraction(w) for w in whole]):
        rows.append((names[s], block, slot, first))
        if block == full[s]:
            least = min(least, slot)
        first += min(block_rows, sizes[s] - block * block_rows)
    shape = "of string, at bigint, slot bigint, first bigint"
    return stage.save(stage.spark.createDataFrame(rows, shape, verifySchema=False).coalesce(1)), least


def _rank(rows: DataFrame) -> DataFrame:
    """rows (id, source, row, mark) with the place of each in its source, from 0, in the order of mark and id."""
    rows = rows.withColumn("part", F.substring("mark", 1, 3))
    sizes = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4096 rows for each source
    starts = sizes.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "part").orderBy("mark", "id")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, numbered["source"].eqNullSafe(starts["of"]) & (numbered["part"] == starts["at"]))
    return joined.select("id", "source", "row", (F.col("first") + F.col("place")).cast("long").alias("rank"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float | Fraction] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int | None = None,
) -> DataFrame:
    """One row per row: id_col, source_col, block, slot, position, balanced.

    position numbers all rows from 0 in the mixed order. Without weights a
    source weighs the square root of its rows, to ROOT_PLACES binary places.
    Without block_rows a block has BLOCK_ROWS rows, or more where there would be
    over MOST_BLOCKS. Rows of null source are a source; null ids stand first in
    theirs; repeated rows get places of their own, in any order among
    themselves. Sources without a weight are refused, as are more than
    MAX_SOURCES. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, source_col).cast("string").alias("source"), F.lit(0).alias("row"))
    out = _positions(rows, weights, block_rows)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "slot", "position", "balanced")


def ordered(docs: DataFrame, into: str, weights: dict[str | None, float | Fraction] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None) -> DataFrame:
    """docs with each row's position in the mixed order, as mix() has it, in the column into.

    Every row stays, with all its columns, texts of any length, nulls and
    repeated rows included; an empty table stays empty.
    """
    stage = Staged(docs.sparkSession, "mixing")
    row = free_name(docs, "row")
    docs = stage.save(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, source_col).cast("string").alias("source"), F.col(row).alias("row"))
    places = stage.save(_positions(rows, weights, block_rows).select(F.col("row").alias(row), F.col("position").alias(into)))
    return docs.join(places, row).drop(row)


def _positions(rows: DataFrame, weights: dict[str | None, float | Fraction] | None, block_rows: int | None) -> DataFrame:
    """rows (id, source, row) with block, slot, position and balanced."""
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: Fraction(isqrt(n << 2 * ROOT_PLACES), 1 << ROOT_PLACES) for s, n in counts.items()}
    elif missing := counts.keys() - weights.keys():
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    block_rows = block_rows or rows_of_a_block(sum(counts.values()))
    ranked = _rank(rows).withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    placed, full = _placed(Staged(rows.sparkSession, "schedule"), counts, weights, block_rows)
    return _joined(ranked, placed, full, block_rows)


def _joined(ranked: DataFrame, placed: DataFrame, full: int, block_rows: int) -> DataFrame:
    """ranked with the slots and places of its blocks."""
    out = ranked.join(placed, ranked["source"].eqNullSafe(placed["of"]) & (ranked["block"] == placed["at"]))
    return out.select(
        "id",
        "source",
        "row",
        "block",
        "slot",
        (F.col("first") + F.col("rank") % block_rows).cast("long").alias("position"),
        (F.col("slot") < full).alias("balanced"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The place of every document when sources weigh the square root of their size."""
    from loomflow.session import table

    return mix(table(spark, sf_dir, "documents")).drop("balanced")


#: The weight of a source is the square root of its rows to 20 binary places; one block runs a step, earliest deadline first.
ORACLE_SQL = """
WITH RECURSIVE rows AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY mark, doc_id) - 1 AS rank FROM rows),
size AS (SELECT CAST(16 * pow(2, greatest(0, ceil(log2(greatest(1, count(*)) / 16777216.0)))) AS BIGINT) AS per_block FROM rows),
counts AS (SELECT source, count(*) AS n, CAST(floor(sqrt(count(*)) * 1048576) AS HUGEINT) AS w FROM rows GROUP BY source),
sources AS (SELECT source, (n + per_block - 1) // per_block AS blocks, w, sum(w) OVER () AS total,
    row_number() OVER (ORDER BY source NULLS FIRST) AS nth FROM counts, size),
edf AS (
    SELECT CAST(-1 AS HUGEINT) AS t, nth, blocks, w, CAST(total AS HUGEINT) AS total, CAST(0 AS HUGEINT) AS done, CAST(NULL AS HUGEINT) AS ran FROM sources
    UNION ALL
    SELECT now, nth, blocks, w, total,
        done + CASE WHEN first_value(nth) OVER urgent = nth THEN 1 ELSE 0 END,
        CASE WHEN first_value(nth) OVER urgent = nth THEN done END
    FROM (SELECT *, greatest(t + 1, min(CASE WHEN done < blocks THEN done * total // w END) OVER ()) AS now FROM edf)
    WHERE now IS NOT NULL AND EXISTS (SELECT 1 FROM edf WHERE done < blocks)
    WINDOW urgent AS (ORDER BY CASE WHEN done < blocks AND done * total // w <= now THEN 0 ELSE 1 END,
        ((done + 1) * total + w - 1) // w, nth)
),
placed AS (SELECT s.source, e.ran, e.t FROM edf e JOIN sources s USING (nth) WHERE e.ran IS NOT NULL)
SELECT r.doc_id, r.source, CAST(r.rank // per_block AS BIGINT) AS block, CAST(p.t AS BIGINT) AS slot,
    CAST(row_number() OVER (ORDER BY p.t, r.rank) - 1 AS BIGINT) AS position
FROM ranked r, size JOIN placed p ON p.source IS NOT DISTINCT FROM r.source AND p.ran = r.rank // per_block
"""
