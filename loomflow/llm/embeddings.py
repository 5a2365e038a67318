"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned onto the principal axes of a bounded
sample; a rotation keeps every cosine, so the sample bears on speed alone. Each vector lives in the cell of the
nearest of a few centres of the sample and visits the other cells, one of each
two, that it can link into: its angle to their centre is at most theirs to their
farthest vector and that of the threshold. Large cells are dealt by hash into
groups. A task holds the vectors of one group and streams its visitors by. A block compares tiles: leading dimensions are summed first, and what the rest can add is at most
the product of the norms of the two remainders. A tile or a pair that cannot
reach the threshold any more is dropped; pairs that last to the end get their
cosine from the vectors as given. A block reports the number of links of each
vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column
from loomflow.llm.components import Forest, connected

THRESHOLD = 0.9
#: Bytes of a group's vectors, its fewest rows, and cells, at least and at most.
GROUP_BYTES, GROUP_ROWS, LEAST_CELLS, MOST_CELLS = 1 << 22, 1024, 12, 128
TILE = 512
#: Vectors that the principal axes are fitted on, at most.
SAMPLE = 4096
#: Dimensions after which remainders are bounded.
STEPS = (8, 16, 24, 32, 48)
_SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, of the largest spread first."""
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    return axes[:, ::-1].copy()


def centres(unit: np.ndarray, most: int) -> np.ndarray:
    """At most so many unit vectors, each in the middle of what is nearest to it; the first ones are far from each other."""
    chosen = [0]
    best = unit @ unit[0]
    while len(chosen) < most and best.min() < 1 - 1e-6:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    out = unit[chosen]
    for _ in range(4):
        of = (unit @ out.T).argmax(axis=1)
        total = np.zeros_like(out)
        np.add.at(total, of, unit)
        norm = np.linalg.norm(total, axis=1)
        out = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], out)
    return out


def visits(of: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Which way two of n cells meet: one of them visits the other, each half of the others."""
    step = (to - of) % n
    return (step > 0) & ((2 * step < n) | ((2 * step == n) & (of < to)))


class Tiles:
    """Unit vectors on the principal axes, in the order of the first, cut into tiles."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray) -> None:
        turned = unit @ axes
        self.order = np.argsort(turned[:, 0], kind="stable")
        self.x = turned[self.order]
        d = self.x.shape[1]
        self.cuts = [0, *(s for s in STEPS if s < d), d]
        energy = np.cumsum((self.x * self.x)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {c: np.sqrt(energy[:, c]) if c < d else np.zeros(len(self.x)) for c in self.cuts[1:]}
        self.spans = [(a, min(a + TILE, len(self.x))) for a in range(0, len(self.x), TILE)]
        lead = self.x[:, : self.cuts[1]]
        self.low = [lead[a:b].min(axis=0) for a, b in self.spans]
        self.high = [lead[a:b].max(axis=0) for a, b in self.spans]
        self.most = [float(self.rest[self.cuts[1]][a:b].max()) for a, b in self.spans]


def tile_pairs(a: Tiles, b: Tiles, s: int, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a.x and b.x of the pairs of two tiles that may reach the threshold."""
    corners = np.stack([p * q for p in (a.low[s], a.high[s]) for q in (b.low[t], b.high[t])])
    none = np.zeros(0, np.int64)
    if corners.max(axis=0).sum() + a.most[s] * b.most[t] < threshold - _SLACK:
        return none, none
    (a0, a1), (b0, b1) = a.spans[s], b.spans[t]
    total = np.zeros((a1 - a0, b1 - b0))
    i = j = sums = None
    for lo, hi in zip(a.cuts, a.cuts[1:], strict=False):
        ra, rb = a.rest[hi], b.rest[hi]
        if i is None:
            total += a.x[a0:a1, lo:hi] @ b.x[b0:b1, lo:hi].T
            live = total + np.outer(ra[a0:a1], rb[b0:b1]) >= threshold - _SLACK
            n = np.count_nonzero(live)
            if not n:
                return none, none
            if n * 10 < live.size or hi == a.cuts[-1]:
                i, j = np.nonzero(live)
                sums = total[i, j]
                i, j = i + a0, j + b0
        else:
            sums = sums + np.einsum("ij,ij->i", a.x[i, lo:hi], b.x[j, lo:hi])
            live = sums + ra[i] * rb[j] >= threshold - _SLACK
            i, j, sums = i[live], j[live], sums[live]
            if not len(i):
                return none, none
    return i, j


class Block:
    """The vectors of a group: their links among themselves and to visitors."""

    def __init__(self, uid: np.ndarray, raw: np.ndarray, axes: np.ndarray | None, threshold: float) -> None:
        self.uid, self.raw, self.threshold = uid, raw, threshold
        self.norm = np.linalg.norm(raw, axis=1)
        self.axes = axes if axes is not None and len(axes) == raw.shape[1] else np.eye(raw.shape[1])
        self.tiles = Tiles(raw / self.norm[:, None], self.axes)

    def links(self, other: Block | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(uid, links, uid of its root) of the vectors that link to another of the group or, if given, to a visitor."""
        a, b = self, other or self
        shift = len(a.uid) if other else 0
        uid = np.concatenate([a.uid, b.uid]) if other else a.uid
        count, forest = np.zeros(len(uid), np.int64), Forest(len(uid))
        for s in range(len(a.tiles.spans)):
            for t in range(0 if other else s, len(b.tiles.spans)):
                i, j = tile_pairs(a.tiles, b.tiles, s, t, self.threshold)
                if not other and s == t:
                    i, j = i[i < j], j[i < j]
                i, j = a.tiles.order[i], b.tiles.order[j]
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    cosine = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q])
                    p, q = p[cosine >= self.threshold], q[cosine >= self.threshold] + shift
                    count += np.bincount(p, minlength=len(uid)) + np.bincount(q, minlength=len(uid))
                    forest.link(p, q)
        at = np.flatnonzero(count)
        return uid[at], count[at], uid[forest.parent[at]]


def _scaled(v: np.ndarray) -> np.ndarray | None:
    """v times a power of two, so that its square neither overflows nor vanishes; None where a vector links with nothing."""
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing; nor do vectors of different lengths. Components of any
    finite size count. Repeated rows are vectors of their own that link.
    component_id is the smallest id reachable; null ids name no component that
    has another id, and are kept only alone. An empty table gives no rows. Other
    columns are not read. The threshold is above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and at most 1")
    spark = vectors.sparkSession
    stage = Staged(spark, "embeddings")
    base = vectors.select(column(vectors, id_col).alias("id"), column(vectors, vector_col).cast("array<double>").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                v = _scaled(x.values.to_numpy()) if x.is_valid and len(x) and not x.values.null_count else None
                out.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "v"])

    rows = base.mapInArrow(packed, base.schema["id"].dataType.simpleString().join(["id ", ", v binary"])).withColumn("uid", F.monotonically_increasing_id())
    rows = stage.save(rows)
    live = rows.where("v is not null").select("uid", "v")
    n = live.count()
    taken = live.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").collect()
    dims = sorted(len(r["v"]) for r in taken)
    axes, group_rows = None, GROUP_ROWS
    middle = np.zeros((0, 0))
    if dims:
        usual = dims[len(dims) // 2] // 8
        group_rows = max(GROUP_ROWS, GROUP_BYTES // (8 * usual))
        sample = np.array([np.frombuffer(r["v"]) for r in taken if len(r["v"]) == 8 * usual])
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        axes = principal_axes(sample)
        middle = centres(sample, min(MOST_CELLS, max(LEAST_CELLS, -(-n // group_rows))))
    apart = float(np.arccos(threshold))

    def angles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row, the rows of the usual length and their angles to all centres; other lengths have cells of their own, numbered from the last on."""
        held = batch.column("v").to_pylist()
        size = np.fromiter(map(len, held), np.int64, len(held)) // 8
        cell, at = len(middle) + size, np.flatnonzero(size == middle.shape[1])
        turn = np.zeros((0, len(middle)))
        if len(at):
            v = np.frombuffer(b"".join(held[k] for k in at.tolist())).reshape(len(at), -1)
            turn = np.arccos(np.clip(v / np.linalg.norm(v, axis=1, keepdims=True) @ middle.T, -1, 1))
            cell[at] = turn.argmin(axis=1)
        return cell, at, turn

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, at, turn = angles(batch)
            own = np.zeros(len(cell))
            own[at] = turn.min(axis=1) if len(at) else own[at]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own)], names=["cell", "angle"])

    # a row for each cell and for each other length of vectors
    known = {r["cell"]: r for r in live.mapInArrow(placed, "cell bigint, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}
    parts = {c: -(-r["n"] // group_rows) for c, r in known.items()}
    reach = np.array([known[c]["far"] + apart + _SLACK if c in known else -1.0 for c in range(len(middle))])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of each row and then those that it visits."""
        for batch in batches:
            cell, at, turn = angles(batch)
            mixed = (batch.column("uid").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (mixed % np.array([parts[c] for c in cell.tolist()], np.uint64)).astype(np.int64)
            to = [[c << 32 | p, *(c << 32 | q for q in range(parts[c]) if visits(np.int64(p), np.int64(q), parts[c]))] for c, p in zip(cell.tolist(), part.tolist(), strict=True)]
            if len(at):
                able = (turn <= reach) & visits(cell[at, None], np.arange(len(middle)), len(middle))
                for row, other in zip(*np.nonzero(able), strict=True):
                    to[at[row]] += [int(other) << 32 | q for q in range(parts[int(other)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], names=["uid", "v", "homes"])

    dealt = live.mapInArrow(homes, "uid bigint, v binary, homes array<bigint>").select("uid", "v", F.posexplode("homes").alias("visit", "home"))
    dealt = dealt.select("home", (F.col("visit") > 0).alias("visits"), "uid", "v").repartition("home").sortWithinPartitions("home", "visits", "uid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, group, held = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal group, held
            if not held:
                return
            table, held = pa.Table.from_batches(held), []
            raw = np.frombuffer(b"".join(table.column("v").to_pylist())).reshape(table.num_rows, -1)
            now = Block(table.column("uid").to_numpy(), raw, axes, threshold)
            found = now.links() if group is None else group.links(now)
            group = group or now
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["uid", "links", "root"])

        for batch in batches:
            of, visiting = batch.column("home").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero((of[1:] != of[:-1]) | (visiting[1:] != visiting[:-1])) + 1).tolist(), batch.num_rows]
            lo = 0
            for hi in ends:
                if hi == lo:
                    continue
                if of[lo] != home:
                    yield from flush()
                    home, group = of[lo], None
                elif visiting[lo] and group is None:
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
                lo = hi
                # visitors are compared as they come
                if group is not None and sum(b.num_rows for b in held) >= group_rows:
                    yield from flush()
        yield from flush()

    found = stage.save(dealt.mapInArrow(compare, "uid bigint, links bigint, root bigint"))
    links = found.groupBy("uid").agg(F.sum("links").alias("n_links"))
    member = connected(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), stage)
    joined = rows.select("uid", "id").join(links, "uid", "left").join(member.withColumnRenamed("node", "uid"), "uid", "left")
    joined = joined.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "component")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    from loomflow.session import table

    return near(table(spark, sf_dir, "embeddings"))
