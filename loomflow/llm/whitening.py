"""Embedding whitening from exact integer sums: digit-slice products.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. Of the distinct
x-vectors (the fit list) a first pass adds up the rows n and the sums S of every
dimension. A second pass centres each vector without rounding, u = n * x - S, and
multiplies: u is split into signed limbs of LIMB bits, so that every float64
product of two limb matrices is exact (a block's rows times 2**(2 * LIMB) stay
under 2**53); the products are recombined by shifts as whole numbers of any size
and added up over all blocks. Their total is n**3 times the covariance, of which
the driver takes the eigenvectors: one matrix of a vector's length squared for
each length.

A third pass measures the covariance of the whitened fit list itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits of a limb and rows of a block: LIMB * 2 and the bits of BLOCK are 52 together.
LIMB, BLOCK = 20, 4096
#: Entries beyond this count as this size; no long holds them.
MOST = float(1 << 62)


def whole(vectors: np.ndarray) -> np.ndarray:
    """x of rows of entries."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -MOST, MOST - 2048).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: int64 where all of it fits, else Python's whole numbers."""
    most = max((int(x.max()), -int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(u: np.ndarray) -> list[np.ndarray]:
    """float64 matrices of which the k-th counts 2**(LIMB * k); all digits but the last lie between 0 and 2**LIMB."""
    out, mask = [], (1 << LIMB) - 1
    while True:
        low, rest = u & mask, u >> LIMB
        if not (rest != np.where(rest < 0, -1, 0)).any():
            # what is left is a sign: the last limb keeps it
            return [*out, (low + (rest << LIMB)).astype(np.float64)]
        out.append(low.astype(np.float64))
        u = rest


def products(u: np.ndarray) -> np.ndarray:
    """Sum of u's rows' outer products, exact, as Python's whole numbers."""
    d = u.shape[1]
    total = np.zeros((d, d), object)
    for lo in range(0, len(u), BLOCK):
        parts = limbs(u[lo : lo + BLOCK])
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                p = (a.T @ parts[j]).astype(np.int64).astype(object)
                total += (p if i == j else p + p.T) << LIMB * (i + j)
    return total


def squared_lengths(u: np.ndarray) -> np.ndarray:
    """Sum of each row's squares, exact, as Python's whole numbers."""
    total = np.zeros(len(u), object)
    for lo in range(0, u.shape[1], BLOCK):
        parts = limbs(u[:, lo : lo + BLOCK])
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                total += np.einsum("rd,rd->r", a, parts[j]).astype(np.int64).astype(object) << (LIMB * (i + j) + (i != j))
    return total


def added(x: np.ndarray) -> np.ndarray:
    """Sums of x's columns, exact, as Python's whole numbers."""
    if len(x) and max(int(x.max()), -int(x.min())) < 1 << 50:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def _add(batches: Iterator[pa.RecordBatch], values) -> Iterator[pa.RecordBatch]:
    """One row for each vector length of a task: length, rows and the sums of values(x) as text, a whole number or float each."""
    held: dict = {}
    for batch in batches:
        lists = batch.column("x")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lengths = np.diff(ends)
        for d in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == d)
            at = (ends[rows] - ends[0])[:, None] + np.arange(d)
            for lo in range(0, len(rows), BLOCK):
                found = values(d, flat[at[lo : lo + BLOCK]])
                if d in held:
                    held[d] = (held[d][0] + len(at[lo : lo + BLOCK]), held[d][1] + found)
                else:
                    held[d] = (len(at[lo : lo + BLOCK]), found)
    for d, (n, sums) in held.items():
        text = [str(s) for s in sums.ravel().tolist()] if sums.dtype == object else [float(s).hex() for s in sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([text], pa.list_(pa.string()))], names=["d", "n", "sums"])


def _sums(fit: DataFrame, values, read) -> dict[int, tuple[int, list]]:
    """(rows, sums) of each vector length: added up in tasks, then a task's totals with others', a length at a time and element by element."""
    told = fit.select("x").mapInArrow(lambda batches: _add(batches, values), "d int, n bigint, sums array<string>")

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in table.column("sums"):
            now = [read(v) for v in row.as_py()]
            total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
        text = [v.hex() if isinstance(v, float) else str(v) for v in total]
        n = sum(table.column("n").to_pylist())
        return pa.table({"d": table.column("d")[:1], "salt": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([text], pa.list_(pa.string()))})

    shape = "d int, salt int, n bigint, sums array<string>"
    # in two steps, so that no task takes the totals of all
    for salts in (32, 1):
        told = told.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")).groupBy("d", "salt").applyInArrow(merge, shape)
    return {r["d"]: (r["n"], [read(v) for v in r["sums"]]) for r in told.collect()}


@dataclass
class Fit:
    """What whitens vectors of one length."""

    n: int
    sums: list[int]
    #: Columns are unit eigenvectors over the square root of their eigenvalue.
    axes: np.ndarray
    explained: list[float]
    error: float = 0.0

    def whitened(self, u: np.ndarray) -> np.ndarray:
        return (u / self.n).astype(np.float64) @ self.axes


def _fit(n: int, sums: list[int], cubed: list[int], d: int, components: int) -> Fit:
    """cubed holds n**3 times the covariance."""
    scale = n**3
    v = np.array([c / scale for c in cubed], np.float64).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = sum(cubed[:: d + 1]) / scale
    flat = values <= max(values[0], 0.0) * d * np.finfo(float).eps
    axes = np.where(flat, 0.0, vectors / np.sqrt(np.where(flat, 1.0, values)))
    return Fit(n, sums, axes, [0.0 if f else float(e / trace) for f, e in zip(flat, values, strict=True)])


def fits(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """How to whiten vectors of each length, from the distinct x-vectors (x)."""
    firsts = _sums(fit, lambda d, x: added(x) if d else np.zeros(0, object), int)
    firsts = {d: t for d, t in firsts.items() if d}
    outer = _sums(fit, lambda d, x: products(centred(x, *firsts[d])) if d else np.zeros(0, object), int)
    out = {d: _fit(n, sums, outer[d][1], d, components) for d, (n, sums) in firsts.items()}

    def squares(d: int, x: np.ndarray) -> np.ndarray:
        if not d:
            return np.zeros(0)
        z = out[d].whitened(centred(x, out[d].n, out[d].sums))
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    for d, (n, sums) in _sums(fit, squares, float.fromhex).items():
        if d:
            k = out[d].axes.shape[1]
            mean, second = np.array(sums[:k]) / n, np.array(sums[k:]).reshape(k, k) / n
            some = out[d].axes.any(axis=0)
            off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(some, some)]
            out[d].error = float(off.max(initial=0.0))
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries give no rows,
    nor do empty vectors and empty tables. Equal vectors count once in the fit and
    all get their rows; so do repeated and null ids. Vectors of different lengths
    are fitted apart. A component without variance has whitened and explained 0
    and does not count in identity_error. Entries whose x no long holds count as
    2**62. deviation is a decimal of 38 digits. Other columns are not read.
    """
    stage = Staged(df.sparkSession, "whitening")
    vector = column(df, vector_col).cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    clean = df.select(column(df, id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = pa.array(whole(lists.flatten().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), flat)], names=["x"])

    fit = stage.save(clean.select("v").mapInArrow(integers, "x array<bigint>").distinct())
    known = fits(fit, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            lengths = np.diff(ends)
            for d in np.unique(lengths[lengths > 0]).tolist():
                of = known[d]
                rows = np.flatnonzero(lengths == d)
                u = centred(whole(flat[(ends[rows] - ends[0])[:, None] + np.arange(d)]), of.n, of.sums)
                far = squared_lengths(u)
                z = of.whitened(u)
                k = z.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * k, of.n))]
                    + [pa.array([str(x) for x in far for _ in range(k)]), pa.array(z.ravel()), pa.array(np.tile(of.explained, len(rows))), pa.array(np.full(len(rows) * k, of.error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = clean.schema["id"].dataType.simpleString()
    out = clean.mapInArrow(project, f"id {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double")
    return out.select(F.col("id").alias(id_col), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Every vector on the first sixteen whitened components."""
    from loomflow.session import table

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
