"""Best-fit packing with certified bin counts.

Documents become token ids; one of more than ``capacity`` tokens is cut into
pieces of that length, the shorter rest first. Whole pieces are sequences of
their own. The others are dealt to packing partitions of a bounded size, and
each partition runs best-fit decreasing. Lower bounds from dual feasible
functions certify a partition whose bin count they reach. The partitions with a
gap exchange documents: their bins that are not full are dealt anew, whole, to
mixed partitions, which rerun best-fit decreasing and keep the result where it
saves bins. The number of sequences never rises in an exchange.

With positions, consecutive ones share a packing partition, bins are exchanged
among neighbours only, and sequences are numbered by their first document.

Rows carry lengths, not texts, so a packing partition takes some hundred KB.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column, text_of

CAPACITY = 2048
#: Documents in a packing partition, on average.
PARTITION_ROWS = 4096
#: Exchanges between partitions with gaps.
EXCHANGES = 3
_BIN_BITS, _ROUND_BITS = 20, 36
#: Bits of a piece's number in its document, below the document's position.
_PIECE_BITS = 24
#: Packing partitions among which bins of ordered documents are exchanged, at most.
NEIGHBOURS = 8


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The byte-level BPE of a tokenizer file, with the ids that the tokenizers library gives.

    The file's ids are the ranks of its merges, so merging by rank, in a quarter
    of the time, gives the library's ids. Strings of added tokens in a text have
    ids of their own; texts that hold one go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = {t["content"] for t in told.get("added_tokens") or []}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in told["model"]["vocab"].items() if token not in added}
        self.path, self.added = path, tuple(added)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if any(a in text for a in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and the closing id 0."""
    return np.asarray([*encoder(path).ids(text), 0], dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(s, capacity) for s in range(rest, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, carry: str, position_col: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start, length and ids (array) or ids_crc32, as carry says; and position, if there is a column for it."""
    kind = {"ids": "ids array<int>", "ids_crc32": "ids_crc32 bigint"}[carry]
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"), *([column(docs, position_col).cast("bigint").alias("position")] if position_col else []))
    kept = [c for c in base.columns if c != "text"]
    id_type = base.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # ids are held for some rows at a time
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, piece, start, length, held = [], [], [], [], []
                for row, text in enumerate(part.column("text")):
                    ids = token_ids(text.as_py(), path)
                    for n, (s, k) in enumerate(cuts(len(ids), capacity)):
                        at.append(row)
                        piece.append(n)
                        start.append(s)
                        length.append(k)
                        own = ids[s : s + k]
                        held.append(own.astype(np.int32) if carry == "ids" else zlib.crc32(own.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(pa.array(at, pa.int64())) for c in kept),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(held, pa.list_(pa.int32()) if carry == "ids" else pa.int64()),
                    ],
                    names=[*kept, "piece", "start", "length", carry],
                )

    return base.mapInArrow(cut, f"id {id_type}, " + "position bigint, " * (position_col is not None) + f"piece int, start bigint, length bigint, {kind}")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of a family of dual feasible functions."""
    if not len(lengths):
        return 0
    x = np.sort(lengths.astype(np.int64))
    best = -(-int(x.sum()) // capacity)
    half = capacity // 2
    total = np.concatenate([[0], np.cumsum(x)])
    large = int(np.searchsorted(x, half, side="right"))
    # f_eps: items over capacity - eps count as a bin, items under eps as nothing
    for eps in np.unique(np.concatenate([[0], x[:large]])):
        whole = int(np.searchsorted(x, capacity - eps, side="right"))
        low = int(np.searchsorted(x, eps, side="left"))
        n_whole, n_mid = len(x) - whole, max(0, whole - large)
        free = n_mid * capacity - int(total[whole] - total[large]) if n_mid else 0
        small = int(total[large] - total[low]) if low < large else 0
        best = max(best, n_whole + n_mid + max(0, -(-(small - free) // capacity)))
    # u_k: sizes rounded down to multiples of 1/k, but for exact multiples of 1/(k+1)
    for k in range(1, 25):
        exact = (k + 1) * x % capacity == 0
        weight = np.where(exact, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(weight.sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the fullest bin that takes it."""
    out = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0  # bit r of free: some bin has r tokens left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            left, b, bins = capacity, bins, bins + 1
        left -= n
        out[i] = b
        if left:
            open_bins[left].append(b)
            free |= 1 << left
    return out


def _place(pdf: pd.DataFrame, bins: np.ndarray, base: int) -> pd.DataFrame:
    """Sequence and gapless offset of each item, in the order of pid within a bin."""
    pdf = pdf.assign(sequence_id=base + bins).sort_values(["sequence_id", "pid"], kind="stable")
    by = pdf.groupby("sequence_id")["length"]
    return pdf.assign(offset=by.cumsum() - pdf["length"], fill=by.transform("sum"))


def _pack_part(capacity: int, round_no: int, columns: list[str], in_order: bool = False):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bound = lower_bound(lengths, capacity)
        bins = best_fit_decreasing(lengths, capacity)
        now, before = int(bins.max()) + 1, pdf["sequence_id"].nunique() if round_no else None
        if before is None or now < before:
            base = ((round_no << _ROUND_BITS) + int(pdf["part"].iloc[0])) << _BIN_BITS
            pdf = _place(pdf, bins, base)
            if in_order:
                pdf = pdf.assign(sequence_id=pdf.groupby("sequence_id")["pid"].transform("min"))
        else:
            now = before
        return pdf.assign(part_bins=now, part_bound=bound)[columns]

    return pack


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
    carry: str = "ids",
    partition_rows: int = PARTITION_ROWS,
    exchanges: int = EXCHANGES,
    position_col: str | None = None,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, carry, sequence_id, offset, part_bins, part_bound.

    carry is ``ids`` (the tokens) or ``ids_crc32``. Null and empty texts have
    one token, the closing id. Repeated rows and null ids are packed like any
    others. An empty table gives no rows. Other columns are not read. part_bins
    and part_bound are the bins of the packing partition that the piece was
    dealt to last, and the proven least number for its documents.
    With position_col, which numbers the rows from 0, sequences follow its order.
    """
    spark = docs.sparkSession
    stage = Staged(spark, "packing")
    cut = pieces(docs, id_col, text_col, capacity, path or vocabulary_path(), carry, position_col)
    in_order = position_col is not None
    pid = F.shiftleft("position", _PIECE_BITS) + F.col("piece") if in_order else F.monotonically_increasing_id()
    cut = stage.save(cut.withColumn("pid", pid.cast("bigint")).drop("position"))
    none = F.lit(None).cast("bigint")
    whole = cut.where(F.col("length") == capacity).select("*", (F.col("pid") if in_order else -1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(1).cast("bigint").alias("part_bins"), F.lit(1).cast("bigint").alias("part_bound"))
    # the ids stay in the staged table; what is dealt are lengths
    wide = carry == "ids"
    items = cut.where(F.col("length") < capacity)
    if wide:
        items = items.select("pid", "length")
    given = items.columns
    columns = [*given, "part", "sequence_id", "offset", "fill", "part_bins", "part_bound"]
    n = items.count()
    parts = max(1, -(-n // partition_rows))
    n_docs = (cut.agg(F.max(F.shiftright("pid", _PIECE_BITS))).first()[0] or 0) + 1 if in_order else 0

    def nearby(key: str, parts: int, k: int) -> Column:
        """A packing partition of consecutive positions; those of odd rounds lie across the others' borders."""
        shift = n_docs // (2 * parts) if k % 2 else 0
        return F.floor((F.shiftright(key, _PIECE_BITS) + shift) / F.lit(n_docs) * parts).cast("bigint")

    part = nearby("pid", parts, 0) if in_order else F.pmod(F.xxhash64("pid"), F.lit(parts))
    items = items.select("*", part.alias("part"), *(none.alias(c) for c in columns[len(given) + 1 :]))
    schema = items.schema
    loose = stage.save(items.groupBy("part").applyInPandas(_pack_part(capacity, 0, columns, in_order), schema))
    done = []
    for k in range(1, exchanges + 1):
        gap = (F.col("part_bins") > F.col("part_bound")) & (F.col("fill") < capacity)
        done.append(loose.where(~gap))
        rows = loose.where(gap)
        if not (n := rows.count()):
            loose = None
            break
        # a bin moves whole, so that a partition knows how many bins its documents had
        fewer = -(-n // partition_rows)
        part = nearby("sequence_id", max(fewer, -(-parts // NEIGHBOURS)), k) if in_order else F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(fewer))
        moved = rows.withColumn("part", part)
        loose = stage.save(moved.groupBy("part").applyInPandas(_pack_part(capacity, k, columns, in_order), schema))
    if loose is not None:
        done.append(loose)
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    if wide:
        packed = cut.join(packed.drop("length"), "pid")
    out = [c for c in whole.columns if c != "pid"]
    both = whole.select(out).unionByName(packed.select(out))
    return both.withColumnRenamed("id", id_col)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    from loomflow.session import table

    return pack(table(spark, sf_dir, "documents"), carry="ids_crc32")
