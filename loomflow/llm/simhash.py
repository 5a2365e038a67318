"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints become one row. Six blocks of bits, of which at most two can
differ between linked fingerprints, leave four equal ones: each fingerprint goes
to one index partition for each choice of four blocks. A partition sorts its
fingerprints by Gray rank, the kept blocks leading, so that neighbours share
long bit patterns. Upper nodes hold the bits that all below them share; a walk
down pairs of nodes adds up the differing shared bits and drops whole groups
that differ too much. A partition gives the links as a spanning forest, never
all pairs; components of these forests name the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.llm.common import Staged, column, free_name, text_of
from loomflow.llm.components import Forest, connected

WORDS = 3
DIFFERING = 2
SEED = 42
#: Bits of each block, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 8
_CHUNK = 1 << 14


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority of the bits of the shingles' hashes; 0 without a word."""
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) > words:
        grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    else:
        grams = [b" ".join(found)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: Column, keep: list[Column], words: int = WORDS) -> DataFrame:
    """The columns keep, and fp, the fingerprint's bits as a bigint."""
    base = docs.select(*keep, text.alias("text"))
    kept = base.columns[:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column("text")), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    schema = base.drop("text").schema.add("fp", T.LongType())
    return base.mapInArrow(each, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of FANOUT children that hold the bits shared below them.

    Only pairs of one key are sought: the leading key bits, which in Gray order
    stand together, or a key given for each. Of rows that are in known sets,
    only pairs of different sets are sought.
    """

    def __init__(self, fps: np.ndarray, key_bits: int = 0, keys: np.ndarray | None = None, sets: np.ndarray | None = None) -> None:
        rank = gray_rank(fps)
        self.order = np.argsort(rank, kind="stable") if keys is None else np.lexsort((rank, keys))
        x = fps[self.order]
        key = x >> np.uint64(64 - key_bits) if keys is None else keys[self.order]
        own = self.order if sets is None else sets[self.order]
        full = np.full(len(x), ~np.uint64(0))
        self.levels = [(x, full, key, key, own, own)]
        ones, any_ = x, x
        while len(ones) > 1:
            at = np.arange(0, len(ones), FANOUT)
            ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)
            first, last = self.levels[-1][2][at], self.levels[-1][3][np.minimum(at + FANOUT, len(self.levels[-1][3])) - 1]
            low, high = np.minimum.reduceat(self.levels[-1][4], at), np.maximum.reduceat(self.levels[-1][5], at)
            self.levels.append((ones, ~(ones ^ any_), first, last, low, high))

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the given array whose fingerprints differ in at most so many bits, some at a time."""
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        todo = [(top, zero, zero)]
        step = np.arange(FANOUT)
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            shared, mask, first, last, low, high = self.levels[level - 1]
            n = len(shared)
            for k in range(0, len(a), _CHUNK):
                ca = (a[k : k + _CHUNK, None, None] * FANOUT + step[:, None]) + np.zeros(FANOUT, np.int64)
                cb = (b[k : k + _CHUNK, None, None] * FANOUT + step) + np.zeros((FANOUT, 1), np.int64)
                ca, cb = ca.ravel(), cb.ravel()
                ok = (ca < n) & (cb < n) & ((ca < cb) if level == 1 else (ca <= cb))
                ca, cb = ca[ok], cb[ok]
                near = (last[ca] == first[cb]) | (ca == cb)
                ca, cb = ca[near], cb[near]
                near = np.bitwise_count((shared[ca] ^ shared[cb]) & mask[ca] & mask[cb]) <= most
                # both hold rows of one and the same set
                near &= (low[ca] != high[cb]) | (low[ca] != high[ca]) | (low[cb] != high[cb])
                if near.any():
                    todo.append((level - 1, ca[near], cb[near]))


def _choices(blocks: tuple[int, ...], differing: int) -> list[list[tuple[int, int]]]:
    """For each choice of blocks that stay equal: (first bit, bits) of these and then of the others."""
    starts = np.cumsum([0, *blocks]).tolist()
    spans = list(zip(starts, blocks, strict=False))
    out = []
    for kept in combinations(range(len(blocks)), len(blocks) - differing):
        out.append([spans[i] for i in kept] + [s for i, s in enumerate(spans) if i not in kept])
    return out


def _led(fps: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The words with the given spans of bits in this order, from the highest bit on."""
    out, at = np.zeros(len(fps), np.uint64), 64
    for first, bits in spans:
        at -= bits
        out |= ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
    return out


def links(fps: DataFrame, differing: int = DIFFERING, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Spanning forests (a, b) of the links between the distinct fingerprints in the column fp."""
    if sum(blocks) != 64 or len(blocks) <= differing:
        raise ValueError("the blocks must have 64 bits, and be more than the differing bits")
    choices = _choices(blocks, differing)
    equal = len(blocks) - differing
    keys = []
    for c, spans in enumerate(choices):
        mask = sum(((1 << bits) - 1) << first for first, bits in spans[:equal])
        keys.append(F.struct(F.lit(c).cast("tinyint").alias("choice"), F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(c)).alias("key")))
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.key").repartition("key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("choice").to_numpy(), b.column("fp").to_numpy().view("<u8")) for b in batches]
        if not got:
            return
        choice, all_fps = (np.concatenate(x) for x in zip(*got, strict=True))
        known, place = np.unique(all_fps, return_inverse=True)
        forest = Forest(len(known))
        for c, spans in enumerate(choices):
            at = np.unique(place[choice == c])
            if len(at) > 1:
                index = GrayIndex(_led(known[at], spans), sum(bits for _, bits in spans[:equal]))
                for a, b in index.pairs(differing):
                    forest.link(at[a], at[b])
        child = np.flatnonzero(forest.parent != np.arange(len(known)))
        signed = known.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[forest.parent[child]])], names=["a", "b"])

    return dealt.select("fp", "choice").mapInArrow(each, "a bigint, b bigint")


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, differing: int) -> DataFrame:
    """(id, hash, fp, component, component_id) of each row; a component is named by a fingerprint."""
    stage = Staged(docs.sparkSession, "simhash")
    text = text_of(docs, text_col)
    rows = stage.save(fingerprints(docs, text, [column(docs, id_col).alias("id"), F.xxhash64(text).alias("hash")], words))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    forest = links(rows.select("fp").distinct(), differing)
    member = connected(forest, stage)
    named = classes.join(member, classes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # saved before the join, so that Spark can split the rows of a fingerprint that many share
    of_fp = stage.save(named.join(first, "component").select(F.col("fp").alias("of"), "component", "component_id"))
    return rows.join(of_fp, rows["fp"] == of_fp["of"]).drop("of")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, differing: int = DIFFERING) -> DataFrame:
    """One row per row: id_col, fp and component_id, the smallest id that links reach.

    Null text is the empty text, whose fingerprint is 0. Null ids are members
    but name no group that has another id. Repeated rows are in one group. An
    empty table gives no rows. Other columns are not read.
    """
    found = _members(docs, id_col, text_col, words, differing)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, differing: int = DIFFERING) -> DataFrame:
    """docs with one row of each group: of the smallest id, null last; of repeated ids the smallest text hash, of equal rows any one."""
    return one_of_each(docs, _members(docs, id_col, text_col, words, differing), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each component, as keep_one() chooses it; found has the id, hash of the text and component of each row."""
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("best"))
    best = best.select(F.col("best.id").alias("of"), F.col("best.hash").alias("of_hash"))
    rank, text = free_name(docs, "rank"), free_name(docs, "hash")
    docs = docs.withColumn(text, F.xxhash64(text_of(docs, text_col)))
    # a text is in one group, so a row's id and text tell whether it is the one
    kept = docs.join(best, column(docs, id_col).eqNullSafe(best["of"]) & (docs[text] == best["of_hash"]), "left_semi")
    one = Window.partitionBy(column(kept, id_col), text).orderBy(text)
    return kept.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(rank, text)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and the group of every document."""
    from loomflow.session import table

    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
