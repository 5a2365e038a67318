"""SimHash near-dedup where links are a Jaccard similarity of word shingles.

Texts of one set of shingles become one class with a fingerprint. Fingerprints of
sets that share four fifths differ in some ten bits, too many for blocks of equal
bits to deal them to index partitions; bands of minimum hashes deal them instead.
What meets is verified by the exact similarity of the sets.

Candidates of the index come in two rounds, so that a large group of near copies does not
make a pair of each two: first each class of a band meets the band's least one;
then the hierarchical index in Gray order finds, in each band, fingerprints of
different components that differ in at most BITS bits.

Bands and bits may miss a pair, seldom: one of the least similarity shares no band
once in 10**8 pairs, and sets of few shingles differ in more bits once in some 10**5.
A third round loses none. In one order of all shingles, frequent ones last, similar
sets have a shingle in common among the first fifth of both (and one more). Of these
first shingles only those that stand in different components are left; pairs that
meet under them are held to what they share there and to their places, or, under
shingles of more than CROWD sets, to their bitmaps, and verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column, text_of
from loomflow.llm.components import connected
from loomflow.llm.simhash import GrayIndex, majority, one_of_each

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Bands of so many minimum hashes each.
BANDS, ROWS = 48, 5
#: Differing bits of the fingerprints of similar sets, at most; about 10 are usual.
BITS = 26
#: Rows of a part of a band's nodes, on average, at most.
GROUP = 1 << 14
#: Bits of a set's bitmap.
MAP_BITS = 1 << 12
#: Sets of a first shingle whose pairs are counted one by one; of more, bitmaps tell which pairs can be similar, so many sets a part.
CROWD, CROWD_PART = 256, 1 << 10
#: Frequent shingles, which come last: of one text in so many, in so many of these at least, and so many shingles at most. They decide how many pairs meet, not which are found.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 1 << 20
_CHUNK = 512
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, some at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            yield batch.slice(lo, 512)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, in order; of all words where there are fewer; none without a word."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) > words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def bands(grams: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), _CHUNK):
        x = h[k : k + _CHUNK, None] ^ _FLIP
        x *= _TIMES
        np.minimum(least, x.min(axis=0), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    return mixed ^ mixed >> np.uint64(29)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have the least similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def bitmap(grams: np.ndarray) -> np.ndarray:
    """MAP_BITS bits, of which those of the shingles are set."""
    out = np.zeros(MAP_BITS // 8, np.uint8)
    at = (grams & np.uint64(MAP_BITS - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


def most_shared(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most shingles that two sets can share, by their bitmaps (rows of words) and sizes."""
    both = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64)
    # shingles beyond the first of a bit may be shared too
    return np.minimum(both + n_a - np.bitwise_count(a).sum(axis=1, dtype=np.int64), both + n_b - np.bitwise_count(b).sum(axis=1, dtype=np.int64))


def first_shingles(grams: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """Those of a set of which similar sets have one in common: in the order of their hashes, frequent ones (in order) last."""
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = np.concatenate([grams[~often], grams[often]])
    return grams[: len(grams) - math.ceil(least * len(grams) - 1e-9) + 1]


def _counted(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can be similar, by the first shingles that they share and their places in the order."""
    a, b = rows.select("token", *(F.col(c).alias(f"{c}_a") for c in _FIRST)), rows.select("token", *(F.col(c).alias(f"{c}_b") for c in _FIRST))
    wanted = F.ceil(F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    after = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
    met = a.join(b, "token").where((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")))
    # of a shared shingle all that are shared stand before or after it
    met = met.where((F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9) & (F.least("place_a", "place_b") + 1 + after >= wanted))
    both = met.groupBy("node_a", "node_b").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("size_a", "size_b", "place_a", "place_b")))
    # what is shared beyond the first shingles stands beyond those of one of both
    beyond = F.ceil(F.lit(least) * F.greatest("size_a", "size_b") - 1e-9) - 1
    return both.where((F.col("n") + after >= wanted) & (F.col("n") + beyond >= wanted)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


_FIRST = ("node", "component", "size", "place")


def _across(keys: DataFrame, bits: int, least: float, group: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes under a key, of different components, whose fingerprints differ in at most so many bits and whose bitmaps allow the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(*(b.column(c).to_numpy() for c in ("key", "node", "component", "fp", "size")), np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64)) for b in batches]
        if not got:
            return
        key, node, component, fp, size, maps = (np.concatenate(x) for x in zip(*got, strict=True))
        maps = maps.reshape(len(key), -1)
        for i, j in GrayIndex(fp.view(np.uint64), keys=key, sets=component).pairs(bits):
            apart = component[i] != component[j]
            i, j = i[apart], j[apart]
            for k in range(0, len(i), 8 * _CHUNK):
                p, q = i[k : k + 8 * _CHUNK], j[k : k + 8 * _CHUNK]
                shared = most_shared(maps[p], maps[q], size[p], size[q])
                able = shared >= least * (size[p] + size[q] - shared) - 1e-9
                a, b = node[p[able]], node[q[able]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    # only keys of which the nodes are in several components are left; large groups are dealt out by pairs of parts
    several = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", F.ceil(F.col("n") / (group or GROUP)).alias("parts"))
    parted = keys.join(several, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = parted.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "component", "fp", "bits", "size")
    return dealt.repartition("key").mapInArrow(each, "a bigint, b bigint").distinct()


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """(id, hash, component) of each row; a component is named by a class of texts, hash is of the text.

    Equal texts, repeated rows included, are one class; null texts are empty ones,
    and all texts without words are alike. Texts of fewer words than a shingle are
    one shingle. Null ids are kept. An empty table gives no rows. Other columns
    are not read.
    """
    stage = Staged(docs.sparkSession, "shingles")
    text = text_of(docs, text_col)
    base = docs.select(column(docs, id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            node, fp, keys = [], [], []
            for x in part.column("text"):
                grams = shingles(x.as_py(), words)
                node.append(xxhash.xxh64_intdigest(grams.tobytes()))
                fp.append(majority(grams))
                keys.append(bands(grams).view(np.int64) if len(grams) > 1 else None)
            numbers = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), *numbers, pa.array(keys, pa.list_(pa.int64()))], names=["id", "hash", "node", "fp", "keys"])

    rows = stage.save(base.mapInArrow(sketch, f"id {id_type}, hash bigint, node bigint, fp bigint, keys array<bigint>"))
    # one row of each class has its text read again
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("one")
    classes = rows.groupBy("node").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), one)
    keys = classes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    keys = stage.save(keys.join(shared, "key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [shingles(x.as_py(), words) for x in part.column("text")]
            held = [pa.array([f(x) for x in found], pa.binary()) for f in (np.ndarray.tobytes, lambda x: bitmap(x).tobytes())]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("fp"), *held], names=["node", "fp", "grams", "bits"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        # saved, so that Spark sees whether they are few, and then does not deal the texts
        wanted = stage.save(nodes.join(classes.drop("keys"), "node").select("node", "fp", F.col("one.id").alias("of"), F.col("one.hash").alias("of_hash")))
        asked = base.join(wanted, base["id"].eqNullSafe(wanted["of"]) & (base["hash"] == wanted["of_hash"])).select("node", "fp", "text")
        return stage.save(asked.mapInArrow(sets, "node bigint, fp bigint, grams binary, bits binary").groupBy("node").agg(*(F.min(c).alias(c) for c in ("fp", "grams", "bits"))))

    known = sets_of(keys.select("node").distinct())

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), least) for pair in zip(a, b, strict=True)], pa.bool_())

    def verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
        left, right = (known.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
        return stage.save(pairs.join(left, "a").join(right, "b").where(linked("a_grams", "b_grams")).select("a", "b"))

    links = verified(keys.select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), known)
    of = connected(links, stage).select(F.col("node").alias("of"), "component")
    placed = keys.join(of, keys["node"] == of["of"], "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    drawn = lambda known: known.select("node", "fp", "bits", (F.octet_length("grams") / 8).cast("bigint").alias("size"))
    others = verified(_across(placed.join(drawn(known), "node"), bits, least), known)
    links = links.union(others)
    of = stage.save(connected(links, stage).select(F.col("node").alias("of"), "component"))

    # the third round: what bands and bits have missed
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x.as_py(), words) for x in part.column("text")]).view(np.int64))], names=["token"])

    some = base.where(F.pmod("hash", F.lit(SAMPLE)) == 0).select("hash", "text").dropDuplicates(["hash"]).select("text")
    often = some.mapInArrow(counted, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r["token"] for r in often.select("token").collect()], np.int64).view(np.uint64))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets_ = [shingles(x.as_py(), words) for x in part.column("text")]
            tokens = [first_shingles(g, frequent, least) if len(g) else g for g in sets_]
            n = [len(x) for x in tokens]
            numbers = np.concatenate(tokens), np.repeat(np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in sets_], np.uint64), n)
            sizes = np.repeat(np.array([len(g) for g in sets_], np.int32), n), np.concatenate([np.arange(x, dtype=np.int32) for x in n])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in numbers), *map(pa.array, sizes)], names=["token", "node", "size", "place"])

    def several(rows: DataFrame, column: str) -> DataFrame:
        own = Window.partitionBy("token")
        return rows.withColumn("low", F.min(column).over(own)).withColumn("high", F.max(column).over(own)).where("low <> high").drop("low", "high")

    first = several(base.select("text").mapInArrow(firsts, "token bigint, node bigint, size int, place int"), "node").dropDuplicates(["token", "node"])
    met = stage.save(first)
    first = met.join(of, met["node"] == of["of"], "left").select("token", "node", F.coalesce("component", "node").alias("component"), "size", "place")
    first = stage.save(several(first, "component").withColumn("n", F.count("*").over(Window.partitionBy("token"))))
    stage.drop(met)
    pairs = stage.save(_counted(first.where(F.col("n") <= CROWD), least))
    crowds = first.where(F.col("n") > CROWD).select(F.col("token").alias("key"), "node", "component")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct()
    more = sets_of(asked.join(known.select("node"), "node", "left_anti"))
    known = known.union(more)
    # all bits may differ
    crowded = _across(crowds.join(drawn(known), "node"), 64, least, CROWD_PART)
    missed = verified(pairs.union(crowded).distinct(), known)
    if not missed.isEmpty():
        of = stage.save(connected(links.union(missed), stage).select(F.col("node").alias("of"), "component"))
    return rows.join(of, rows["node"] == of["of"], "left").select("id", "hash", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies, as simhash.keep_one() chooses it.

    Null and empty texts are copies of each other; of repeated rows one stays. All
    columns stay, whatever their names. An empty table stays empty.
    """
    return one_of_each(docs, members(docs, id_col, text_col, words, least), id_col, text_col)
