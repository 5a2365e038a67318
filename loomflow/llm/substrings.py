"""Exact substring dedup with suffix automata of reference shards.

A window of WINDOW words is a repeat if the same words start earlier: in a
document of smaller id, or before it in the same one. Each window has an anchor,
the least hash among its runs of ANCHOR words, so that equal windows have equal
anchors at the same place. Consecutive windows with one anchor form a region of
at most 15. Anchors that occur once hold no repeat; this filter is all that hashes
decide.

Regions of the other anchors are the references. Regions of equal words, by anchor
and a 64-bit digest, share one row of words, under the place of the earliest, and
one answer. Anchors are dealt to shards. A task builds the suffix automaton of its
shard, of a bounded number of references from the earliest on, in which every state
knows the first place of its words. Then the shard's regions stream through it: the
matching statistics tell which windows stand in the shard, and the state where each
stands first. Every region, copies included, holds those places against its own:
what starts earlier is a repeat, and the maximal spans of such windows are removed.

An anchor of very many different regions does not fit a shard. Its windows become
references of their own, dealt to shards by all their words.

Only numbers are shuffled to find anchors (a 64-bit anchor, a 64-bit digest and a
place); words follow for the regions that the automata hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import PLACE_BITS, Staged, numbered, place

WINDOW = 20
ANCHOR = 6
#: References in an automaton, about; an anchor of more has its windows dealt out one by one.
SHARD_REFERENCES = 2000
_MULTIPLY, _MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def split_words(text: str) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09 to 0x0D."""
    return text.encode().split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n-1, and to their negatives, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(int(_BASE), -1, 1 << 64)
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, inverse))
    return _POWERS[0][:n], _POWERS[1][:n]


def regions(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, first window, windows) of each region; fewer words than a window: none."""
    n = len(words)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    runs = n - anchor + 1
    mixed = np.zeros(runs, np.uint64)
    for k in range(anchor):
        mixed = mixed * _MULTIPLY + h[k : k + runs]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    at = sliding_window_view(mixed, window - anchor + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, len(at)))
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    digest = (total[first + count + window - 1] - total[first]) * down[first]
    digest ^= digest >> np.uint64(31)
    return mixed[at[first]].view(np.int64), digest.view(np.int64), first, count


class Automaton:
    """Suffix automaton of several sequences; each state has the first place where its words end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        #: State of the last step of matching().
        self.at = 0

    def _state(self, length: int, link: int, first: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the words of q that end p's words and this one."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], self.first[q], self.next[q].copy())
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[bytes], place: int = 0) -> None:
        """Take in a sequence whose words have the places from place on. Earlier sequences must come first."""
        last = 0
        for place, word in enumerate(words, place):
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, place, {}), last
            while p >= 0:
                q = self.next[p].get(word)
                if q is not None:
                    self.link[new] = self._split(p, word, q)
                    break
                self.next[p][word] = new
                p = self.link[p]
            last = new

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """For each word the most words up to it that stand together in a sequence."""
        state = length = 0
        for word in words:
            to = self.next[state].get(word)
            while to is None and state:
                state = self.link[state]
                length = self.length[state]
                to = self.next[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            self.at = state
            yield length

    def windows(self, words: list[bytes], window: int) -> Iterator[tuple[int, int]]:
        """(window, place where its words start first) of the windows that stand in a sequence."""
        for n, length in enumerate(self.matching(words)):
            if length >= window:
                state = self.at
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                yield n - window + 1, self.first[state] - window + 1


#: Bits of a word's place in its reference.
_WORD_BITS = 16


def match_shard(references: list[str], places: list[int], window: int) -> list[list[int | None]]:
    """For each reference, earliest first, the place where each of its windows stands first in the shard; None where the automaton does not know it.

    places are those of the references' first words.
    """
    known = Automaton()
    split = [r.encode().split(b" ") for r in references]
    for n, words in enumerate(split):
        known.add(words, n << _WORD_BITS)
    out = []
    for words in split:
        first = [None] * (len(words) - window + 1)
        for k, at in known.windows(words, window):
            first[k] = places[at >> _WORD_BITS] + (at & (1 << _WORD_BITS) - 1)
        out.append(first)
    return out


def repeats(docs: DataFrame, stage: Staged, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, spans) of the documents (id, text, doc) that hold repeats; a span is first window * 2**16 + bits of the repeated ones."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [regions(split_words(x.as_py()), window, anchor) for x in part.column("text")]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                anchors, digests, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row)), pa.array(anchors), pa.array(digests), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int8))],
                    names=["doc", "anchor", "digest", "first", "count"],
                )

    shape = "doc decimal(38,0), anchor bigint, digest bigint, first int, count tinyint"
    every = stage.save(docs.select("doc", "text").mapInArrow(find, shape))
    # sums are staged before a join, so that Spark can split the other side where a key is frequent
    counts = stage.save(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    live = stage.save(every.join(counts, "anchor"))
    stage.drop(every, counts)
    contents = stage.save(live.withColumn("place", place(F.col("first"))).groupBy("anchor", "digest", "count").agg(F.min("place").alias("place")))
    crowded = stage.save(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SHARD_REFERENCES).select("anchor", F.lit(True).alias("crowded")))
    first = F.pmod("place", F.lit(1 << PLACE_BITS).cast("decimal(10,0)")).cast("decimal(10,0)")
    of = ((F.col("place") - first) / F.lit(1 << PLACE_BITS).cast("decimal(10,0)")).cast("decimal(38,0)")
    asked = contents.join(crowded, "anchor", "left").select("anchor", "digest", "crowded", "count", first.cast("int").alias("first"), of.alias("of"))
    by_doc = asked.groupBy("of").agg(F.collect_list(F.struct("anchor", "digest", "crowded", "count", "first")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("parts")
                flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), ends)
                rows, offsets, texts, low, high = [], [], [], [], []
                split, now = [], -1
                places = zip(row.tolist(), flat.field("first").to_pylist(), flat.field("count").to_pylist(), flat.field("crowded").to_pylist(), strict=True)
                for k, (r, i, n, single) in enumerate(places):
                    if r != now:
                        split, now = split_words(part.column("text")[r].as_py()), r
                    for j in range(n if single else 1):
                        text = b" ".join(split[i + j : i + j + window] if single else split[i : i + n + window - 1])
                        a, b = struct.unpack("<qq", xxhash.xxh3_128_digest(text)) if single else (None, None)
                        rows.append(k)
                        offsets.append(j)
                        low.append(a)
                        high.append(b)
                        texts.append(text.decode())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row[rows] if rows else row[:0])), flat.field("anchor").take(take), flat.field("digest").take(take), flat.field("first").take(take)]
                    + [pa.array(offsets, pa.int8()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(texts, pa.string())],
                    names=["doc", "anchor", "digest", "first", "offset", "low", "high", "words"],
                )

    shape = "doc decimal(38,0), anchor bigint, digest bigint, first int, offset tinyint, low bigint, high bigint, words string"
    read = docs.join(by_doc, docs["doc"] == by_doc["of"]).select("doc", "text", "parts").mapInArrow(cut, shape)
    read = stage.save(read.select("anchor", "digest", place(F.col("first") + F.col("offset")).alias("place"), "offset", "low", "high", "words"))
    single = read.where("low is not null")
    alone = single.groupBy("low", "high").agg(F.min(F.struct("place", "words")).alias("x")).select(F.col("low").alias("key"), F.col("high").alias("mark"), "x.place", "x.words", F.lit(True).alias("single"))
    whole = read.where("low is null").select(F.col("anchor").alias("key"), F.col("digest").alias("mark"), "place", "words", F.lit(False).alias("single"))
    shards = -(-read.count() // SHARD_REFERENCES) or 1
    dealt = whole.unionByName(alone).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "place", "mark")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                # rows equal in id and text tell a region twice
                at, mark = (rows.column(c).to_numpy() for c in ("place", "mark"))
                rows = rows.filter(pa.array(np.append(True, (at[1:] != at[:-1]) | (mark[1:] != mark[:-1]))))
                firsts = match_shard(rows.column("words").to_pylist(), [int(x) for x in rows.column("place").to_pylist()], window)
                rows = rows.select(["key", "mark", "place", "single"]).append_column("firsts", pa.array([[x if x is None else Decimal(x) for x in f] for f in firsts], pa.list_(pa.decimal128(38, 0))))
                yield from rows.to_batches()

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            lo = 0
            for hi in ends:
                if hi > lo:
                    if int(numbers[lo]) != now:
                        yield from told()
                        now, held = int(numbers[lo]), []
                    held.append(batch.slice(lo, hi - lo))
                    lo = hi
        yield from told()

    told = stage.save(dealt.mapInArrow(stream, "key bigint, mark bigint, place decimal(38,0), single boolean, firsts array<decimal(38,0)>"))
    of_whole = told.where("not single").select(F.col("key").alias("anchor"), F.col("mark").alias("digest"), "firsts")
    alone = told.where("single").select(F.col("key").alias("low"), F.col("mark").alias("high"), F.get("firsts", F.lit(0)).alias("first"))
    of_single = single.join(alone, ["low", "high"]).groupBy("anchor", "digest").agg(F.array_sort(F.collect_set(F.struct("offset", "first"))).alias("x")).select("anchor", "digest", F.transform("x", lambda x: x["first"]).alias("firsts"))
    contents = stage.save(of_whole.unionByName(of_single))
    # a region of whatever copy: its windows that start earlier, by the automaton, than they do here
    here = place(F.col("first"))
    bits = F.aggregate(F.transform("firsts", lambda x, k: F.when(x < here + k, F.pow(F.lit(2), k).cast("int")).otherwise(0)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    spans = live.join(contents, ["anchor", "digest"]).select("doc", "first", bits.alias("bits"))
    # one list for each document, no longer than it has windows; rows equal in id and text tell the same spans
    return spans.where("bits <> 0").groupBy("doc").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 16).bitwiseOR(F.col("bits").cast("long"))).alias("spans"))


def covered(n: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    first, bits = spans >> 16, spans & 0xFFFF
    starts = np.concatenate([first[bits >> k & 1 == 1] + k for k in range(16)])
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row: id_col, n_words, n_removed and text_col, the kept words joined by one space.

    Ids are whole numbers. Null text has no words. Null ids count as larger than
    all others; rows of one id are in the order of a hash of their texts, and
    rows equal in id and text have one outcome. An empty table gives no rows.
    Other columns are not read.
    """
    if not ANCHOR < window <= ANCHOR + 14:
        raise ValueError("the window does not suit the anchors")
    stage = Staged(docs.sparkSession, "substrings")
    base = numbered(docs, id_col, text_col)
    spans = stage.save(repeats(base, stage, window)).withColumnRenamed("doc", "of")
    rows = base.join(spans, base["doc"] == spans["of"], "left").select("id", "text", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for x, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = split_words(x.as_py())
                total.append(len(words))
                if found.is_valid:
                    out = covered(len(words), found.values.to_numpy(), window)
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "text"])

    kind = base.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(keep, f"id {kind}, n_words bigint, n_removed bigint, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("text").alias(text_col))


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    from loomflow.session import table

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
