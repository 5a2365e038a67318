"""Exact substring dedup with suffix arrays of shards, made by two-stage sorting.

A window of WINDOW bytes is a repeat if the same bytes also start anywhere else.
Each window has an anchor, the least hash among its runs of ANCHOR bytes, so that
equal windows have equal anchors at the same place; consecutive windows with one
anchor form a region. Anchors that occur once hold no repeat. This filter is all
that hashes decide of what is removed: the bytes of every region of the other
anchors, copies included, go to shards by anchor.

A task lays the regions of a shard end to end and sorts the suffixes that begin
its windows. Only suffixes smaller than their successors are sorted by their
bytes; the others follow from one scan over the buckets of first bytes, each put
behind those that its successor's place has put there before. Neighbours are then
compared, and windows with a common prefix of a whole window are repeats.

An anchor of more than CROWD regions is dealt to several shards. What a shard does
not settle is whether a window stands in another one: one of each distinct window
goes on. Consecutive ones go as one piece while they begin and end at the same two
places, the least of their first EDGE and of their last EDGE hashes; the bytes from
one place to the other are the piece's key. Keys that several pieces have meet in
suffix arrays again. What is still too many for a shard is cut by shorter edges, at
last by whole windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, numbered

WINDOW = 200
ANCHOR = 32
#: Regions of a shard, about, and the most regions of an anchor that are dealt to one shard.
SHARD_REGIONS, CROWD = 8192, 4096
#: The part of a window in which a piece's key may begin, and end; from round to round as much less.
EDGE = 4
#: Places in a row that are compared with others at once, at least.
TOGETHER = 24
#: Windows of a text that are looked at together; regions end there too.
BLOCK = 1 << 20
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """Place of the least, and first, of each run of so many hashes."""
    # ends of one block and beginnings of the next
    runs = len(h)
    size = -(-runs // wide) * wide
    keys = np.full(size + wide, _NONE)
    keys[:runs] = (h & ~_PLACE) | np.arange(runs, dtype=np.uint64)
    blocks = keys[:size].reshape(-1, wide)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = runs - wide + 1
    return (np.minimum(down[:n], up[wide - 1 : wide - 1 + n]) & _PLACE).astype(np.int64)


def _anchors(text: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each place, place of the anchor of each window)."""
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).copy()
    runs = len(text) - anchor + 1
    h = words[:runs] * _MULTIPLY
    for at in [*range(8, anchor - 7, 8), *([anchor - 8] if anchor % 8 else [])]:
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLY + words[at : at + runs]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, _least(h, window - anchor + 1)


def regions(text: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each region; texts shorter than a window: none."""
    found = []
    for lo in range(0, len(text) - window + 1, BLOCK):
        h, at = _anchors(text[lo : lo + BLOCK + window - 1], window, anchor)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        found.append((h[at[first]].view(np.int64), first + lo, np.diff(np.append(first, len(at)))))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pieces(text: bytes, window: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of the pieces of a run of windows; equal windows have equal keys. With an edge of 1 they are single windows."""
    h = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)) * _MULTIPLY
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    least = _least(h, edge)
    n = len(text) - window + 1
    head, tail = least[:n], least[window - 7 - edge : window - 7 - edge + n]
    first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
    keys = [xxhash.xxh3_64_intdigest(text[a : b + 8]) for a, b in zip(head[first].tolist(), tail[first].tolist(), strict=True)]
    return np.array(keys, np.uint64).view(np.int64), first, np.diff(np.append(first, n))


def _sorted_by_bytes(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by the depth bytes that begin there; equal ones in any order."""
    if not len(at):
        return at
    words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    out, key = at[order], key[order]
    begins = np.append(True, key[1:] != key[:-1])
    tied = np.arange(len(out))
    for step in range(8, depth, 8):
        # groups of one are settled
        alone = begins & np.append(begins[1:], True)
        if alone.any():
            tied, begins = tied[~alone], begins[~alone]
        if not len(tied):
            break
        key = words[out[tied] + step].astype(np.uint64)
        differs = np.append(False, key[1:] != key[:-1]) & ~begins
        if not differs.any():
            continue
        group = np.cumsum(begins) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        chosen = np.flatnonzero(mixed[group])
        order = chosen[np.lexsort((key[chosen], group[chosen]))]
        out[tied[chosen]] = out[tied[order]]
        key[chosen] = key[order]
        begins = begins | np.append(True, key[1:] != key[:-1])
    return out


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """The places that begin a window, in the order of the windows' bytes.

    Strings lie between starts and ends, a byte apart; counts tells how many
    windows each begins with. data goes on for a window and eight bytes behind
    the last string.
    """
    n = len(data)
    # a suffix is smaller than its successor if the next other byte is greater; a string's end is smaller than all
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[ends - 1] = -1
    known = np.flatnonzero(step)
    smaller = np.zeros(n, bool)
    smaller[: known[-1] + 1] = np.repeat(step[known] > 0, np.diff(np.append(-1, known)))
    smaller[ends] = False
    # the order of a string's windows follows from its first smaller suffix behind them, or from its end
    places = np.flatnonzero(smaller)
    after = np.append(places, n)[np.searchsorted(places, starts + counts - 1)]
    stop = np.where(after < ends, after, ends)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stop, -1)
    inside = np.cumsum(edge[:n]) > 0
    induced = inside & ~smaller
    direct = inside & smaller
    direct[stop[after < ends]] = True
    ordered = _sorted_by_bytes(data, np.flatnonzero(direct), window)
    bounds = np.searchsorted(data[ordered], np.arange(257))
    put: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(scanned: np.ndarray, above: int) -> np.ndarray:
        """Deal the greater suffixes before these to the buckets of their bytes; return those of the same byte."""
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        bytes_of = data[before]
        same = before[bytes_of == above] if above >= 0 else before[:0]
        other = bytes_of != above if above >= 0 else np.ones(len(before), bool)
        before, bytes_of = before[other], bytes_of[other]
        if len(before):
            order = np.argsort(bytes_of, kind="stable")
            before, bytes_of = before[order], bytes_of[order]
            cut = np.flatnonzero(np.append(True, bytes_of[1:] != bytes_of[:-1]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(before)], strict=True):
                put[bytes_of[lo]].append(before[lo:hi])
        return same

    induce(stop[after >= ends], -1)
    out = []
    for byte in range(256):
        # a run of one byte goes on in its own bucket
        now = np.concatenate(put[byte]) if put[byte] else np.zeros(0, np.int64)
        put[byte] = []
        while len(now):
            out.append(now)
            now = induce(now, byte)
        own = ordered[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own, byte)
    order = np.concatenate(out)
    begins = np.zeros(n + 1, np.int32)
    np.add.at(begins, starts, 1)
    np.add.at(begins, starts + counts, -1)
    return order[np.cumsum(begins[:n])[order] > 0]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each place has in common with the one before in the order, at most that many; 0 for the first."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = np.full(len(order), most)
    out[:1] = 0
    # places in a row, as far behind the places before them in the order, are compared at once
    back = np.zeros(len(order), np.int64)
    back[1:] = order[1:] - order[:-1]
    by_place = np.argsort(order)
    place, back = order[by_place], back[by_place]
    begins = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(back) != 0)))
    size = np.diff(np.append(begins, len(place)))
    begins, size = (x[size >= TOGETHER] for x in (begins, size))
    alone = np.ones(len(order), bool)
    if len(begins):
        ends = np.cumsum(size + most)
        at = np.arange(ends[-1]) + np.repeat(place[begins] - ends + size + most, size + most)
        apart = np.append(np.flatnonzero(data[at] != data[at - np.repeat(back[begins], size + most)]), ends[-1] + most)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine, here = by_place[np.repeat(begins, size) + row], np.repeat(ends - size - most, size) + row
        out[mine] = np.minimum(most, apart[np.searchsorted(apart, here)] - here)
        alone[mine] = False
        out[:1] = 0
    live = np.flatnonzero(alone[1:]) + 1
    for step in range(0, most, 8):
        x = words[order[live] + step] ^ words[order[live - 1] + step]
        apart = x != 0
        if apart.any():
            y = x[apart]
            out[live[apart]] = np.minimum(most, step + (np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)) >> 3))
            live = live[~apart]
            if not len(live):
                break
    return out


def match_shard(texts: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of all texts, one after the other: whether the shard holds the same bytes elsewhere, and whether it is the first of equal ones."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(texts) + bytes(window + 16), np.uint8)
    order = suffix_array(data, starts, starts + sizes, counts, window)
    equal = common_prefixes(data, order, window) >= window
    row = np.repeat(np.arange(len(texts)), counts)
    places = starts[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    at = np.searchsorted(places, order)
    repeated, first = np.zeros(len(places), bool), np.zeros(len(places), bool)
    repeated[at] = equal | np.append(equal[1:], False)
    first[at] = ~equal
    return repeated, first


def _runs(flags: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the maximal runs of true flags that do not go over a begin."""
    border = np.zeros(len(flags) + 1, bool)
    border[begins] = True
    on = np.flatnonzero(flags & (border[:-1] | ~np.append(False, flags[:-1])))
    off = np.flatnonzero(flags & (np.append(border[1:-1], True) | ~np.append(flags[1:], False)))
    return on, off + 1


def _told(rows: pa.Table, window: int) -> pa.RecordBatch:
    """(doc, start, stop) of runs of repeated windows, and with text and lone, whether each stands once in the shard, of runs of distinct windows of which other shards may hold copies."""
    texts = [t.as_py() for t in rows.column("text")]
    counts = rows.column("count").to_numpy().astype(np.int64)
    repeated, first = match_shard(texts, counts, window)
    begins = np.cumsum(counts) - counts
    row_of = np.repeat(np.arange(len(texts)), counts)
    on, off = _runs(repeated, begins)
    split = rows.column("split").to_numpy(zero_copy_only=False)
    on_too, off_too = _runs(first & split[row_of], begins)
    row = np.concatenate([row_of[on], row_of[on_too]]).astype(np.int64)
    shift = rows.column("first").to_numpy()[row] - begins[row]
    more, lone = [None] * len(on), [None] * len(on)
    for a, b, r in zip(on_too.tolist(), off_too.tolist(), row_of[on_too].tolist(), strict=True):
        at = a - int(begins[r])
        more.append(texts[r][at : at + b - a + window - 1])
        lone.append(~repeated[a:b])
    return pa.RecordBatch.from_arrays(
        [rows.column("doc").combine_chunks().take(pa.array(row)), pa.array((np.concatenate([on, on_too]) + shift).astype(np.int32)), pa.array((np.concatenate([off, off_too]) + shift).astype(np.int32))]
        + [pa.array(more, pa.binary()), pa.array(lone, pa.list_(pa.bool_()))],
        names=["doc", "start", "stop", "text", "lone"],
    )


#: Runs of repeated windows, without text, and pieces of distinct ones, lone if a window of theirs stands once in its shard.
_CUT = "doc decimal(38,0), start int, stop int, text binary, key bigint, lone boolean"


def _cut(told: pa.RecordBatch, window: int, edge: int) -> pa.RecordBatch:
    """What a shard tells, with its runs of distinct windows cut into pieces."""
    is_open = told.column("text").is_valid().to_numpy(zero_copy_only=False)
    row, more = np.flatnonzero(~is_open), np.flatnonzero(is_open)
    start, stop = (told.column(n).to_numpy() for n in ("start", "stop"))
    kept = len(row)
    rows, starts, stops, texts, keys, lone = [row], [start[row]], [stop[row]], [], [], []
    for r in more.tolist():
        text = told.column("text")[r].as_py()
        key, first, count = pieces(text, window, edge)
        rows.append(np.full(len(first), r))
        starts.append(start[r] + first)
        stops.append(start[r] + first + count)
        keys.append(key)
        lone.append(np.logical_or.reduceat(told.column("lone")[r].values.to_numpy(zero_copy_only=False), first))
        texts += [text[i : i + n + window - 1] for i, n in zip(first.tolist(), count.tolist(), strict=True)]

    def behind(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.nulls(kept, values.type), values])

    made = [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, stops)]
    made += [behind(pa.array(texts, pa.binary())), behind(pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))), behind(pa.array(np.concatenate([np.zeros(0, bool), *lone])))]
    return pa.RecordBatch.from_arrays([told.column("doc").take(pa.array(np.concatenate(rows))), *made], names=["doc", "start", "stop", "text", "key", "lone"])


def _settled(rows: DataFrame, total: int, window: int, edge: int) -> DataFrame:
    """What shards tell of the rows (key, salt, split, doc, first, count, text); rows of one key and salt meet in one shard."""
    shards = -(-total // SHARD_REGIONS) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)))
    dealt = dealt.select("shard", "split", "doc", "first", "count", "text").repartition("shard").sortWithinPartitions("shard")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            lo = 0
            for hi in ends:
                if hi > lo:
                    if int(numbers[lo]) != now:
                        if held:
                            yield _cut(_told(pa.Table.from_batches(held), window), window, edge)
                        now, held = int(numbers[lo]), []
                    held.append(batch.slice(lo, hi - lo))
                    lo = hi
        if held:
            yield _cut(_told(pa.Table.from_batches(held), window), window, edge)

    return dealt.mapInArrow(stream, _CUT)


def _salted(rows: DataFrame) -> DataFrame:
    """rows (key, n, doc, first) with split and salt: keys of more than CROWD rows are dealt to several shards."""
    salts = F.ceil(F.col("n") / CROWD).cast("bigint")
    return rows.withColumn("split", F.col("n") > CROWD).withColumn("salt", F.when(F.col("split"), F.pmod(F.xxhash64("doc", "first"), salts)).otherwise(F.lit(0)))


def repeats(docs: DataFrame, stage: Staged, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, start, stop) of runs of repeated windows in the documents (id, text, doc); a run may be told twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [regions(x.as_py().encode(), window, anchor) for x in part.column("text")]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                keys, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row)), pa.array(keys), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc", "key", "first", "count"])

    every = stage.save(docs.select("doc", "text").mapInArrow(find, "doc decimal(38,0), key bigint, first int, count int"))
    # sums are staged before a join, so that Spark can split the other side where a key is frequent
    counts = stage.save(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    live = stage.save(every.join(counts, "key"))
    stage.drop(every, counts)
    # a set: rows equal in id and text each bring their list
    by_doc = live.groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("first", "count", "key", "n")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("parts")
                flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), ends)
                first, count = flat.field("first"), flat.field("count")
                whole = [x.as_py().encode() for x in part.column("text")]
                texts = [whole[r][i : i + n + window - 1] for r, i, n in zip(row.tolist(), first.to_pylist(), count.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row)), flat.field("key"), flat.field("n"), first, count, pa.array(texts, pa.binary())], names=["doc", "key", "n", "first", "count", "text"])

    read = docs.join(by_doc, docs["doc"] == by_doc["of"]).select("doc", "text", "parts").mapInArrow(cut, "doc decimal(38,0), key bigint, n bigint, first int, count int, text binary")
    edge = max(1, window // EDGE)
    told = stage.save(_settled(_salted(read), live.count(), window, edge))
    found = told.where("text is null").select("doc", "start", "stop")
    while True:
        open_ = told.where("text is not null").select("key", "doc", F.col("start").alias("first"), (F.col("stop") - F.col("start")).alias("count"), "text", "lone")
        # of copies that several shards know, some stand alone in theirs
        known = stage.save(open_.groupBy("key").agg(F.count("*").alias("n"), F.max("lone").alias("lone")).where("n > 1 and lone").select("key", "n"))
        total = known.agg(F.sum("n")).first()[0]
        if not total:
            return found
        again = _salted(open_.drop("lone").join(known, "key"))
        edge = max(1, edge // EDGE)
        told = stage.save(_settled(again, total, window, edge))
        found = found.unionByName(told.where("text is null").select("doc", "start", "stop"))


def removed(n: int, starts: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the maximal runs of n bytes that repeated windows cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(stops + window - 1, minlength=n + 1)
    gone = np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8)
    step = np.diff(gone)
    return np.flatnonzero(step > 0), np.flatnonzero(step < 0)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row: id_col, n_bytes, n_removed, n_spans and kept, the remaining bytes (binary).

    Texts are their UTF-8 bytes; what is left need not be UTF-8. Ids are whole
    numbers and only name rows: repeated rows are copies of each other, whatever
    their ids, and null ids are kept. Null text is empty. An empty table gives no
    rows. Other columns are not read.
    """
    if window <= ANCHOR:
        raise ValueError("the window does not suit the anchors")
    stage = Staged(docs.sparkSession, "suffixes")
    base = numbered(docs, id_col, text_col)
    found = repeats(base, stage, window).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    rows = base.join(stage.save(found), F.col("doc") == F.col("of"), "left").select("id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                total, gone, spans, kept = [], [], [], []
                for x, runs in zip(part.column("text"), part.column("runs"), strict=True):
                    text = x.as_py().encode()
                    total.append(len(text))
                    on = off = np.zeros(0, np.int64)
                    if runs.is_valid:
                        on, off = removed(len(text), runs.values.field("start").to_numpy(), runs.values.field("stop").to_numpy(), window)
                    gone.append(int((off - on).sum()))
                    spans.append(len(on))
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *off.tolist()], [*on.tolist(), len(text)], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = base.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(keep, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def op11_suffixes(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    from loomflow.session import table

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
