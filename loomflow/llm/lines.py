"""Line dedup by a segment-partition edit join.

Two lines within THRESHOLD edits must agree in one of THRESHOLD + 1 segments of
the shorter one, at a place that the difference of lengths and the segment's
number bound. Each line puts its segments into an index keyed by length, number
and content, and looks up its own substrings, of the lengths that a shorter or
equal partner can have, at the few places that can match. What meets under a key
is a candidate unless parities of its letters rule it out; candidates are
verified by a bit-parallel edit distance within a band of the threshold.

Lines that follow one template share segments, and all pairs of them would be
candidates. The lines of such a crowded key are matched among themselves without
pairs: see _crowded().

A line is removed if an equal or linked line stands earlier: in a row of smaller
id, or above it in the same row. Lines shorter than MIN_CHARS have no links of
edits; equal ones are removed from EXACT_CHARS on where the caller says so.
Shorter blank lines stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.llm.common import PLACE_BITS, Staged, column, doc_number, free_name, numbered, place, text_of

THRESHOLD = 2
MIN_CHARS = 24
#: Least length of equal lines that the query and the pipeline remove.
EXACT_CHARS = 1
NAME_BITS = 64
#: Classes of letters of which a line has parities.
PARITIES = 32
#: Pairs, and rows, from which a key is crowded.
CROWDED_PAIRS, CROWDED_ROWS = 1 << 16, 1 << 16
#: Letters of a rest up to which it is matched by what remains without two of them, and rests of a block.
SHORT, BLOCK = 32, 1024
_PAIRS = 1 << 20
_CLASS = np.uint32(1) << ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(PARITIES)).astype(np.uint32)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(first place, length) of the segments of a line, of even length, the longer ones last."""
    short, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(partner's length, segment, place, segment's length) where a line can meet a partner that is no longer."""
    out = []
    for other in range(max(1, length - threshold), length + 1):
        gap = length - other
        for k, (at, size) in enumerate(segments(other, threshold + 1)):
            # edits left of the segment are at most k, right of it at most threshold - k
            low = max(0, at - k, at + gap - (threshold - k))
            high = min(length - size, at + k, at + gap + (threshold - k))
            out.extend((other, k, p, size) for p in range(low, high + 1))
    return out


def _classes(text: str) -> np.ndarray:
    """The class of each letter, as a bit."""
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(0xFFFF)]


def named_lines(text: str, min_chars: int, exact_chars: int | None = None) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
    """(number, line, name, parities) of the lines that are long enough, for exact_chars if not blank.

    A name is a hash of the line; lines of one name are told apart by a second
    hash. Parities say of each class of letters whether their number is odd.
    """
    lines = text.split("\n")
    at = [n for n, line in enumerate(lines) if len(line) >= min_chars or (exact_chars is not None and len(line) >= exact_chars and line.strip())]
    if not at:
        return at, [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    classes = _classes(text)
    parity = np.zeros(len(classes) + 1, np.uint32)
    np.bitwise_xor.accumulate(classes, out=parity[1:])
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = (np.cumsum(size + 1) - size - 1)[at]
    kept = [lines[n] for n in at]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, kept), np.uint64, len(kept)) & np.uint64((1 << NAME_BITS) - 1)
    return at, kept, h.view(np.int64), (parity[start + size[at]] ^ parity[start]).view(np.int32)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of two lines, or most + 1 if it is larger.

    What both begin and end with is left out. Column by column, bits say where
    the distance rises or falls along the diagonal band of 2 * most + 1 rows.
    """
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[low:mid], low) else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a:
        return min(len(b), most + 1)
    rows, width = len(a), 2 * most + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # bit r of the band in column j stands for row j - most + r; rows above the first are no edits yet
    up, down, score = full & ~((1 << most) - 1), 0, most
    for j, c in enumerate(b):
        first = j - most
        seen = where.get(c, 0)
        match = (seen >> first if first >= 0 else seen << -first) & full
        d0 = ((((match & up) + up) ^ up) | match | down) & ((1 << width + 1) - 1)
        hp, hn = down | ~(d0 | up) & full, d0 & up & full
        edge = d0 & full
        if not edge >> (width - 1) & 1:
            score += 1
        x = edge >> 1
        up, down = (hn | ~(x | hp)) & full, x & hp & full
        if score > most + width:
            return most + 1
    # from the band's lowest known row up to the last row of a; bit r now stands for row len(b) - most + r
    for row in range(rows, len(b) + most):
        r = row - len(b) + most
        score -= (up >> r & 1) - (down >> r & 1)
    return min(score, most + 1)


def _cuts(n: int, threshold: int, min_chars: int) -> list[tuple[int, int, int, int]]:
    """(seed, first place, end, role) of what a line of n letters holds (role 0) and looks for in shorter (1) and equally long lines (2).

    What it holds it also looks for in equally long lines, at the same place.
    """
    own = [(n << 3 | k, p, p + size, 0) for k, (p, size) in enumerate(segments(n, threshold + 1))]
    sought = [(m << 3 | k, p, p + size, 1 + (m == n)) for m, k, p, size in probes(n, threshold) if m >= min_chars]
    return own + [x for x in sought if (*x[:3], 0) not in own]


def _keys(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(key, line, parity): hashes of what lines hold and look for, with the role in the low bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        plans: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                seen: set[str] = set()
                keys, roles, names, odd, sizes = [], [np.zeros(0, np.uint64)], [], [], []
                for x in batch.column("text").slice(lo, 512):
                    _, kept, called, parity = named_lines(x.as_py(), min_chars)
                    for line, me, mine in zip(kept, called.tolist(), parity.tolist(), strict=True):
                        if line in seen:
                            continue
                        seen.add(line)
                        n = len(line)
                        if n not in plans:
                            if len(plans) > 20_000:
                                plans.clear()
                            found = _cuts(n, threshold, min_chars)
                            plans[n] = [c[:3] for c in found], np.array([c[3] for c in found], np.uint64)
                        cuts, role = plans[n]
                        keys += [digest(line[p:q], s) for s, p, q in cuts]
                        roles.append(role)
                        names.append(me)
                        odd.append(mine)
                        sizes.append(len(cuts))
                key = np.array(keys, np.uint64) << np.uint64(2) | np.concatenate(roles)
                held = [key.view(np.int64), np.repeat(np.array(names, np.int64), sizes), np.repeat(np.array(odd, np.int32), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["key", "line", "parity"])

    return docs.select("text").mapInArrow(each, "key bigint, line bigint, parity int")


def candidates(keys: DataFrame, threshold: int) -> DataFrame:
    """(a, b, crowded): lines that meet under a key and whose parities allow a link, a less than b; for crowded keys, the key and each line.

    A task holds CROWDED_ROWS rows of a key at most.
    """

    def told(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

    def groups(key: np.ndarray, line: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((line, key))
        key, line, parity = key[order], line[order], parity[order]
        new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))
        key, line, parity = key[new], line[new], parity[new]
        group, role = key >> np.uint64(2), key & np.uint64(3)
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(start, len(key)))
        holders = np.add.reduceat((role == 0).astype(np.int64), start)
        large = holders * size > CROWDED_PAIRS
        if large.any():
            these = np.repeat(large, size)
            yield told(group[these].view(np.int64), line[these], True)
        both = (holders > 0) & (size > 1) & ~large
        start, holders, size = start[both], holders[both], size[both]
        asker = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        first, n = np.repeat(start, size), np.repeat(holders, size)
        at = 0
        while at < len(asker):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at : at + _PAIRS]), _PAIRS, side="right")))
            k = n[at:upto]
            i = np.repeat(asker[at:upto], k)
            j = np.repeat(first[at:upto] - np.cumsum(k) + k, k) + np.arange(k.sum())
            # equally long lines find each other both ways
            near = np.where(role[i] == 1, line[i] != line[j], line[i] > line[j]) & (np.bitwise_count(parity[i] ^ parity[j]) <= 2 * threshold)
            a, b = line[i[near]], line[j[near]]
            yield told(np.minimum(a, b), np.maximum(a, b), False)
            at = upto

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        crowded = None
        for batch in batches:
            rows = [batch.column("key").to_numpy().view(np.uint64), batch.column("line").to_numpy(), batch.column("parity").to_numpy().view(np.uint32)]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = []
            group = rows[0].view(np.int64) >> 2
            if crowded is not None:
                n = int(np.searchsorted(group, crowded, side="right"))
                yield told((rows[0][:n] >> np.uint64(2)).view(np.int64), rows[1][:n], True)
                rows, group = [x[n:] for x in rows], group[n:]
            if not len(group):
                continue
            crowded = None
            last = int(np.searchsorted(group, group[-1], side="left"))
            if last:
                yield from groups(*(x[:last] for x in rows))
            rows = [x[last:] for x in rows]
            if len(rows[0]) > CROWDED_ROWS:
                crowded = int(group[-1])
                yield told((rows[0] >> np.uint64(2)).view(np.int64), rows[1], True)
            else:
                held = rows
        if held:
            yield from groups(*held)

    dealt = keys.repartition(F.shiftrightunsigned("key", 2)).sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a bigint, b bigint, crowded boolean")


def neighbourhood(text: str) -> Iterator[tuple[int, bool]]:
    """(key, half) such that two texts are within two edits exactly if they share a key, not both by half.

    Letters that one text has alone, or that were exchanged, are left out: up to
    two. Keys also say how many were exchanged and where, so that sharing one is
    a proof.
    """

    def key(of: str, text: str) -> int:
        # within the words: for short texts, seeds of this hash can cancel letters
        return xxhash.xxh3_64_intdigest(f"{of}:{text}")

    yield key("one", text), False  # at most one letter left out on either side
    yield key("two", text), False  # none here and two there
    for p in range(len(text)):
        rest = text[:p] + text[p + 1 :]
        yield key("one", rest), False
        yield key(f"at {p}", rest), False  # exchanged at p; the other has one more letter
        for q in range(p, len(rest)):
            v = rest[:q] + rest[q + 1 :]
            yield key("two", v), True
            yield key(f"both {p} {q}", v), False  # exchanged at p and at q + 1
            yield key(f"at {p}", v), True  # exchanged at p, q + 1 alone
            yield key(f"at {q}", v), True  # p alone, exchanged at q + 1


def _crowded(rows: DataFrame, words: DataFrame, stage: Staged, threshold: int) -> DataFrame:
    """(line, mark) of the lines that link to an earlier one under a crowded key; rows are (key, line).

    What all lines of a key begin and end with is left out; it has no bearing on
    their edits. Where little is left, lines are matched by the letters that
    remain when up to two are left out, in time proportional to the lines. Longer
    rests are compared in blocks of bounded size.
    """
    base = stage.save(rows.distinct().join(words, "line").select("key", "line", "mark", "first", "words"))
    turned = F.reverse("words")
    ends = base.groupBy("key").agg(*(f(x).alias(n) for x, n in (("words", "front"), (turned, "back")) for f, n in ((F.min, f"{n}_low"), (F.max, f"{n}_high"))), F.min(F.length("words")).alias("short"), F.count("*").alias("n"))
    shape = "key bigint, line bigint, mark bigint, first decimal(38,0), words string, n bigint"

    def common(a: str, b: str) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a.startswith(b[low:mid], low) else (low, mid - 1)
        return low

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple[int, int]] = {}
            cut = []
            own = (batch.column(c).to_pylist() for c in ("key", "words", "front_low", "front_high", "back_low", "back_high", "short"))
            for key, line, *of in zip(*own, strict=True):
                if key not in known:
                    front = min(common(of[0], of[1]), of[4])
                    known[key] = front, min(common(of[2], of[3]), of[4] - front)
                front, back = known[key]
                cut.append(line[front : len(line) - back])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "line", "mark", "first")), pa.array(cut, pa.string()), batch.column("n")], names=["key", "line", "mark", "first", "words", "n"])

    views = stage.save(base.join(stage.save(ends), "key").mapInArrow(strip, shape))
    near = threshold == 2

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                at, keys, half = [], [], []
                for n, (key, text) in enumerate(zip(part.column("key").to_pylist(), part.column("words").to_pylist(), strict=True)):
                    found = dict(neighbourhood(text))
                    at += [n] * len(found)
                    keys.append(np.fromiter(found, np.uint64, len(found)) ^ np.uint64(key % (1 << 64)))
                    half += found.values()
                key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(c).take(pa.array(at, pa.int64())) for c in ("line", "mark", "first")), pa.array(half, pa.bool_())], names=["key", "line", "mark", "first", "half"])

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by key and place: those that follow another line of their key, half ones a whole one."""
        key, first, whole = None, None, None
        for batch in batches:
            out = []
            own = (batch.column(c).to_pylist() for c in ("key", "first", "half"))
            for k, place_, half in zip(*own, strict=True):
                if k != key:
                    key, first, whole = k, place_, None
                since = whole if half else first
                out.append(since is not None and since < place_)
                if not half and whole is None:
                    whole = place_
            yield batch.select(["line", "mark"]).filter(pa.array(out, pa.bool_()))

    short = views.where((F.length("words") <= SHORT) & F.lit(near))
    linked = short.mapInArrow(keyed, "key bigint, line bigint, mark bigint, first decimal(38,0), half boolean").repartition("key").sortWithinPartitions("key", "first").mapInArrow(earlier, "line bigint, mark bigint").distinct()
    # lines of up to threshold letters more may have the longer rest: all that a longer one can link to are compared
    long = views.where(F.length("words") > SHORT - threshold) if near else views
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = long.withColumn("own", F.pmod(F.xxhash64("line"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "line", "mark", "first", "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = sorted(rows, key=lambda r: r[3])
            size = np.array([len(r[4]) for r in rows])
            odd = np.array([np.bitwise_xor.reduce(_classes(r[4])) for r in rows], np.uint32)
            hit = []
            for n in range(1, len(rows)):
                might = np.flatnonzero((np.abs(size[:n] - size[n]) <= threshold) & (np.bitwise_count(odd[:n] ^ odd[n]) <= 2 * threshold))
                if any(rows[n][3] != rows[m][3] and edits(rows[m][4], rows[n][4], threshold) <= threshold for m in might.tolist()):
                    hit.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([rows[n][c] for n in hit], pa.int64()) for c in (1, 2)], names=["line", "mark"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "line", "mark", "first", "words")), strict=True):
                if held and held[0][0] != row[0]:
                    yield from block(held)
                    held = []
                held.append(row)
        if held:
            yield from block(held)

    compared = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "line bigint, mark bigint").distinct()
    return linked.union(compared)


def removals(docs: DataFrame, stage: Staged, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(doc, lines): the numbers of the lines to remove from the documents (text, doc) that have some."""

    def each(with_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    row, at, names, mark, texts = [], [], [np.zeros(0, np.int64)], [], []
                    for n, x in enumerate(part.column("text")):
                        numbers, kept, called, _ = named_lines(x.as_py(), min_chars, exact_chars)
                        if with_text:
                            want = set(part.column("wanted")[n].as_py())
                            some = [k for k, number in enumerate(numbers) if number in want]
                            numbers, kept, called = [numbers[k] for k in some], [kept[k] for k in some], called[some]
                            texts += kept
                        row += [n] * len(numbers)
                        at += numbers
                        names.append(called)
                        mark += [xxhash.xxh3_64_intdigest(line, 1) for line in kept]
                    arrays = [part.column("doc").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(np.concatenate(names)), pa.array(np.array(mark, np.uint64).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.string())] if with_text else []), names=["doc", "at", "line", "mark"] + ["words"] * with_text)

        return run

    shape = "doc decimal(38,0), at int, line bigint, mark bigint"
    lines = stage.save(docs.select("doc", "text").mapInArrow(each(False), shape))
    # a text's first place; name and mark tell a text by 128 bits of hashes
    texts = stage.save(lines.withColumn("first", place(F.col("at"))).groupBy("line", "mark").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    met = stage.save(candidates(_keys(docs, threshold, min_chars), threshold))
    crowded = met.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("line"))
    # different lines of one name meet too
    namesakes = texts.groupBy("line").agg(F.count("*").alias("marks")).where("marks > 1").select(F.col("line").alias("a"), F.col("line").alias("b"))
    pairs = stage.save(met.where("not crowded").select("a", "b").union(namesakes).distinct())
    members = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(crowded.select("line")).distinct()
    at = F.pmod("first", F.lit(1 << PLACE_BITS).cast("decimal(10,0)")).cast("decimal(10,0)")
    some = texts.join(members, "line").select(at.cast("int").alias("at"), ((F.col("first") - at) / F.lit(1 << PLACE_BITS).cast("decimal(10,0)")).cast("decimal(38,0)").alias("of"))
    some = some.groupBy("of").agg(F.collect_set("at").alias("wanted"))
    asked = docs.join(some, docs["doc"] == some["of"]).select("doc", "text", "wanted").mapInArrow(each(True), shape + ", words string")
    words = stage.save(asked.withColumn("first", place(F.col("at"))).groupBy("line", "mark", "first").agg(F.min("words").alias("words")))
    left = words.select(F.col("line").alias("a"), F.col("mark").alias("a_mark"), F.col("words").alias("a_words"), F.col("first").alias("a_first"))
    right = words.select(F.col("line").alias("b"), F.col("mark").alias("b_mark"), F.col("words").alias("b_words"), F.col("first").alias("b_first"))
    both = pairs.join(left, "a").join(right, "b").where("a <> b or a_mark < b_mark")

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([edits(x, y, threshold) <= threshold for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    both = both.where(linked("a_words", "b_words"))
    a_later = F.col("a_first") > F.col("b_first")
    later = both.select(F.when(a_later, F.col("a")).otherwise(F.col("b")).alias("line"), F.when(a_later, F.col("a_mark")).otherwise(F.col("b_mark")).alias("mark"))
    if not crowded.isEmpty():
        later = later.union(_crowded(crowded, words, stage, threshold))
    later = later.distinct().withColumn("linked", F.lit(True))
    judged = stage.save(texts.where("n > 1").select("line", "mark", "first").join(later, ["line", "mark"], "full").select("line", "mark", "first", F.coalesce("linked", F.lit(False)).alias("linked")))
    gone = lines.join(judged, ["line", "mark"]).where(F.col("linked") | (place(F.col("at")) != F.col("first")))
    return gone.groupBy("doc").agg(F.collect_set("at").alias("lines"))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for x, gone in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
        if gone:
            drop = set(gone)
            x = "\n".join(line for n, line in enumerate(x.split("\n")) if n not in drop)
        out.append(x)
    return pa.array(out, pa.string())


def mark(docs: DataFrame, id_col: str, text_col: str, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> tuple[DataFrame, str]:
    """docs and a column more, whose name is told: the numbers of the lines to remove, null where there are none."""
    if not 0 <= threshold <= 6 or min_chars <= threshold:
        raise ValueError("threshold must be from 0 to 6, and min_chars above it")
    stage = Staged(docs.sparkSession, "lines")
    gone = stage.save(removals(numbered(docs, id_col, text_col), stage, threshold, min_chars, exact_chars))
    of, lines = free_name(docs, "of"), free_name(docs, "lines")
    gone = gone.select(F.col("doc").alias(of), F.col("lines").alias(lines))
    return docs.join(gone, doc_number(column(docs, id_col), text_of(docs, text_col)) == gone[of], "left").drop(of), lines


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """One row per row: id_col, n_lines, n_removed and text_col, the kept lines joined by line feeds.

    Ids are whole numbers. Lines end at line feeds only. Null text is one empty line. Null ids count as
    larger than all others; rows of one id are in the order of a hash of their
    texts, and rows equal in id and text have one outcome. An empty table gives
    no rows. Other columns are not read. With exact_chars, equal lines of so many
    characters are removed too, unless blank.
    """
    marked, lines = mark(docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text")), "id", "text", threshold, min_chars, exact_chars)
    return marked.select(
        F.col("id").alias(id_col),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_removed"),
        _without("text", lines).alias(text_col),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """docs with the repeated lines removed from text_col, and length_col, if given, the new number of characters.

    Rows and other columns stay as they are; a text of which no line goes is untouched, null included.
    """
    marked, lines = mark(docs, id_col, text_col, threshold, min_chars, exact_chars)
    hit = F.col(lines).isNotNull()
    text = F.when(hit, _without(text_of(marked, text_col), lines)).otherwise(column(marked, text_col))
    out = marked.withColumn(text_col, text)
    if length_col:
        out = out.withColumn(length_col, F.when(hit, F.length(column(out, text_col)).cast(docs.schema[length_col].dataType)).otherwise(column(out, length_col)))
    return out.select(*[column(out, c) for c in docs.columns])


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    from loomflow.session import table

    return dedup(table(spark, sf_dir, "documents"), exact_chars=EXACT_CHARS).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
