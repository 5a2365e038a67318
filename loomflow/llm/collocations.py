"""Phrase collocations from depth-limited count tries.

A task makes tries of its documents, one for each language and block of words:
nodes are phrases of up to MOST_WORDS words with their counts, found by sorting
the block's word numbers, and are written as sorted runs. Runs are dealt by ranges
of phrases; where a range's runs meet, sorted, a merge adds up equal phrases and
keeps the frequent ones.

A phrase is no more frequent than its parts, so tries grow by levels over three
passes: words; pairs of frequent words; longer phrases all of whose pairs are
frequent. The frequent parts go to the tasks as bitmaps of hashes of a fixed size.
A bitmap has no false negatives: where it is full it only saves less.

Over the merged tries a walk, depth first, gives each phrase the counts of its left
parts, which are its ancestors. A suffix link leads from a phrase to the one
without its first word; following links gives the right parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column, text_of

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bits of a bitmap of frequent parts: 8 MB.
BITMAP_BITS = 1 << 26
#: Bytes of text that a trie takes in, about.
BLOCK_BYTES = 1 << 23
#: How runs are written: front-coded.
RUNS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
_MIX = np.uint64(0x9E3779B97F4A7C15)
# What ends a piece, and what stands between words.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(ENDS)] = 2


def words_of(texts: bytes) -> tuple[pa.Array, np.ndarray]:
    """(words, numbers of their pieces) of bytes; words of one piece follow each other."""
    data = _LOWER[np.frombuffer(texts, np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    # words and what lies between, by turns
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]) if len(edge) else pa.array([], pa.large_binary())
    words = every.take(pa.array(np.arange(0, len(edge), 2)))
    return words, np.cumsum(kind == 2)[edge[::2]] if len(edge) else np.zeros(0, np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases from the hashes of their words."""
    h = words[0]
    for w in words[1:]:
        h = _mixed(h * np.uint64(3) + w)
    return h


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Bitmap:
    """Which hashes may be known: bits of their last places."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def trie(texts: bytes, lang: str, least: int, most: int, words: Bitmap | None, pairs: Bitmap | None) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Nodes of least to most words and their counts, a level after the other in the order of their words, of a block of texts.

    Only nodes whose words, and pairs of neighbouring words, the bitmaps have.
    """
    found, piece = words_of(texts)
    if not len(found):
        return [], []
    coded = found.dictionary_encode()
    del found
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    w = rank[coded.indices.to_numpy()]
    if most == 1:
        return [names], [np.bincount(w, minlength=len(names))]
    hashes = word_hashes(names.to_pylist(), lang)
    # whether a phrase goes on from a word to the next
    on = piece[1:] == piece[:-1]
    if words is not None:
        known = words.has(hashes)[w]
        on = on & known[1:] & known[:-1]
    if pairs is not None:
        at = np.flatnonzero(on)
        on[at] = pairs.has(phrase_hash([hashes[w[at]], hashes[w[at + 1]]]))
    phrases, counts = [], []
    # nodes of a depth are numbered in order; a deeper node is its parent's number and a word
    at, number = np.arange(len(w)), w
    for depth in range(2, most + 1):
        more = at + depth - 2 < len(on)
        at, number = at[more], number[more]
        more = on[at + depth - 2]
        at, number = at[more], number[more]
        if not len(at):
            break
        key = number * len(names) + w[at + depth - 1]
        nodes, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if depth >= least:
            spelt = [names.take(pa.array(w[at[first] + k])) for k in range(depth)]
            phrases.append(pc.binary_join_element_wise(*spelt, pa.scalar(b" ", names.type)))
            counts.append(n)
    return phrases, counts


def _tries(docs: DataFrame, least: int, most: int, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """Sorted runs (lang, phrase, n) of the tries of the documents (text, lang)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [None if x is None else Bitmap(x.value) for x in (words, pairs)]
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def written(lang: str) -> Iterator[pa.RecordBatch]:
            phrases, counts = trie(b"\n".join(held.pop(lang)), lang, least, most, *maps)
            size.pop(lang)
            if not phrases:
                return
            table = pa.table({"phrase": pa.concat_arrays(phrases), "n": pa.array(np.concatenate(counts), pa.int64())}).sort_by("phrase")
            for lo in range(0, table.num_rows, 50_000):
                part = table.slice(lo, 50_000).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(part.num_rows, np.int64))), part["phrase"].combine_chunks().cast(pa.string()), part["n"].combine_chunks()], names=["lang", "phrase", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text.as_py().encode())
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                # whichever language is the largest makes room
                if size[lang] > BLOCK_BYTES or sum(size.values()) > 4 * BLOCK_BYTES:
                    yield from written(max(size, key=size.get))
        for lang in list(held):
            yield from written(lang)

    return docs.select("text", "lang").mapInArrow(grow, "lang string, phrase string, n bigint")


def _merged(runs: DataFrame) -> DataFrame:
    """(lang, phrase, n): equal phrases of sorted runs added up, a range of phrases in each task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            lang, phrase = table.column("lang").combine_chunks(), table.column("phrase").combine_chunks()
            apart = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(phrase[1:], phrase[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, apart))
            total = np.add.reduceat(table.column("n").to_numpy(), first)
            out = pa.RecordBatch.from_arrays([lang.take(pa.array(first)), phrase.take(pa.array(first)), pa.array(total)], names=["lang", "phrase", "n"])
            # the last one may go on in the next batch
            left = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if left is not None:
            yield left

    # ranges of both columns: a phrase's rows are in one range, and a frequent first word in many
    return runs.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(merge, "lang string, phrase string, n bigint")


def _bitmap(frequent: DataFrame) -> Broadcast:
    """The bitmap of the phrases (lang, phrase): of a fixed size, whatever their number."""
    words = BITMAP_BITS >> 6

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                found.append(phrase_hash([word_hashes([w], lang) for w in phrase.encode().split(b" ")]))
            h = np.concatenate(found) & np.uint64(BITMAP_BITS - 1) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["at", "bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(bits, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def _walked(nodes: DataFrame) -> DataFrame:
    """nodes (lang, phrase, n) of two words or more with lefts, the counts of their ancestors of two words or more.

    A walk in the order of words; nodes that begin with the same two words are in one task.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[list[str], int]] = []
        of = None
        for batch in batches:
            lefts = []
            for lang, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n")), strict=True):
                words = phrase.split(" ")
                if lang != of:
                    path, of = [], lang
                while path and path[-1][0] != words[: len(path[-1][0])]:
                    path.pop()
                lefts.append([m for _, m in path])
                path.append((words, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "phrase", "n")), pa.array(lefts, pa.list_(pa.int64()))], names=["lang", "phrase", "n", "lefts"])

    # the order of lists of words: what separates words is smaller than what they hold
    key = F.replace(F.replace(F.replace("phrase", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\0"), F.lit("\x01\x01")), F.lit(" "), F.lit("\0"))
    dealt = nodes.repartition("lang", F.substring_index("phrase", " ", 2)).withColumn("key", key).sortWithinPartitions("lang", "key")
    return dealt.select("lang", "phrase", "n").mapInArrow(walk, "lang string, phrase string, n bigint, lefts array<bigint>")


def _rest(phrase: str) -> Column:
    """A phrase without its first word."""
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def _scored(rows: DataFrame) -> DataFrame:
    """rows (lang, phrase, a, n, lefts, rights) with the cut of the least score, exact."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for a, n, lefts, rights in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "lefts", "rights")), strict=True):
                best.append(min((1000 * a * n // (lo * hi), k, lo, hi) for k, (lo, hi) in enumerate(zip(lefts, rights, strict=True))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("phrase"), batch.column("a"), *(pa.array([b[k] for b in best], pa.int64()) for k in (2, 3)), batch.column("n"), pa.array([b[0] for b in best], pa.int64())],
                names=["lang", "phrase", "a", "l", "r", "n", "score"],
            )

    return rows.select("lang", "phrase", "a", "n", "lefts", "rights").mapInArrow(score, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language.

    A phrase has 2 to MOST_WORDS words of one piece and occurs a >= least times.
    Of its cuts the one with the least floor(1000 * a * n / (l * r)) counts, the
    first of equal ones; l and r are the counts of the parts, n that of all words.
    Phrases inside a longer one that is as frequent are left out. The order is by
    score and a, falling, then by phrase. Null text is empty, null languages are
    `und`; a language without such phrases, or an empty table, gives no rows.
    Repeated rows count again. Other columns are not read.
    """
    if least < 1:
        raise ValueError("the least count must be positive")
    stage = Staged(docs.sparkSession, "collocations")
    base = docs.select(text_of(docs, text_col).alias("text"), F.coalesce(column(docs, lang_col).cast("string"), F.lit("und")).alias("lang"))

    def grown(least_words: int, most_words: int, *known: Broadcast) -> DataFrame:
        """The merged tries; their runs are written with each phrase as what it adds to the one before."""
        runs = stage.save(_tries(base, least_words, most_words, *known), **RUNS)
        merged = _merged(runs)
        out = stage.save(merged if most_words == 1 else merged.where(F.col("n") >= least))
        stage.drop(runs)
        return out

    words = grown(1, 1)
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [stage.save(words.where(F.col("n") >= least))]
    seen = _bitmap(levels[0])
    pairs = grown(2, 2, seen)
    more = grown(3, MOST_WORDS, seen, _bitmap(pairs))
    nodes = stage.save(_walked(pairs.unionByName(more)))
    size = F.size("lefts") + 2
    # suffix links: a phrase's right parts are its link's count and the link's right parts
    link = levels[0].select("lang", F.col("phrase").alias("rest"), F.col("n").alias("m"), F.array().cast("array<bigint>").alias("after"))
    linked = None
    for depth in range(2, MOST_WORDS + 1):
        own = nodes.where(size == depth).withColumn("rest", _rest("phrase"))
        level = stage.save(own.join(link, ["lang", "rest"]).withColumn("rights", F.concat(F.array("m"), "after")).drop("after"))
        link = level.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("m"), F.col("rights").alias("after"))
        linked = level if linked is None else linked.unionByName(level)
    # a part as frequent as the phrase: without the last word, or without the first
    shorter = F.array_except(F.array(F.when(F.get("lefts", F.size("lefts") - 1) == F.col("n"), F.expr("left(phrase, length(phrase) - locate(' ', reverse(phrase)))")), F.when(F.col("m") == F.col("n"), F.col("rest"))), F.array(F.lit(None).cast("string")))
    inside = linked.select("lang", F.explode(shorter).alias("phrase")).distinct()
    heads = levels[0].select("lang", F.col("phrase").alias("head"), F.col("n").alias("f"))
    whole = linked.join(inside, ["lang", "phrase"], "left_anti").withColumn("head", F.substring_index("phrase", " ", 1)).join(heads, ["lang", "head"]).withColumnRenamed("n", "a").join(sums, "lang")
    scored = _scored(whole.withColumn("lefts", F.concat(F.array("f"), "lefts")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows for DuckDB, from all phrases of all documents.
ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE k = 1 GROUP BY 1),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, f FROM cand UNION SELECT lang, array_to_string(w[2:k], ' '), f FROM cand),
kept AS (SELECT * FROM cand ANTI JOIN inside USING (lang, phrase, f)),
cuts AS (SELECT lang, phrase, f, k, w, unnest(range(1, k)) AS j FROM kept),
scored AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score, j
    FROM cuts c JOIN total USING (lang) JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best QUALIFY rank <= 2000"""


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    from loomflow.session import table

    return collocations(table(spark, sf_dir, "documents"))
