"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its runs of characters between white space, each after a
mark for the space before it. A pre-token's segmentation into pieces of a public
vocabulary is the one of the largest sum of unigram scores; of equal sums, the
one of fewer pieces. A batch's distinct pre-tokens go in order, which walks
their trie: the scores of a prefix are computed once and stay on a stack for all
that share it. The count at a pre-token's end holds for all its occurrences.

The vocabulary's file ranks its pieces but has no probabilities; a piece of rank
r scores -ln(r + 1), as words by Zipf's law. A character that no piece covers
costs a piece for each of its bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from loomflow.llm.common import column, text_of

SPACE = "▁"
#: Pre-tokens whose counts a task remembers between batches, at most.
REMEMBERED = 500_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def scores(path: str) -> tuple[dict[str, float], float]:
    """(score of each piece, score of a byte): pieces by the rank in the file, bytes below the last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return {p: -math.log(rank + 1) for rank, p in enumerate(pieces, 1)}, -math.log(len(pieces) + 2)


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """(score of each piece, score of a byte) of a unigram model's file, as the file has them; a byte scores 10 below the least piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return pieces, min(pieces.values(), default=0.0) - 10


def piece_trie(pieces: dict[str, float]) -> dict:
    """Nested by character; the score of a piece stands under the empty string."""
    root: dict = {}
    for piece, score in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def count_all(words: set[str], trie: dict, byte_score: float) -> dict[str, int]:
    """Pieces in the best segmentation of each word."""
    out: dict[str, int] = {}
    # one entry for each prefix: score, pieces, and the open pieces as (node, score, pieces) at their starts
    stack: list[tuple[float, int, list]] = [(0.0, 0, [])]
    before = ""
    for word in sorted(words):
        same = len(commonprefix((before, word)))
        del stack[same + 1 :]
        for c in word[same:]:
            score, n, still = stack[-1]
            wide = len(c.encode())
            best, least = score + wide * byte_score, n + wide
            nodes = []
            for node, s, k in (*still, (trie, score, n)):
                below = node.get(c)
                if below is not None:
                    nodes.append((below, s, k))
                    end = below.get("")
                    if end is not None:
                        total = s + end
                        if total > best or (total == best and k + 1 < least):
                            best, least = total, k + 1
            stack.append((best, least, nodes))
        out[word] = stack[-1][1]
        before = word
    return out


_TRIES: dict[tuple[str, str], dict] = {}


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, score: Callable[[str], tuple[dict[str, float], float]] = scores) -> DataFrame:
    """One row per row: id_col, n_pretokens, n_tokens.

    score gives the pieces' and a byte's scores of the file at path; the file of a
    unigram model has its own, see unigram_scores(). Null and empty texts have none. Repeated rows count alike. An empty table
    gives no rows. Other columns are not read.
    """
    path = path or vocabulary_path()
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte_score = score(path)
        trie = _TRIES.setdefault((path, f"{score.__module__}.{score.__qualname__}"), {})
        if not trie:
            trie.update(piece_trie(pieces))
        known: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [Counter(x.as_py().split()) for x in part.column("text")]
                new = set().union(*texts).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known = {}
                    new = set().union(*texts)
                known |= {w[1:]: n for w, n in count_all({SPACE + w for w in new}, trie, byte_score).items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([t.total() for t in texts], pa.int64()),
                        pa.array([sum(known[w] * n for w, n in t.items()) for t in texts], pa.int64()),
                    ],
                    names=["id", "n_pretokens", "n_tokens"],
                )

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(each, f"id {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def op7_tokencounts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    from loomflow.session import table

    return count(table(spark, sf_dir, "documents"))
