"""Toxicity by a factorization machine over hashed terms.

A document is the set of its distinct words, each hashed to one of 2**22
buckets. The machine adds a weight for each bucket and, for each pair of
buckets, the product of their factors, so that two words which are harmless
apart can weigh together. It is fitted on the driver from a bounded sample of
labelled rows and goes to the executors as a table of that bounded size; every
document is scored in full.

A bucket is in the machine if the sample's labels depend on it (a chi-square of
LEAST_CHI2) or, among the PAIR_BUCKETS most frequent ones, on its standing
together with another (PAIR_CHI2), so that words which say nothing alone are not
left out. Only these buckets of each sampled row reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.llm.common import Staged, column, free_name, text_of

BUCKETS = 1 << 22
#: Labelled rows of each class that are fitted on, at most; the least hashes of their ids are taken.
SAMPLE = 5000
#: Buckets in the model, at most, and the chi-square a bucket needs.
MOST_BUCKETS, LEAST_CHI2 = 50_000, 15.0
#: Frequent buckets of which pairs are tested, and the chi-square that a pair needs.
PAIR_BUCKETS, PAIR_CHI2 = 1024, 40.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, SPREAD = 8, 20, 128, 0.1, 1e-4, 0.02
_WORD = re.compile(r"\w+")


def terms(text: str) -> np.ndarray:
    """The buckets of a text's distinct words, lower-cased, in order."""
    mask = BUCKETS - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & mask for w in set(_WORD.findall(text.lower()))), np.int32))


@dataclass
class Machine:
    buckets: np.ndarray  # in order
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        return 1 / (1 + np.exp(-np.clip(self.margins([terms(t) for t in texts]), -30, 30)))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """The log odds of rows of buckets."""
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        if not len(self.buckets):
            return np.full(len(rows), self.bias)
        at = np.minimum(np.searchsorted(self.buckets, flat), len(self.buckets) - 1)
        known = self.buckets[at] == flat
        return margins(self.bias, self.weights, self.factors, at[known], of[known], len(rows))


def sums(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of x that belong to each of n."""
    return np.stack([np.bincount(of, weights=c, minlength=n) for c in x.T], axis=1) if x.shape[1] else np.zeros((n, 0))


def margins(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """bias, the weights of each row's buckets and the products of the factors of their pairs; at[i] is a bucket of row of[i]."""
    total = sums(v[at], of, n)
    return bias + np.bincount(of, weights=w[at], minlength=n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(of, weights=(v[at] ** 2).sum(axis=1), minlength=n))


def gradients(bias: float, w: np.ndarray, v: np.ndarray, at: np.ndarray, of: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss, to bias, w and v."""
    n = len(labels)
    error = (1 / (1 + np.exp(-np.clip(margins(bias, w, v, at, of, n), -30, 30))) - labels) / n
    total = sums(v[at], of, n)
    return float(error.sum()), np.bincount(at, weights=error[of], minlength=len(w)), sums(error[of, None] * (total[of] - v[at]), at, len(w))


def chi2(n: int, ones: int, have: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of have of n rows, both with label 1 as ones of all have."""
    expected = have * (ones / n)
    return (both - expected) ** 2 / np.maximum(expected * (1 - ones / n) * (1 - have / n), 1e-9)


def telling_pairs(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which columns of a table of zeros and ones stand together with another in a way that the labels depend on."""
    n, ones = len(labels), int(labels.sum())
    have, both = rows.T @ rows, rows[labels > 0].T @ rows[labels > 0]
    found = chi2(n, ones, have, both)
    np.fill_diagonal(found, 0)
    return (found >= PAIR_CHI2).any(axis=1)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine for rows of buckets, by AdaGrad on the logistic loss.

    Without a row of each class it has no weights, and its bias gives the share
    of label 1, one third where there is no row, so that nothing is rejected.
    """
    n, ones = len(rows), int(labels.sum())
    share = (ones + 1) / (n + 3)
    empty = Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    if not ones or ones == n:
        return empty
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    known, place = np.unique(np.concatenate(rows), return_inverse=True)
    df = np.bincount(place, minlength=len(known))
    alone = chi2(n, ones, df, np.bincount(place, weights=labels[of], minlength=len(known)))
    often = np.lexsort((known, -df))[:PAIR_BUCKETS]
    column_of = np.full(len(known), -1)
    column_of[often] = np.arange(len(often))
    table = np.zeros((n, len(often)), np.float32)
    here = column_of[place] >= 0
    table[of[here], column_of[place[here]]] = 1
    paired = np.zeros(len(known), bool)
    paired[often] = telling_pairs(table, labels)
    best = np.flatnonzero(((alone >= LEAST_CHI2) | paired) & (df >= 2))
    best = np.sort(best[np.lexsort((best, -alone[best], ~paired[best]))][:MOST_BUCKETS])
    if not len(best):
        return empty
    new = np.full(len(known), -1)
    new[best] = np.arange(len(best))
    keep = new[place] >= 0
    flat, of = new[place][keep], of[keep]
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(best)), rng.normal(0, SPREAD, (len(best), FACTORS)), empty.bias
    gw, gv, gb = np.full(len(best), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            batch = order[k : k + BATCH]
            size = starts[batch + 1] - starts[batch]
            row = np.repeat(np.arange(len(batch)), size)
            at = flat[np.repeat(starts[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            used, to = np.unique(at, return_inverse=True)
            db, dw, dv = gradients(b, w[used], v[used], to, row, labels[batch])
            dw += DECAY * w[used]
            dv += DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            b -= RATE * db / np.sqrt(gb)
    return Machine(known[best].astype(np.int64), float(b), w, v)


def held_out(id_col: Column) -> Column:
    """Whether labels of a row are never learnt from; rows without an id never are."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most sample rows of each class that are not held out.

    Labels other than 0 and 1 and null ids are left out; of repeated ids the
    largest label counts.
    """
    label = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("int").alias("label"))
    label = label.where(~held_out(F.col("id")) & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    part = [label.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    # at most twice sample rows of two numbers
    chosen = F.broadcast(part[0].unionByName(part[1]))
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text")).join(chosen, "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["id", "label", "terms"])

    bags = base.select("id", "text", "label").mapInArrow(each, "id string, label int, terms array<int>").groupBy("id").agg(F.min(F.struct("terms", "label")).alias("x"))
    bags = Staged(docs.sparkSession, "toxicity").save(bags.select("id", "x.label", "x.terms"))
    n, ones = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    # of the sample's terms, those that may be in the machine: two lists of bounded length
    have = bags.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("label").alias("df1")).where("df >= 2")
    expected = F.col("df") * F.lit(ones / max(1, n))
    told = (F.col("df1") - expected) ** 2 / F.greatest(expected * F.lit(1 - ones / max(1, n)) * (1 - F.col("df") / F.lit(max(1, n))), F.lit(1e-9))
    telling = have.where(told >= LEAST_CHI2).orderBy(told.desc(), "term").limit(MOST_BUCKETS)
    often = have.orderBy(F.desc("df"), "term").limit(PAIR_BUCKETS)
    chosen = np.sort(np.array([r["term"] for r in telling.select("term").union(often.select("term")).distinct().collect()], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.intersect1d(x.values.to_numpy(), chosen).astype(np.int32).tobytes() for x in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "terms"])

    got = bags.select("id", "label", "terms").mapInArrow(cut, "id string, label int, terms binary").collect()
    rows = sorted((r["id"], bytes(r["terms"]), r["label"]) for r in got)
    return fit([np.frombuffer(t, np.int32) for _, t, _ in rows], np.array([y for *_, y in rows], float))


def with_score(docs: DataFrame, machine: Machine, text_col: str, into: str) -> DataFrame:
    """docs with the score of each row in the double column into.

    Null and empty texts score as a document without words, repeated rows alike,
    texts of any length as a whole. An empty table stays empty; a column of the
    name `into` is replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(texts.slice(k, 512).to_pylist()) for k in range(0, len(texts), 512)]
        return pa.array(np.concatenate([*parts, np.zeros(0)]))

    return docs.withColumn(into, score(text_of(docs, text_col)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row: id_col, held_out, score, predicted.

    Empty and null texts get the score of a document without words. Repeated
    rows score alike. An empty table gives no rows. Other columns are not read.
    """
    machine = train(docs, labels, id_col, text_col, label_col)
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    out = with_score(base, machine, "text", "score")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay.

    Null and empty texts score as a document without words, and repeated rows stay
    or go together. Null ids are kept like others; they and ids without a label
    teach nothing. An empty table stays empty; without labelled rows nothing goes.
    """
    name = free_name(docs, "score")
    scored = with_score(docs, train(docs, labels, id_col, text_col, label_col), text_col, name)
    return scored.where(F.col(name) < 0.5).drop(name)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    from loomflow.session import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
