"""Classifiers of the sample pipelines, on Spark's own learners."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.stage import Staged

LEARNERS = {
    "gaussian_nb": lambda: NaiveBayes(modelType="gaussian", labelCol="_label", featuresCol="_features"),
    "random_forest": lambda: RandomForestClassifier(seed=18, labelCol="_label", featuresCol="_features"),
    "linear_svc": lambda: OneVsRest(classifier=LinearSVC(maxIter=50), labelCol="_label", featuresCol="_features"),
    "rbf_svc": lambda: OneVsRest(classifier=_radial(), labelCol="_label", featuresCol="_features", weightCol=WEIGHT),
}
#: Random Fourier features of a radial kernel.
FOURIER, FOURIER_SEED = 64, 7
WEIGHT = "_weight"


def _radial() -> LinearSVC:
    return LinearSVC(maxIter=30, regParam=1e-4, weightCol=WEIGHT, labelCol="_label", featuresCol="_features")


def fourier(rows: DataFrame, features: list[str], gamma: float | None = None) -> list:
    """Stages that add random Fourier features: cosines whose products are, on average, exp(-gamma * squared distance) of the standardised features.

    A linear learner on them is one with that radial kernel. gamma is 1 over the
    number of features unless it is given. Frequencies are seeded literals; one
    aggregate gives means and deviations.
    """
    told = rows.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng, width = random.Random(FOURIER_SEED), math.sqrt(2 * (1 / len(features) if gamma is None else gamma))
    columns = []
    for n in range(FOURIER):
        terms = [f"{rng.gauss(0, width) / (told[f's{k}'] or 1.0)!r}D * (`{c}` - {told[f'm{k}'] or 0.0!r}D)" for k, c in enumerate(features)]
        columns.append(f"cos({' + '.join(terms)} + {rng.uniform(0, 2 * math.pi)!r}D) * {math.sqrt(2 / FOURIER)!r}D AS _f{n}")
    return [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__"), VectorAssembler(inputCols=[f"_f{n}" for n in range(FOURIER)], outputCol="_features")]


def split(rows: DataFrame, test: float, key: str, seed: int = 24) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: the same rows whatever the partitions."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return rows.where(u >= test), rows.where(u < test)


def weighted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of the columns, with how often each comes."""
    return rows.groupBy(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)]).agg(F.count("*").cast("double").alias(WEIGHT))


def fit(rows: DataFrame, learner: str, features: list[str], label: str) -> PipelineModel:
    """A pipeline that indexes the label alphabetically, gathers the features and learns.

    The radial machine takes equal rows as one, weighted by their number: its loss is
    the same sum, and a round costs as much as there are different rows.
    """
    gathered = fourier(rows, features) if learner == "rbf_svc" else [VectorAssembler(inputCols=features, outputCol="_features")]
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    # two labels need one machine, not one for each
    two = learner == "rbf_svc" and rows.select(label).where(F.col(label).isNotNull()).distinct().count() == 2
    if learner == "rbf_svc":
        rows = weighted(rows, [*features, label])
    return Pipeline(stages=[index, *gathered, _radial() if two else LEARNERS[learner]()]).fit(rows)


def network(rows: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (16,), rounds: int = 200, seed: int = 5) -> PipelineModel:
    """A neural network of sigmoid layers on standardised features, with a softmax over the labels; save, load and predict as with fit().

    Equal rows are learned as one, weighted by their number: the loss is the same sum,
    and a round costs as much as there are different rows. Spark's network takes no
    weights, so it is given what trained() finds and only built.
    """
    kinds = rows.select(label).where(F.col(label).isNotNull()).distinct().count()
    layers = [len(features), *hidden, kinds]
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    ready = Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)]).fit(rows)
    stage = Staged(rows.sparkSession, "network")
    few = stage.save(ready.transform(weighted(rows, [*features, label])).select("_features", "_label", vector_to_array("_features").alias("x"), F.col("_label").cast("int").alias("y"), F.col(WEIGHT).alias("w")))
    found = trained(few.select("x", "y", "w"), layers, rounds, seed)
    net = MultilayerPerceptronClassifier(layers=layers, initialWeights=Vectors.dense(found), maxIter=0, labelCol="_label", featuresCol="_features").fit(few)
    stage.drop(few)
    return PipelineModel([*ready.stages, net])


def _backward(v: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed weighted cross-entropy of rows and its slope; v has each layer's matrix by columns and then its offsets, as Spark's network has."""
    parts, at, acts = [], 0, [x]
    for n, m in zip(layers, layers[1:]):
        parts.append((v[at : at + n * m].reshape(n, m), v[at + n * m : at + n * m + m]))
        at += n * m + m
    for k, (matrix, offset) in enumerate(parts):
        z = acts[-1] @ matrix + offset
        acts.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) if k < len(parts) - 1 else z - z.max(axis=1, keepdims=True))
    out = np.exp(acts[-1])
    total = out.sum(axis=1)
    loss = float((w * (np.log(total) - acts[-1][np.arange(len(y)), y])).sum())
    delta = out / total[:, None]
    delta[np.arange(len(y)), y] -= 1
    delta *= w[:, None]
    slope: list[np.ndarray] = []
    for k in range(len(parts) - 1, -1, -1):
        slope = [(acts[k].T @ delta).ravel(), delta.sum(axis=0), *slope]
        if k:
            delta = (delta @ parts[k][0].T) * acts[k] * (1 - acts[k])
    return loss, np.concatenate(slope)


def trained(rows: DataFrame, layers: list[int], rounds: int, seed: int) -> np.ndarray:
    """Weights of a network of the layers for rows (x, y, w): features, label and how often it counts. Tasks sum the loss and its slope; the driver takes L-BFGS steps."""
    rng, memory = np.random.default_rng(seed), 10
    v = np.concatenate([part for n, m in zip(layers, layers[1:]) for part in (rng.normal(0, 1 / math.sqrt(n), n * m), np.zeros(m))])
    n_rows = rows.agg(F.sum("w")).first()[0] or 1.0

    def cost(at: np.ndarray) -> tuple[float, np.ndarray]:
        def each(batches):
            loss, slope = 0.0, np.zeros(len(at))
            for b in batches:
                if b.num_rows:
                    x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    more, by = _backward(at, layers, x, b["y"].to_numpy(zero_copy_only=False), b["w"].to_numpy(zero_copy_only=False))
                    loss, slope = loss + more, slope + by
            yield pa.record_batch([pa.array([loss]), pa.array([slope.tolist()])], names=["loss", "slope"])

        told = rows.mapInArrow(each, "loss double, slope array<double>").collect()
        return sum(r["loss"] for r in told) / n_rows, np.sum([r["slope"] for r in told], axis=0) / n_rows

    value, slope = cost(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, told = slope.copy(), []
        for s, y in reversed(steps):
            told.append((s @ way) / (s @ y))
            way -= told[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), f in zip(steps, reversed(told)):
            way += s * (f - (y @ way) / (s @ y))
        size, fall = 1.0, float(slope @ way)
        while True:
            then, value_then, slope_then = (v - size * way, *cost(v - size * way))
            if value_then <= value - 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        s, y = then - v, slope_then - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        small = value - value_then <= 1e-6 * max(abs(value), abs(value_then), 1e-6)
        if value_then < value:
            v, value, slope = then, value_then, slope_then
        if small or np.linalg.norm(slope) <= 1e-6 * max(1.0, float(np.linalg.norm(v))):
            break
    return v


def predict(model: PipelineModel, rows: DataFrame, into: str) -> DataFrame:
    """rows with the predicted label in the column into."""
    labels = model.stages[0].labels
    names = F.array(*map(F.lit, labels))
    out = model.transform(rows)
    return out.withColumn(into, F.get(names, F.col("prediction").cast("int"))).select(*rows.columns, into)
