import random

import numpy as np
from pyspark.sql import functions as F

from loomflow.operators import learn


def test_a_radial_kernel_where_a_line_fails(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.uniform(-1, 1) * 50, rng.uniform(0, 0.1)) for _ in range(3000)]
    df = spark.createDataFrame([(k, x, y, "in" if (x > 0) == (y > 0.05) else "out") for k, (x, y) in enumerate(data)], "k int, x double, y double, label string")
    train, test = learn.split(df, 0.3, "k")
    right = {}
    for name in ("linear_svc", "rbf_svc"):
        model = learn.fit(train, name, ["x", "y"], "label")
        out = learn.predict(model, test, "told")
        assert out.columns == [*df.columns, "told"]
        right[name] = out.agg(F.avg((F.col("told") == F.col("label")).cast("double"))).first()[0]
    assert right["linear_svc"] < 0.65 and right["rbf_svc"] > 0.93
    # the model is a pipeline like any other
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert learn.predict(again, test, "told").exceptAll(learn.predict(model, test, "told")).count() == 0


def test_constant_features(spark):
    df = spark.createDataFrame([(1.0, k % 2.0, "a" if k % 2 else "b") for k in range(40)], "x double, y double, label string")
    model = learn.fit(df, "rbf_svc", ["x", "y"], "label")
    assert learn.predict(model, df, "told").where("told <> label").count() == 0


def test_a_radial_machine_learns_equal_rows_as_one(spark, monkeypatch):
    rng = random.Random(3)
    data = [(float(rng.randint(-9, 9)), float(rng.randint(0, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(x, y, "in" if (x > 0) == (y > 4.5) else "out") for x, y in data], "x double, y double, label string")
    seen = []
    real = learn.Pipeline.fit

    def watch(self, rows):
        seen.append(rows.count())
        return real(self, rows)

    monkeypatch.setattr(learn.Pipeline, "fit", watch)
    model = learn.fit(df, "rbf_svc", ["x", "y"], "label")
    assert seen == [len(set(data))]
    assert learn.weighted(df, ["x", "y", "label"]).agg(F.sum(learn.WEIGHT)).first()[0] == len(data)
    sure = learn.predict(model, df, "told").where("abs(x) >= 3 and abs(y - 4.5) >= 2")
    assert sure.count() > 500 and sure.where("told <> label").count() == 0


def test_a_network_learns_equal_rows_as_one(spark, monkeypatch):
    rng = random.Random(3)
    data = [(float(rng.randint(-9, 9)), float(rng.randint(0, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(x, y, "in" if (x > 0) == (y > 4.5) else "out") for x, y in data], "x double, y double, label string")
    seen = []
    real = learn.MultilayerPerceptronClassifier.fit

    def watch(self, rows):
        seen.append(rows.count())
        return real(self, rows)

    monkeypatch.setattr(learn.MultilayerPerceptronClassifier, "fit", watch)
    model = learn.network(df, ["x", "y"], "label")
    assert seen == [len(set(data))]
    sure = learn.predict(model, df, "told").where("abs(x) >= 3 and abs(y - 4.5) >= 2")
    assert sure.count() > 500 and sure.where("told <> label").count() == 0


def test_the_slope_of_a_network():
    rng = np.random.default_rng(1)
    layers = [3, 4, 2]
    v, x, y, w = rng.normal(size=26), rng.normal(size=(9, 3)), rng.integers(0, 2, 9), rng.uniform(1, 5, 9)
    loss, slope = learn._backward(v, layers, x, y, w)
    for k in range(26):
        e = np.zeros(26)
        e[k] = 1e-6
        assert abs((learn._backward(v + e, layers, x, y, w)[0] - loss) / 1e-6 - slope[k]) < 1e-3
