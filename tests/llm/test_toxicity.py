import random
import zlib

import numpy as np

from loomflow.llm import toxicity

DOCS = "doc_id bigint, text string, score string, toxic int"


def corpus(n=600, seed=1):
    """Label 1 only where an insult and a group stand together."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        kind = k % 4
        if kind in (1, 3):
            text.insert(rng.randrange(len(text)), rng.choice(["Vile,", "vile"]))
        if kind in (2, 3):
            text.insert(rng.randrange(len(text)), "people")
        rows.append((k, " ".join(text), int(kind == 3)))
    return rows


def test_learns_what_words_mean_together(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "clash", 9) for k, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert set(got) == {k for k, *_ in rows}
    held = [(got[k]["predicted"], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in got if got[k]["score"] < 0.5}


def test_held_out_labels_have_no_bearing(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(k, t, "", 0) for k, t, _ in rows], DOCS)
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in rows]
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")) for x in ([(k, y) for k, _, y in rows], flipped))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def exclusive(n=1200, seed=3):
    """Label 1 where an insult or a group stands, not both: no word tells anything alone."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(5, 40)) + ["vile"] * (k % 4 in (1, 3)) + ["people"] * (k % 4 in (2, 3))
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(k % 4 in (1, 2))))
    return rows


def test_learns_pairs_that_weights_alone_cannot():
    rows = exclusive()
    train, test = rows[:900], rows[900:]
    labels = np.array([y for *_, y in train], float)
    machine = toxicity.fit([toxicity.terms(t) for _, t, _ in train], labels)
    right = lambda m: np.mean((m.scores([t for _, t, _ in test]) >= 0.5) == np.array([y for *_, y in test]))
    assert right(machine) >= 0.97
    flat = toxicity.Machine(machine.buckets, machine.bias, machine.weights, np.zeros_like(machine.factors))
    assert right(flat) < 0.8


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    n, m, k = 6, 5, 3
    has = rng.random((n, m)) < 0.5
    of, at = np.nonzero(has)
    y = rng.integers(0, 2, n).astype(float)
    b, w, v = 0.2, rng.normal(size=m), rng.normal(size=(m, k))

    def loss(b, w, v):
        z = [b + sum(w[i] for i in np.flatnonzero(r)) + sum(v[i] @ v[j] for i in np.flatnonzero(r) for j in np.flatnonzero(r) if i < j) for r in has]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    db, dw, dv = toxicity.gradients(b, w, v, at, of, y)
    e = 1e-6
    assert abs((loss(b + e, w, v) - loss(b - e, w, v)) / (2 * e) - db) < 1e-7
    for i in range(m):
        step = np.eye(m)[i] * e
        assert abs((loss(b, w + step, v) - loss(b, w - step, v)) / (2 * e) - dw[i]) < 1e-7
        for j in range(k):
            s = np.zeros((m, k))
            s[i, j] = e
            assert abs((loss(b, w, v + s) - loss(b, w, v - s)) / (2 * e) - dv[i, j]) < 1e-7


def test_pairs_formula():
    rng = np.random.default_rng(2)
    words = ["a", "b", "c"]
    buckets = np.unique([zlib.crc32(w.encode()) & toxicity.BUCKETS - 1 for w in words])
    m = toxicity.Machine(buckets, 0.3, rng.normal(size=3), rng.normal(size=(3, 4)))
    z = 0.3 + m.weights.sum() + sum(m.factors[i] @ m.factors[j] for i in range(3) for j in range(i))
    assert abs(m.scores(["C b A a"])[0] - 1 / (1 + np.exp(-z))) < 1e-12
    assert abs(m.scores([""])[0] - 1 / (1 + np.exp(-0.3))) < 1e-12


def test_nulls_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "", 0), (1, "", "", 0), (None, "vile", "", 0)], DOCS)
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 5)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), labels.limit(0)).collect() == []
