import numpy as np
import pytest

from loomflow.llm import embeddings
from tests.llm import brute

VECTORS = "vec_id bigint, embedding array<float>, uid string, v int"


def table(seed=5, n=220, d=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, d))
    out = {}
    for k in range(n):
        v = centre[rng.integers(20)] + rng.normal(size=d) * rng.choice([0.05, 0.3, 0.45])
        out[k] = v.astype(np.float32).tolist()
    out[n] = out[1]
    out |= {n + 1: None, n + 2: [0.0] * d, n + 3: [float("nan")] * d, n + 4: [1.0, None] + [0.0] * (d - 2), n + 5: [], n + 6: [float("inf")] * d, n + 7: out[2][:5], n + 8: out[2][:5]}
    return out


@pytest.mark.parametrize("rows", [20, 1024])
def test_matches_brute_force(spark, monkeypatch, rows):
    # also with cells that are dealt into groups
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "GROUP_ROWS", rows)
    monkeypatch.setattr(embeddings, "GROUP_BYTES", 1)
    monkeypatch.setattr(embeddings, "MOST_CELLS", 5 if rows == 20 else 128)
    data = table()
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in data.items()], VECTORS).repartition(3)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near(df).collect()}
    assert got == brute.cosine_links(data)
    assert sum(n > 0 for _, n, *_ in got) > 50


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 40))
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 40)) * 0.4])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = embeddings.Tiles(x, embeddings.principal_axes(x[:50]))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i < j}
    got = set()
    for s in range(len(t.spans)):
        for u in range(s, len(t.spans)):
            i, j = embeddings.tile_pairs(t, t, s, u, 0.9)
            got |= {tuple(sorted(p)) for p in zip(t.order[i].tolist(), t.order[j].tolist(), strict=True) if p[0] != p[1]}
    assert want <= got


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], "", 0), (1, [1.0, 0.0], "", 0), (None, [1.0, 0.1], "", 0), (4, [0.0, 1.0], "", 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((tuple(r) for r in embeddings.near(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 0, 4, True)], key=str)
    assert embeddings.near(df.limit(0)).collect() == []


def test_components_of_any_finite_size(spark):
    big, small = [1e200, 1e200], [1e-200, 2e-200]
    rows = [(1, big), (2, big), (3, [1.0, 1.0]), (4, small), (5, [1.0, 2.0]), (6, [5e-324, -5e-324]), (7, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near(df).collect()}
    # 1, 1 and 1, 2 have a cosine of 0.949
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (1, 6), 7: (1, 6)}


def test_any_two_cells_meet_once():
    for n in range(1, 9):
        for a in range(n):
            assert not embeddings.visits(np.int64(a), np.int64(a), n)
            for b in range(a):
                assert bool(embeddings.visits(np.int64(a), np.int64(b), n)) != bool(embeddings.visits(np.int64(b), np.int64(a), n))


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP_ROWS", 40)
    monkeypatch.setattr(embeddings, "GROUP_BYTES", 1)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(25, 16))
    x = centre[rng.integers(25, size=1000)] + rng.normal(size=(1000, 16)) * 0.12
    sent = []
    repartition = type(spark.range(1)).repartition

    def counted(frame, *by):
        if by == ("home",):
            sent.append(frame.count())
        return repartition(frame, *by)

    monkeypatch.setattr(type(spark.range(1)), "repartition", counted)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near(df).collect()}
    assert got == brute.cosine_links({k: v.tolist() for k, v in enumerate(x)})
    # of some 25 groups
    assert len(sent) == 1 and sent[0] < 4 * len(x)
