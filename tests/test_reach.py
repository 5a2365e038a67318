import random

import pytest

from loomflow.operators import reach


def closed(edges):
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen
    return out


def graphs():
    rng = random.Random(6)
    name = lambda k: f"n{k:03d}"
    cycle = [(name(k), name((k + 1) % 9)) for k in range(9)]
    yield "chain", [(name(k), name(k + 1)) for k in range(40)]
    yield "cycle", cycle + [(name(20), name(20))]
    yield "tree", [(name(rng.randrange(k)), name(k)) for k in range(1, 40)]
    yield "ladder", cycle + [(name(4), name(30)), (name(30), name(31)), (name(31), name(6)), (name(8), name(40)), (name(40), name(41)), (name(50), name(41))]
    yield "dag", [(name(a), name(b)) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(70))]
    yield "any", [(name(rng.randrange(45)), name(rng.randrange(45))) for _ in range(60)]


@pytest.mark.parametrize("name, edges", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_reach_matches_a_search(spark, name, edges):
    want = closed(edges)
    df = spark.createDataFrame(edges + edges[:2], "a string, b string")
    scc = {r["node"]: r["scc"] for r in reach.components(df).collect()}
    assert scc == {a: min([b for b in want[a] if a in want[b]] + [a]) for a in want}
    found, links = reach.index(df)
    assert found.count() == len(want)
    nodes = [*want, "elsewhere"]
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "a string, b string")
    got = {(r["a"], r["b"]): r["reached"] for r in reach.reached(pairs, found, links).collect()}
    assert got == {(a, b): b in want.get(a, ()) for a in nodes for b in nodes}


def test_empty_graph(spark):
    df = spark.createDataFrame([], "a string, b string")
    found, links = reach.index(df)
    assert [r["reached"] for r in reach.reached(spark.createDataFrame([("x", "y")], df.schema), found, links).collect()] == [False]


def test_walks_of_any_length(spark):
    edges = [("p", k, k + 1) for k in range(100)] + [("q", k, (k + 1) % 7) for k in range(7)] + [("r", 1, 2), ("r", 2, 3), ("r", 3, 2)]
    df = spark.createDataFrame(edges, "by string, node int, to int")
    starts = spark.createDataFrame([("p", 0), ("q", 3), ("r", 1), ("s", 5)], "by string, node int")
    got = sorted((r["by"], r["depth"], r["node"]) for r in reach.walk(starts, df, ["by"]).collect())
    assert got == sorted([("p", k, k) for k in range(101)] + [("q", k, (3 + k) % 7) for k in range(7)] + [("r", 0, 1), ("r", 1, 2), ("r", 2, 3), ("s", 0, 5)])
