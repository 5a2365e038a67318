import random

import pytest
from pyspark.sql import functions as F

from loomflow.operators import reach, units
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import closure
from loomflow.plans import visual
from loomflow.sources.flowtables import calls_graph

from .test_reach import closed


def shortest(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        level, steps = {a}, 0
        while level:
            steps += 1
            level = {y for x, y in edges if x in level and (a, y) not in out}
            out |= {(a, y): steps for y in level}
    return out


def groups():
    rng = random.Random(9)
    yield "chain", [(k, k + 1) for k in range(7)]
    yield "cycle", [(k, (k + 1) % 5) for k in range(5)] + [(9, 9), (4, 9)]
    yield "all bits", [(2 * k, 2 * k + 1) for k in range(units.MOST)]
    yield "long", [(k, k + 1) for k in range(units.MOST + 8)]
    yield "ring", [(k, (k + 1) % 50) for k in range(50)]
    for k in range(8):
        yield f"any{k}", sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 20))})


def test_closure_of_small_and_large_groups(spark):
    rows = [(name, f"n{a}", f"n{b}") for name, edges in groups() for a, b in edges]
    df = spark.createDataFrame([*rows, rows[0]], "g string, a string, b string")
    got = sorted((r["g"], r["a"], r["b"], r["steps"]) for r in closure(df, "a", "b", ("g",)).collect())
    assert got == sorted((name, f"n{a}", f"n{b}", n) for name, edges in groups() for (a, b), n in shortest(edges).items())


@pytest.mark.parametrize("crossing", [False, True])
def test_pairs_of_small_large_and_crossing_groups(spark, crossing):
    found = list(groups())
    edges = [(i + 1, i + 1, f"{name}/{a}", f"{name}/{b}") for i, (name, pairs) in enumerate(found) for a, b in pairs]
    edges += [(1, 2, "chain/7", "cycle/0")] * crossing
    want = closed([e[2:] for e in edges])
    of = {x: n for m, k, a, b in edges for x, n in ((a, m), (b, k))}
    rng = random.Random(2)
    pairs = [(of[a], a, b) for a in want for b in [*rng.sample(sorted(want), 6), *sorted(want[a])[:3], "chain/0", "cycle/2"]]
    pairs += [(77, "elsewhere", "chain/0"), pairs[0]]
    df = spark.createDataFrame(edges, "_of_a long, _of_b long, a string, b string")
    got = [(r["a"], r["b"], r["reached"]) for r in reach.told(spark.createDataFrame(pairs, "_of_a long, a string, b string"), df).collect()]
    assert sorted(got) == sorted({(a, b, b in want.get(a, ())) for _, a, b in pairs})


def test_walks_of_small_groups_take_no_rounds(spark, monkeypatch):
    edges = [("p", k, k + 1) for k in range(20)] + [("q", k, (k + 1) % 7) for k in range(7)] + [("r", 1, 2), ("r", 2, 3), ("r", 3, 2)]
    starts = spark.createDataFrame([("p", 0), ("q", 3), ("r", 1), ("s", 5)], "by string, node int")
    monkeypatch.setattr(reach, "_doubled", None)
    got = sorted((r["by"], r["depth"], r["node"]) for r in reach.walk(starts, spark.createDataFrame(edges, "by string, node int, to int"), ["by"]).collect())
    assert got == sorted([("p", k, k) for k in range(21)] + [("q", k, (3 + k) % 7) for k in range(7)] + [("r", 0, 1), ("r", 1, 2), ("r", 2, 3), ("s", 0, 5)])


def test_orders_are_closed_without_rounds(spark, sf_dir, monkeypatch):
    """Failed before: every order went through rounds of joins, or through the index of all calls."""
    graph = FlowGraph(calls_graph(spark, sf_dir).triples)
    depends = graph.depends()
    monkeypatch.setattr(reach, "index", None)
    monkeypatch.setattr("loomflow.operators.graph._doubled", None)
    monkeypatch.setattr(reach, "_doubled", None)
    assert graph.depends_closure().where("steps = 1").count() == depends.count()
    pairs = depends.select(F.lit(0).cast("long").alias("_of_a"), F.col("on").alias("a"), F.col("call").alias("b"))
    assert graph.reaches(pairs.limit(5)).count() == 5
    assert visual.hierarchy(graph).where("depth = 0").count() == graph.match([("?c", "fnoc:start", "?s")]).count()
