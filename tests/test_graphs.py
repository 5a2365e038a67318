"""Graphs: patterns, closures, export, execution and the standard functions."""

import json

import pytest
from pyspark.sql import functions as F

from loomflow.functions.pysem import Unsupported
from loomflow.functions.terms import bind, expand, shorten
from loomflow.operators import provenance
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Graph, Group, Lit, closure
from loomflow.plans import execute, visual
from loomflow.sources import containers, describe, standard

LOOP = "def n_sum(n: int):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n"


def local(rows, *columns):
    return sorted(tuple(str(r[c]).rpartition("#")[2] for c in columns) for r in rows.collect())


def test_patterns(spark):
    g = Graph.of(spark, [("ex:a", "ex:p", "ex:b"), ("ex:b", "ex:p", "ex:c"), ("ex:a", "ex:q", Lit("ex:b")), ("ex:c", "ex:n", Lit(3)), ("ex:d", "ex:p", "ex:d")])
    assert local(g.match([("?x", "ex:p", "?y"), ("?y", "ex:p", "?z")], "?x", "?z"), "x", "z") == [("a", "c"), ("d", "d")]
    assert local(g.match([("?x", "ex:p", "?x")]), "x") == [("d",)]
    # a literal that reads like a term is not that term
    assert local(g.match([("?x", "ex:q", "?y"), ("?y", "ex:p", "?z")]), "x") == []
    assert g.ask([("ex:c", "ex:n", Lit(3))]) and not g.ask([("ex:c", "ex:n", Lit("3 "))])
    optional = g.match(Group([("?x", "ex:p", "?y")], optional=[Group([("?y", "ex:n", "?n")])]))
    assert sorted((r["x"][-1], r["n"]) for r in optional.collect()) == [("a", None), ("b", "3"), ("d", None)]
    with pytest.raises(ValueError, match="not connected"):
        g.match([("?x", "ex:p", "?y"), ("?z", "ex:n", "?m")])
    twice = Graph(g.triples.unionByName(g.triples))
    assert Graph(twice.distinct()).triples.count() == 5 and twice.minus(g).triples.count() == 0


def test_predicates_prune_the_union(spark):
    from loomflow.sources.flowtables import functions_graph

    g = functions_graph(spark, "/root/testdata/sf0.001")
    plan = g.match([("?f", "rdfs:label", "?label")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_names():
    bind("zz", "http://z.org/ns#")
    assert expand("zz:a") == "http://z.org/ns#a" and shorten("http://z.org/ns#a") == "zz:a"
    assert expand("http://z.org/x") == "http://z.org/x"


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "s string, t string")
    got = {(r["s"], r["t"], r["steps"]) for r in closure(edges, "s", "t").collect()}
    assert got == {(p, q, n) for p, q, n in [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2), ("a", "a", 3), ("b", "b", 3), ("c", "c", 3), ("x", "y", 1)]}


def test_export_of_a_loop(spark):
    g = FlowGraph(describe.describe(LOOP).graph(spark).triples)
    assert [r["call"].rpartition("#")[2] for r in visual.hierarchy(g).orderBy("depth").collect()] == ["range_1", "iter_1", "next_1"]
    shown = json.loads(visual.elk(g).first()["json"])
    assert {c["id"] for c in shown["children"]} == {"n_sum", "range_1", "iter_1", "next_1", "op_add_1"} and len(shown["edges"]) == 6
    assert '"next_1" -> "op_add_1" [label="iterate"];' in visual.dot(g).first()["dot"]
    assert len(json.loads(visual.node_link_json(g).first()["nodes"])) == 4


def test_execution_takes_the_first_backend_that_can(spark):
    df = spark.createDataFrame([(4,), (5,)], "n bigint")
    for source, name, backend, want in ((LOOP, "n_sum", "ColumnBackend", [6, 10]), ("def f(n):\n    if n <= 1:\n        return 1\n    return n * f(n - 1)\n", "f", "PythonBackend", [24, 120])):
        g = FlowGraph(describe.describe(source, "demo").graph(spark).triples)
        out, chosen = execute.execute(df, g, name, source, ["n"], "out", "bigint")
        assert chosen["backend"] == backend and [r["out"] for r in out.collect()] == want
    prov = execute.record(spark, "ex:e", "ex:f", chosen, "ex:out", ["ex:in"], None, None)
    assert local(prov.match([("?e", "prov:wasAssociatedWith", "?i"), ("?o", "prov:wasGeneratedBy", "?e")], "?o"), "o") == [("ex:out",)]
    with pytest.raises(Unsupported, match="no implementation"):
        execute.execute(df, g, "nothing", source, ["n"], "out")


def test_resources_are_dispatched(spark, tmp_path):
    (tmp_path / "m.py").write_text(LOOP)
    (tmp_path / "Dockerfile").write_text("FROM x\n")
    for resource in (str(tmp_path / "m.py"), str(tmp_path)):
        assert FlowGraph(execute.describe(spark, resource).triples).compositions().count() >= 1
    assert execute.describe(spark, str(tmp_path / "Dockerfile")).ask([("?f", "a", "do:Dockerfile")])
    execute.DESCRIBERS.append((lambda r: r == "mine", lambda s, r: standard.library(s)))
    assert execute.describe(spark, "mine").exists("cf:if")
    execute.DESCRIBERS.clear()
    assert standard.has("do:run") and not standard.has("do:nothing")


def test_images_and_relations(spark):
    rows = spark.createDataFrame([("sha", "t:1", "2024", 5)], "id string, tag string, created string, size bigint")
    g = containers.image_rows(rows) | provenance.relation(rows, F.col("id"), "prov:wasDerivedFrom", F.col("tag")) | provenance.default_input(rows, F.col("id"), F.lit("x"))
    assert g.ask([("?i", "a", "do:Image")]) and g.ask([("sha", "do:defaultInput", Lit("x"))])
    assert [tuple(r) for r in provenance.lineage(g).collect()] == [("sha", "t:1", 1)]


def test_both_sides_of_a_branch_reach_what_follows():
    d = describe.describe("def g(a):\n    if a > 0:\n        b = a + 1\n    else:\n        b = a - 1\n    return b * 2\n")
    (comp,) = d.compositions.values()
    assert {s.call for s, t, _ in comp["flow"] if t[:2] == ("op_mul_1", "op_mulParameter0")} == {"op_add_1", "op_sub_1"}


def test_what_is_staged_inside_is_deleted(spark):
    import os

    from loomflow.stage import Staged, cleared

    kept = Staged(spark, "kept").save(spark.range(3))
    with cleared(spark):
        inside = Staged(spark, "inside").save(spark.range(4))
        assert inside.count() == 4
    assert kept.count() == 3
    assert not os.path.exists(inside.staged_path.removeprefix("file://"))


def test_store_reads_only_the_predicates_asked_for(spark, sf_dir):
    from loomflow.sources.flowtables import functions_graph, stored

    graph = stored(spark, sf_dir, functions_graph)
    again = stored(spark, sf_dir, functions_graph)
    plan = graph.match([("?f", "rdfs:label", "?label")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "rdf-schema#label" in plan
    assert graph.triples.exceptAll(functions_graph(spark, sf_dir).triples).isEmpty() and again.triples.inputFiles()
