"""What keeps queries in proportion to their tables."""

import os

from loomflow.operators.access import FlowGraph
from loomflow.plans import catalog, visual
from loomflow.sources.flowtables import calls_graph, functions_graph


def test_patterns_over_calls_are_not_dealt_again(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = FlowGraph(calls_graph(spark, sf_dir).triples)
        for made in (visual.links(graph), visual.elk(graph), graph.depends()):
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_calls_of_compositions_are_not_dealt_again(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = FlowGraph(calls_graph(spark, sf_dir).triples)
        nodes = visual.applied_nodes(graph, owned=True)
        for made in (graph.used_functions(), nodes, visual.dot(graph)):
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        # nodes are dealt to both ends, the same ones
        ends = visual.percolated(visual.links(graph, owned=True), nodes)._jdf.queryExecution().executedPlan().toString()
        assert ends.count("Exchange") == 2
        # orders alone are dealt to the lines
        starts = catalog.QUERIES["q24_get_start"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert starts.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_compositions_read_orders_alone(spark, sf_dir, tmp_path):
    os.symlink(f"{sf_dir}/orders.parquet", tmp_path / "orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert catalog.QUERIES["q22_get_compositions"](spark, str(tmp_path)).count() == n
    assert catalog.QUERIES["q23_is_composition"](spark, str(tmp_path)).first()["n"] == n


def test_patterns_over_functions_are_not_broadcast(spark, sf_dir):
    """A table of parts that Spark takes for a few megabytes has millions of terms."""
    made = functions_graph(spark, sf_dir)
    graph = FlowGraph(made.triples, made.wide)
    for found in (graph.parameters(), graph.positions(), graph.keywords(), graph.outputs(), graph.implemented(), graph.terminal_types("fno:Parameter")):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    # implementations are few, and stay where they are wanted whole
    assert graph.by_file()._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    assert (graph | calls_graph(spark, sf_dir)).wide and not calls_graph(spark, sf_dir).wide
