"""Hierarchies, ports and links of a flow graph, for viewers.

A path along control edges never visits a call twice, so loops end. Only what a
viewer shows is gathered into one value, and that for each composition by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.functions.terms import local_name
from loomflow.operators import reach
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import OWNERS, owners, plain


def hierarchy(graph: FlowGraph) -> DataFrame:
    """(composition, depth, call) along next edges from each start, until there is none or a call comes again.

    Calls are rows, and paths of any length take as many rounds of joins as their
    length has binary places. A call with two successors follows the first by name.
    """
    start = graph.match([("?composition", "fnoc:start", "?node")], owned=True)
    successor = graph.match([("?call", "fnoc:next", "?to")], owned=True)
    successor = successor.groupBy(*owners(successor, "call")).agg(F.min("to").alias("to"))
    after = graph.used_functions(successor, owned=True).withColumnRenamed("call", "node")
    return reach.walk(start, after, ["composition"]).select("composition", F.col("depth").cast("int").alias("depth"), F.col("node").alias("call"))


def layers(graph: FlowGraph) -> DataFrame:
    """One more than the number of compositions with a start."""
    return graph.match([("?composition", "fnoc:start", "?call")], "?composition").agg((F.count("*") + 1).alias("layers"))


def applied_nodes(graph: FlowGraph, owned: bool = False) -> DataFrame:
    """(composition, call, f, node): the function of each call, numbered where a composition uses it again; owned: with the number of the composition."""
    used = graph.used_functions(graph.match([("?call", "fnoc:applies", "?f")], owned=True), owned=True)
    again = F.row_number().over(Window.partitionBy(*owners(used, "composition"), "f").orderBy("call"))
    return used.select(*owners(used, "composition") if owned else ("composition",), "call", "f", F.concat(local_name(F.col("f")), F.when(again > 1, F.concat(F.lit("_"), again)).otherwise("")).alias("node"))


def links(graph: FlowGraph, owned: bool = False) -> DataFrame:
    """(composition, source, source_port, target, target_port): data edges between terminals of calls; owned as in match()."""
    return graph.match(
        [
            ("?composition", "fnoc:composedOf", "?edge"), ("?edge", "fnoc:mapFrom", "?a"), ("?a", "fnoc:constituentFunction", "?source"), ("?a", ("fnoc:functionOutput", "fnoc:functionParameter"), "?source_port"),
            ("?edge", "fnoc:mapTo", "?b"), ("?b", "fnoc:constituentFunction", "?target"), ("?b", ("fnoc:functionParameter", "fnoc:functionOutput"), "?target_port"),
        ],
        "?composition", "?source", "?source_port", "?target", "?target_port", owned=owned,
    )


def ports(graph: FlowGraph) -> DataFrame:
    """(f, terminal, label): parameters by their property, outputs as out."""
    named = graph.keywords().select("f", F.col("parameter").alias("terminal"), F.col("property").alias("label"))
    return named.unionByName(graph.outputs().select("f", F.col("output").alias("terminal"), F.lit("out").alias("label")))


def percolated(links_: DataFrame, nodes: DataFrame, owned: bool = False) -> DataFrame:
    """Links with both ends named as the nodes of their composition; owned: with the numbers that they have.

    Both ends take nodes by a number computed anew, so Spark deals the nodes, once, and
    does not make them twice where they are.
    """
    by = [c for c in owners(nodes, "composition") if c in links_.columns]
    number = [F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) if c.startswith("_of_") else F.col(c) for c in by]
    for side in ("source", "target"):
        links_ = links_.join(nodes.select(*number, F.col("call").alias(side), F.col("node").alias(f"{side}_node")), [*by, side])
    return links_ if owned else plain(links_)


def elk(graph: FlowGraph) -> DataFrame:
    """(composition, json): children with ports, and edges, of each composition in the layout format ELK reads."""
    local = lambda c: local_name(F.col(c))
    edges = links(graph, owned=True)
    by = owners(edges, "composition")
    ends = edges.select(*by, F.explode(F.array(*[F.struct(F.col(c).alias("call"), F.col(f"{c}_port").alias("port"), F.lit(side).alias("side")) for c, side in (("source", "EAST"), ("target", "WEST"))])).alias("end")).select(*by, "end.*").distinct()
    boxes = ends.groupBy(*by, "call").agg(F.array_sort(F.collect_list(F.struct(F.concat(local("call"), F.lit("."), local("port")).alias("id"), F.struct(F.col("side").alias("port_side")).alias("properties")))).alias("ports"))
    children = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(local("call").alias("id"), "ports"))).alias("children"))
    lines = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.concat(local("source"), F.lit("."), local("source_port")).alias("source"), F.concat(local("target"), F.lit("."), local("target_port")).alias("target")))).alias("edges"))
    shaped = F.transform("edges", lambda e, i: F.struct(F.concat(F.lit("e"), i).alias("id"), F.array(e["source"]).alias("sources"), F.array(e["target"]).alias("targets")))
    return children.join(lines, by).select("composition", F.to_json(F.struct(local("composition").alias("id"), "children", shaped.alias("edges"))).alias("json"))


def node_link_json(graph: FlowGraph) -> DataFrame:
    """(composition, nodes, links) as JSON lists."""
    nodes = applied_nodes(graph, owned=True)
    named = percolated(links(graph, owned=True), nodes, owned=True)
    by = owners(nodes, "composition")
    a = nodes.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("node").alias("key"), local_name(F.col("f")).alias("text"))))).alias("nodes"))
    b = named.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("source_node").alias("from"), F.col("target_node").alias("to"))))).alias("links"))
    return a.join(b, by, "left").select("composition", "nodes", "links")


def dot(graph: FlowGraph) -> DataFrame:
    """(composition, dot): the control flow of each composition as a DOT text."""
    of = [F.col(OWNERS[0]).alias("_of_call")] if OWNERS[0] in graph.triples.columns else []
    rows = graph.triples.where(F.col("p").rlike("composition#(next|iterate|true|false)$")).select(*of, F.col("s").alias("call"), local_name(F.col("p")).alias("kind"), F.col("o").alias("to"))
    inside = graph.used_functions(rows, owned=True)
    by = owners(inside, "composition")
    lines = inside.select(*by, F.concat(F.lit('  "'), local_name(F.col("call")), F.lit('" -> "'), local_name(F.col("to")), F.lit('" [label="'), "kind", F.lit('"];')).alias("line"))
    return lines.groupBy(*by).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_set("line")), "\n"), F.lit("\n}")).alias("dot")).select("composition", "dot")


def write_elk(graph: FlowGraph, path: str) -> None:
    """A JSON object for each composition, one in a line."""
    elk(graph).select(F.col("json").alias("value")).write.text(path)
