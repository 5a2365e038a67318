"""Provenance of executions as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES
from loomflow.operators.graph import Graph, closure, triples

PROV = NAMESPACES["prov"]


def executions(rows: DataFrame) -> Graph:
    """Activities of rows (exe, fn, imp, generated, used array, started_at, ended_at)."""
    exe, node = F.col("exe"), F.concat(F.lit("_:association"), F.substring(F.sha2("exe", 256), 1, 12))
    uri = "uri"
    out = triples(
        rows, exe, ("a", F.lit(PROV + "Activity"), uri), ("prov:used", F.col("fn"), uri), ("prov:wasAssociatedWith", F.col("imp"), uri), ("prov:qualifiedAssociation", node, "bnode"),
        ("prov:startedAtTime", F.col("started_at"), "literal", "xsd:dateTime"), ("prov:endedAtTime", F.col("ended_at"), "literal", "xsd:dateTime"),
    )
    out = out.unionByName(triples(rows, F.col("fn"), ("a", F.lit(PROV + "Entity"), uri))).unionByName(triples(rows, F.col("imp"), ("a", F.lit(PROV + "Agent"), uri)))
    out = out.unionByName(triples(rows, node, ("a", F.lit(PROV + "Association"), uri), ("prov:agent", F.col("imp"), uri), ("prov:hadRole", F.lit(NAMESPACES["ex"] + "implementation"), uri), ("prov:hadPlan", F.col("fn"), uri)))
    out = out.unionByName(triples(rows, F.col("generated"), ("prov:wasGeneratedBy", exe, uri), ("a", F.lit(PROV + "Entity"), uri)))
    used = rows.select("exe", F.explode("used").alias("u"))
    out = out.unionByName(triples(used, F.col("exe"), ("prov:used", F.col("u"), uri))).unionByName(triples(used, F.col("u"), ("a", F.lit(PROV + "Entity"), uri)))
    return Graph(out.dropDuplicates())


def relation(rows: DataFrame, subject: Column, predicate: str, of: Column) -> Graph:
    """alternateOf, wasDerivedFrom, do:includes and the like, for each row."""
    return Graph(triples(rows, subject, (predicate, of, "uri")))


def default_input(rows: DataFrame, image: Column, value: Column) -> Graph:
    return Graph(triples(rows, image, ("do:defaultInput", value, "literal")))


def lineage(graph: Graph) -> DataFrame:
    """(entity, source, steps): what each entity was derived from, directly or through others, by the fewest steps; cycles end."""
    one = graph.match([("?entity", ("prov:wasDerivedFrom", "prov:alternateOf"), "?source")])
    return closure(one, "entity", "source").where("entity <> source")
