"""Builders of flow graphs over tables: each takes rows and columns and gives the triples of one kind of node or edge.

Null subjects and objects give no triples, so an edge without an end is left out.
The triples of several builders are put together with union(); a graph is a set,
so the same triple may be built twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.functions.terms import expand
from loomflow.operators.graph import triples

# Datatypes of literals by Spark's types; other types have none.
_DATATYPES = {
    "byte": "xsd:integer", "short": "xsd:integer", "integer": "xsd:integer", "long": "xsd:integer", "float": "xsd:double", "double": "xsd:double", "decimal": "xsd:decimal",
    "boolean": "xsd:boolean", "date": "xsd:date", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime",
}


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def literal(kind: T.DataType, value: Column) -> tuple[Column, str | None]:
    """(text, datatype) of a value: numbers and truth as they are spelt, times in ISO form, other values as text without a datatype."""
    name = kind.typeName()
    if name in ("timestamp", "timestamp_ntz"):
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    return value.cast("string"), _DATATYPES.get(name)


def literals(rows: DataFrame, s: Column, **predicates: str) -> DataFrame:
    """Triples of columns as literals: predicates by the columns' names."""
    parts = []
    for column, predicate in predicates.items():
        text, datatype = literal(rows.schema[column].dataType, F.col(column))
        parts.append(triples(rows, s, (predicate, text, "literal", *([datatype] if datatype else []))))
    return union(*parts)


def call(rows: DataFrame, call: Column, f: Column) -> DataFrame:
    """A call applies a function."""
    return triples(rows, call, ("fnoc:applies", f, "uri"))


def control(rows: DataFrame, call: Column, to: Column, kind: Column | str = "next") -> DataFrame:
    """A call is followed by another: next, iterate, true or false."""
    if isinstance(kind, str):
        return triples(rows, call, (f"fnoc:{kind}", to, "uri"))
    return union(*[triples(rows.where(kind == k), call, (f"fnoc:{k}", to, "uri")) for k in ("next", "iterate", "true", "false")])


def start(rows: DataFrame, composition: Column, call: Column) -> DataFrame:
    """A composition starts with a call."""
    return triples(rows, composition, ("fnoc:start", call, "uri"))


def composition(rows: DataFrame, composition: Column, f: Column) -> DataFrame:
    """A composition represents a function."""
    return triples(rows, composition, ("a", F.lit(expand("fno:Composition")), "uri"), ("fnoc:represents", f, "uri"))


def endpoint(rows: DataFrame, node: Column, call: Column, terminal: Column, output: bool, strategy: Column | None = None, key: Column | None = None) -> DataFrame:
    """One end of a data edge: a terminal of a call, and how values are put together there."""
    more = [] if strategy is None else [("fnoc:mappingStrategy", strategy, "uri")]
    more += [] if key is None else [("fnoc:key", key, "literal", "xsd:integer")]
    return triples(rows, node, ("fnoc:constituentFunction", call, "uri"), ("fnoc:functionOutput" if output else "fnoc:functionParameter", terminal, "uri"), *more)


def data_edge(rows: DataFrame, composition: Column, edge: Column, source: Column | None, target: Column, term: Column | None = None, priority: Column | None = None) -> DataFrame:
    """A composition maps an endpoint, or a constant where there is none, to another."""
    own = [("fnoc:mapTo", target, "bnode")]
    own += [] if source is None else [("fnoc:mapFrom", source, "bnode")]
    own += [] if term is None else [("fnoc:mapFromTerm", term, "literal")]
    own += [] if priority is None else [("fnoc:priority", priority, "uri")]
    return union(triples(rows, composition, ("fnoc:composedOf", edge, "bnode")), triples(rows, edge, *own))


def function(rows: DataFrame, f: Column, label: Column, parameters: Column, outputs: Column) -> DataFrame:
    """A function with its label and its lists of parameters and outputs (arrays of terms), members numbered from 1."""
    parts = [triples(rows, f, ("a", F.lit(expand("fno:Function")), "uri"), ("rdfs:label", label, "literal"))]
    for predicate, members, name in (("fno:expects", parameters, "expects"), ("fno:returns", outputs, "returns")):
        node = F.concat(F.lit("_:"), F.substring_index(f, "#", -1), F.lit(name))
        parts.append(triples(rows, f, (predicate, node, "bnode")))
        parts.append(triples(rows, node, ("a", F.lit(expand("rdf:Seq")), "uri")))
        listed = rows.select(node.alias("s"), F.posexplode(members).alias("n", "o"))
        member = F.concat(F.lit(expand("rdf:_")), (F.col("n") + 1).cast("string"))
        parts.append(listed.select("s", member.alias("p"), "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")).where("s is not null and o is not null"))
    return union(*parts)


def terminal(rows: DataFrame, term: Column, kind: str, predicate: Column, type_: Column | None = None, required: Column | None = None) -> DataFrame:
    """A Parameter or an Output: its predicate, type and whether it is required."""
    more = [] if type_ is None else [("fno:type", type_, "uri")]
    more += [] if required is None else [("fno:required", required.cast("string"), "literal", "xsd:boolean")]
    return triples(rows, term, ("a", F.lit(expand(f"fno:{kind}")), "uri"), ("fno:predicate", predicate, "uri"), *more)


def implementation(rows: DataFrame, imp: Column, kind: Column, name: Column, module: Column | None = None, file: Column | None = None, method_of: Column | None = None) -> DataFrame:
    """An implementation of a kind, with what finds it."""
    more = [(p, c, k) for p, c, k in (("fnoi:module", module, "literal"), ("fnoi:file", file, "uri"), ("fnoi:methodOf", method_of, "uri")) if c is not None]
    return triples(rows, imp, ("a", F.lit(expand("fnoi:Implementation")), "uri"), ("a", kind, "uri"), ("doap:name", name, "literal"), *more)


def mapping(rows: DataFrame, mapping: Column, f: Column, imp: Column) -> DataFrame:
    """A function is implemented by an implementation."""
    return triples(rows, mapping, ("a", F.lit(expand("fno:Mapping")), "uri"), ("fno:function", f, "uri"), ("fno:implementation", imp, "uri"))


def parameter_mapping(rows: DataFrame, mapping: Column, node: Column, term: Column, position: Column | None = None, name: Column | None = None, default: Column | None = None, rest: str | None = None) -> DataFrame:
    """How a parameter is passed: by position, by name, with a default, or as what is left (`args` or `kwargs`)."""
    parts = []
    for kind, predicate, value in (
        ("PositionParameterMapping", "fnom:implementationParameterPosition", position), ("PropertyParameterMapping", "fnom:implementationProperty", name), ("DefaultParameterMapping", "fnom:defaultValue", default),
        ("VarPositionalParameterMapping", None, F.lit(True) if rest == "args" else None), ("VarPropertyParameterMapping", None, F.lit(True) if rest == "kwargs" else None),
    ):
        if value is not None:
            some = rows.where(value.isNotNull())
            of = F.concat(node, F.lit("_" + kind[:-16]))
            parts.append(triples(some, mapping, ("fno:parameterMapping", of, "bnode")))
            own = [(predicate, value, "literal")] if predicate else []
            parts.append(triples(some, of, ("a", F.lit(expand(f"fnom:{kind}")), "uri"), ("fnom:functionParameter", term, "uri"), *own))
    return union(*parts)


def parameters_by_count(rows: DataFrame, f: Column, n: Column) -> DataFrame:
    """Positions alone, for functions that tell no signature: n parameters `p0` and so on."""
    given = rows.where(n > 0).select(f.alias("f"), F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
    term = F.concat("f", F.lit("Parameter"), F.col("i").cast("string"))
    made = F.concat("f", F.lit("Mapping"))
    node = F.concat(F.lit("_:"), F.substring_index(F.col("f"), "#", -1), F.lit("_"), F.col("i").cast("string"))
    return union(terminal(given, term, "Parameter", F.concat(F.lit(expand("ex:p")), F.col("i").cast("string"))), parameter_mapping(given, made, node, term, position=F.col("i")))
