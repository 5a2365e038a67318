"""A function and flow graph as large as the tables it is made of.

Parts are functions, brands their implementations, lines of an order the calls of
a composition, and the order of lines its control flow. The same vocabulary as
that of described programs, so every accessor runs on it at any scale.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES
from loomflow.operators.graph import Graph, Owned, triples
from loomflow.session import table
from loomflow.sources import store
from loomflow.sources.store import KEY, Piece
from loomflow.stage import shared_dir

EX, PY = NAMESPACES["ex"], NAMESPACES["python"]


def _ex(*parts: Column | str) -> Column:
    return F.concat(F.lit(EX), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _node(*parts: Column | str) -> Column:
    return F.concat(F.lit("_:"), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _kept(rows: DataFrame) -> list[str]:
    return [KEY] if KEY in rows.columns else []


def function_triples(parts: DataFrame) -> DataFrame:
    """Functions, terminals and mappings from rows of the table part."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    f = _ex("part", F.col("p_partkey"))
    rows = parts.select("p_name", "p_size", "p_retailprice", F.col("p_partkey").alias("k"), f.alias("f"), brand.alias("brand"), F.concat(F.lit(PY), brand).alias("imp"), *_kept(parts))
    k = F.col("k")
    uri, a = "uri", "a"
    functions = triples(
        rows, F.col("f"), (a, F.lit(NAMESPACES["fno"] + "Function"), uri), (a, F.lit(NAMESPACES["prov"] + "Entity"), uri), ("rdfs:label", F.col("p_name"), "literal"),
        ("fno:expects", _node("expects", k), "bnode"), ("fno:returns", _node("returns", k), "bnode"),
    )
    given = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("i"))
    i = F.col("i")
    param = _ex("part", k, "Parameter", i)
    last = i == F.col("p_size") % 3
    parameters = triples(
        given, param, (a, F.lit(NAMESPACES["fno"] + "Parameter"), uri), ("fno:predicate", _ex("p", i), uri),
        ("fno:type", F.when(i == 0, F.col("imp")), uri), ("fno:required", F.when(~last | (F.col("p_size") % 2 == 1), "true").otherwise("false"), "literal", "xsd:boolean"),
    )
    own = rows.where("p_size % 5 = 0")
    selves = triples(own, _ex("part", k, "Self"), (a, F.lit(NAMESPACES["fno"] + "Parameter"), uri), ("fno:predicate", _ex("self"), uri))
    outputs = triples(rows, _ex("part", k, "Output"), (a, F.lit(NAMESPACES["fno"] + "Output"), uri), ("fno:predicate", _ex("result"), uri), ("fno:type", F.when(F.col("p_size") % 2 == 0, F.col("imp")), uri))
    given_back = rows.where("p_size % 7 = 0")
    self_outputs = triples(given_back, _ex("part", k, "SelfOutput"), (a, F.lit(NAMESPACES["fno"] + "Output"), uri), ("fno:predicate", _ex("self_output"), uri))
    seq = F.lit(NAMESPACES["rdf"] + "Seq")
    lists = triples(rows, _node("expects", k), (a, seq, uri)).unionByName(triples(rows, _node("returns", k), (a, seq, uri), ("rdf:_1", _ex("part", k, "Output"), uri)))
    for n in range(3):
        lists = lists.unionByName(triples(given.where(i == n), _node("expects", k), (f"rdf:_{n + 1}", param, uri)))
        lists = lists.unionByName(triples(own.where(F.col("p_size") % 3 == n), _node("expects", k), (f"rdf:_{n + 2}", _ex("part", k, "Self"), uri)))
    lists = lists.unionByName(triples(given_back, _node("returns", k), ("rdf:_2", _ex("part", k, "SelfOutput"), uri)))
    mapping = _ex("part", k, "Mapping")
    maps = triples(rows, mapping, (a, F.lit(NAMESPACES["fno"] + "Mapping"), uri), ("fno:function", F.col("f"), uri), ("fno:implementation", F.col("imp"), uri), ("fnom:mappingMethod", F.lit("default"), "literal"))

    def mapped(rows: DataFrame, node: Column, kind: str, term: Column, *more) -> DataFrame:
        own = triples(rows, mapping, ("fno:parameterMapping", node, "bnode"))
        return own.unionByName(triples(rows, node, (a, F.lit(NAMESPACES["fnom"] + kind), uri), ("fnom:functionParameter", term, uri), *more))

    maps = maps.unionByName(mapped(given, _node("pos", k, "_", i), "PositionParameterMapping", param, ("fnom:implementationParameterPosition", i, "literal", "xsd:integer")))
    maps = maps.unionByName(mapped(given, _node("prop", k, "_", i), "PropertyParameterMapping", param, ("fnom:implementationProperty", F.concat(F.lit("p"), i), "literal")))
    maps = maps.unionByName(mapped(given.where(last & (F.col("p_size") % 2 == 0)), _node("def", k), "DefaultParameterMapping", param, ("fnom:defaultValue", F.col("p_retailprice"), "literal", "xsd:double")))
    maps = maps.unionByName(mapped(given.where(last & (F.col("p_size") % 11 == 0)), _node("args", k), "VarPositionalParameterMapping", param))
    maps = maps.unionByName(mapped(given.where(last & (F.col("p_size") % 13 == 0)), _node("kwargs", k), "VarPropertyParameterMapping", param))
    out = functions
    for part in (parameters, selves, outputs, self_outputs, lists, maps):
        out = out.unionByName(part)
    return out


def implementation_triples(parts: DataFrame) -> DataFrame:
    """Implementations from the brands of rows of the table part."""
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    rows = parts.select(brand.alias("brand"), F.concat(F.lit(PY), brand).alias("imp"), *_kept(parts))
    kinds = F.element_at(F.array(*[F.lit(NAMESPACES["fnoi"] + x) for x in ("PythonFunction", "PythonMethod", "PythonClass", "PythonFile")]), (F.length("brand") + F.ascii(F.substring("brand", -1, 1))) % 4 + 1)
    brands = rows.distinct().withColumn("kind", kinds)
    implementations = triples(
        brands, F.col("imp"), ("a", F.lit(NAMESPACES["fnoi"] + "Implementation"), "uri"), ("a", F.col("kind"), "uri"), ("doap:name", F.col("brand"), "literal"),
        ("fnoi:module", F.concat(F.lit("m."), F.col("brand")), "literal"), ("fnoi:file", F.concat(F.lit("file:///src/"), F.col("brand"), F.lit(".py")), "uri"),
        ("fnoi:methodOf", F.when(F.endswith("kind", F.lit("PythonMethod")), F.lit(PY + "Base")), "uri"),
    )
    return implementations


def functions_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Functions, terminals, implementations and mappings from the table part."""
    parts = table(spark, sf_dir, "part")
    return Graph(function_triples(parts).unionByName(implementation_triples(parts)), wide=True)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with their place in the order, n, and the part of the line after them, then."""
    # lines alike in the first five columns are told apart by the others
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = lines.select("*", F.row_number().over(order).alias("n"), F.lead("l_partkey").over(order).alias("then"))
    return lines.select("l_orderkey", "n", "l_partkey", "then", "l_quantity", "l_returnflag", "l_linestatus", *_kept(lines))


def call_triples(lines: DataFrame) -> DataFrame:
    """Calls, control and data flow from rows of the table lineitem, or of numbered()."""
    uri = "uri"
    lines = lines if "n" in lines.columns else numbered(lines)
    o, n = F.col("l_orderkey"), F.col("n")
    own = lambda term: Owned(term, o)
    call, following = own(_ex("call", o, "_", n)), F.when(F.col("then").isNotNull(), _ex("call", o, "_", n + 1))
    flag = F.col("l_returnflag")
    calls = triples(lines, call, ("fnoc:applies", _ex("part", F.col("l_partkey")), uri), ("fnoc:next", own(F.when(flag == "N", following)), uri), ("fnoc:iterate", own(F.when(flag == "R", following)), uri), ("fnoc:true", own(F.when(flag == "A", following)), uri))
    comp = own(_ex("order", o, "Composition"))
    comps = triples(lines.where("n = 1"), comp, ("fnoc:start", call, uri))
    flow, to = own(_node("flow", o, "_", n)), own(_node("to", o, "_", n))
    edges = triples(lines, comp, ("fnoc:composedOf", flow, "bnode"))
    linked = lines.where("then is not null")
    begin = own(_node("from", o, "_", n))
    edges = edges.unionByName(triples(linked, flow, ("fnoc:mapFrom", begin, "bnode"), ("fnoc:priority", own(F.when(F.col("l_linestatus") == "O", call.term)), uri)))
    edges = edges.unionByName(triples(lines.where("then is null"), flow, ("fnoc:mapFromTerm", F.col("l_quantity"), "literal", "xsd:double")))
    edges = edges.unionByName(triples(lines, flow, ("fnoc:mapTo", to, "bnode")))
    edges = edges.unionByName(triples(linked, begin, ("fnoc:functionOutput", _ex("part", F.col("l_partkey"), "Output"), uri)))
    # both ends of a line in one table: Spark would deal a union of two tables anew
    ends = F.array(F.struct(F.when(F.col("then").isNotNull(), begin.term).alias("end"), call.term.alias("at")), F.struct(to.term.alias("end"), F.coalesce(following, _ex("call", o, "_1")).alias("at")))
    ends = lines.select("l_orderkey", F.explode(ends).alias("end"), *_kept(lines))
    edges = edges.unionByName(triples(ends, own(F.col("end.end")), ("fnoc:constituentFunction", own(F.col("end.at")), uri)))
    to_part = F.coalesce(F.col("then"), F.col("l_partkey"))
    edges = edges.unionByName(triples(lines, to, ("fnoc:functionParameter", _ex("part", to_part, "Parameter0"), uri), ("fnoc:mappingStrategy", F.when(flag == "R", F.lit(NAMESPACES["fnoc"] + "toList")), uri), ("fnoc:key", F.when(flag == "R", n), "literal", "xsd:integer")))
    return calls.unionByName(comps).unionByName(edges)


def composition_triples(orders: DataFrame) -> DataFrame:
    """Compositions from rows of the table orders."""
    comp = Owned(_ex("order", F.col("o_orderkey"), "Composition"), F.col("o_orderkey"))
    return triples(orders, comp, ("a", F.lit(NAMESPACES["fno"] + "Composition"), "uri"), ("fnoc:represents", _ex("part", F.col("o_custkey")), "uri"))


#: Bytes of a table's files that one bucket of its rows has.
BUCKET_BYTES = 1 << 21
_NUMBERED: dict[tuple, str] = {}
_LOCK = threading.Lock()


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines of a data folder, kept in buckets of orders as long as the table's files stay as they are.

    What is derived from them row by row and joined on the order's key is not
    dealt again.
    """
    found = store.files(spark, f"{sf_dir}/lineitem.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(found.items())))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    with _LOCK:
        if key not in _NUMBERED:
            parts = max(spark.sparkContext.defaultParallelism, sum(size for size, _ in found.values()) // BUCKET_BYTES)
            spark.catalog.refreshByPath(f"{sf_dir}/lineitem.parquet")
            lines = numbered(table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey"))
            name = f"lines_{uuid.uuid4().hex}"
            lines.write.bucketBy(parts, "l_orderkey").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
            _NUMBERED[key] = name
        return spark.table(_NUMBERED[key])


def compositions_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """What orders alone tell of compositions."""
    return Graph(composition_triples(table(spark, sf_dir, "orders")))


def calls_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Compositions, calls, control and data flow from orders and their lines."""
    return Graph(call_triples(numbered_lines(spark, sf_dir))) | compositions_graph(spark, sf_dir)


#: How the graphs' stores are made, table by table.
PIECES = {
    functions_graph: [Piece("part", lambda: F.col("p_partkey"), function_triples), Piece("part", lambda: F.col("p_brand"), implementation_triples)],
    calls_graph: [Piece("lineitem", lambda: F.col("l_orderkey"), call_triples), Piece("orders", lambda: F.col("o_orderkey"), composition_triples)],
}


def stored(spark: SparkSession, sf_dir: str, make: Callable[[SparkSession, str], Graph]) -> Graph:
    """The graph of a data folder, from a store that follows its files."""
    return store.stored(spark, sf_dir, make.__name__, PIECES[make])
