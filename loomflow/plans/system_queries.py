"""Queries of container files, provenance, export, streams, builders and learners."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions import terms as t
from loomflow.operators import frames, learn, provenance, series
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Graph, Lit
from loomflow.plans import visual
from loomflow.plans.graph_queries import _CTES, local
from loomflow.plans.program_queries import TRIPLE_SUM
from loomflow.session import table
from loomflow.stage import shared_dir
from loomflow.sources import arrow, containers, describe, imports, readers, standard, turtle
from loomflow.sources.flowtables import calls_graph, functions_graph
from loomflow.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows of described programs against the rows spelt out. They read no table, so they are tests and not queries.
FIXED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _fixed(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    FIXED[name] = (make, sql)


def _q(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


# container files: one for each nation

_LINES = """FROM base:{k}
# a comment
RUN apt-get update && \\
    apt-get install x{k}
WORKDIR /app
COPY ./src /app/src
RUN make
WORKDIR sub
ENTRYPOINT ["python", "run.py"]
CMD ["1", "2"]
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.lit(_LINES), F.lit("{k}"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("/images/"), "n_name", F.lit("/Dockerfile")).alias("path"), text.alias("text"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.instructions(_files(spark, sf_dir))


_INST = """files AS (SELECT '/images/' || n_name || '/Dockerfile' AS file, n_nationkey k FROM nation),
inst AS (SELECT file, ord, inst, replace(value, '{k}', k::VARCHAR) AS value FROM files, (VALUES (0, 'FROM', 'base:{k}'), (1, 'RUN', 'apt-get update && apt-get install x{k}'), (2, 'WORKDIR', '/app'), (3, 'COPY', './src /app/src'),
(4, 'RUN', 'make'), (5, 'WORKDIR', 'sub'), (6, 'ENTRYPOINT', '["python", "run.py"]'), (7, 'CMD', '["1", "2"]')) v(ord, inst, value))"""
_q("k01_instructions", _rows, f"WITH {_INST} SELECT file, ord, inst, value FROM inst")
_q("k03_run_call", lambda s, d: containers.runs(_rows(s, d)).select("file", "workdir", F.array_join("call", " ").alias("call")), f"WITH {_INST} SELECT file, '/app/sub' AS workdir, 'python run.py 1 2' AS call FROM files")
_q("k05_copy", lambda s, d: containers.copies(_rows(s, d)), f"WITH {_INST} SELECT file, ord, './src' AS source, '/app/src' AS target FROM inst WHERE inst = 'COPY'")
_q("k06_workdir", lambda s, d: containers.state(_rows(s, d)).select("file", "ord", "workdir"), f"WITH {_INST} SELECT file, ord, CASE WHEN ord < 2 THEN '/' WHEN ord < 5 THEN '/app' ELSE '/app/sub' END AS workdir FROM inst")
_q("k07_chain", lambda s, d: containers.chain(_rows(s, d)).select("file", "call", "from_call", "next"), f"""
WITH {_INST}, named AS (SELECT file, ord, lower(inst) || '_' || row_number() OVER (PARTITION BY file, inst ORDER BY ord) AS call FROM inst)
SELECT file, call, lag(call) OVER w AS from_call, lead(call) OVER w AS "next" FROM named WINDOW w AS (PARTITION BY file ORDER BY ord)""")


def _imps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").join(table(spark, sf_dir, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    file = F.concat(F.lit("/images/"), "n_name", F.when(F.col("p_size") % 2 == 0, "/src/m").otherwise("/doc/m"), "p_partkey", F.lit(".py"))
    rows = rows.select(F.concat(F.lit("f"), "p_partkey").alias("name"), F.concat(F.lit("m"), "p_partkey").alias("module"), F.lit(None).cast("string").alias("package"), file.alias("file"))
    return rows.withColumn("imp", t.minted(F.col("name"), F.col("module"), F.col("package"), F.col("file")))


_q("k10_relocate", lambda s, d: local(containers.relocated(_imps(s, d), containers.copies(_rows(s, d)))), """
WITH i AS (SELECT 'f' || p_partkey AS name, 'm' || p_partkey AS module, '/images/' || n_name || '/src/m' || p_partkey || '.py' AS file, '/app/src/m' || p_partkey || '.py' AS moved, n_name FROM part JOIN nation ON p_partkey % 25 = n_nationkey WHERE p_size % 2 = 0)
SELECT name || left(sha256(module || moved), 8) AS imp, name || left(sha256(module || file), 8) AS alternate_of, moved AS file, '/images/' || n_name || '/Dockerfile' AS image FROM i""")
_fixed("b12_docker_graph", lambda s, d: containers.describe_dockerfile(_LINES.replace("{k}", "3"), "/images/demo/Dockerfile").graph(s).triples.groupBy("p").agg(F.count("*").alias("n")).select(t.local_name(F.col("p")).alias("p"), "n").where("p in ('applies', 'next', 'start', 'composedOf', 'mapFromTerm', 'mapFrom')"), "SELECT p, CAST(n AS BIGINT) AS n FROM (VALUES ('applies', 8), ('next', 7), ('start', 1), ('composedOf', 19), ('mapFromTerm', 11), ('mapFrom', 8)) v(p, n)")

# provenance: every order is an execution


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = F.lit(t.NAMESPACES["ex"])
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(ex, F.lit("exe"), key).alias("exe"), F.concat(ex, F.lit("fn"), F.col("o_orderstatus")).alias("fn"), F.concat(F.lit(t.NAMESPACES["python"]), F.col("o_orderpriority")).alias("imp"),
        F.concat(ex, F.lit("result"), key).alias("generated"), F.array(F.concat(ex, F.lit("customer"), F.col("o_custkey").cast("string"))).alias("used"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("string").alias("ended_at"),
    )


_q("b13_prov_counts", lambda s, d: provenance.executions(_executions(s, d)).triples.select(t.local_name(F.col("p")).alias("p")).groupBy("p").agg(F.count("*").alias("n")), """
WITH o AS (SELECT * FROM orders), k AS (SELECT count(*) n, count(DISTINCT o_orderstatus) f, count(DISTINCT o_orderpriority) i, count(DISTINCT o_custkey) c FROM o)
SELECT 'type' AS p, 3 * n + f + i + c AS n FROM k UNION ALL SELECT unnest(['wasAssociatedWith', 'qualifiedAssociation', 'startedAtTime', 'agent', 'hadRole', 'hadPlan', 'wasGeneratedBy']), n FROM k UNION ALL SELECT 'used', 2 * n FROM k""")
_fixed("b13_lineage", lambda s, d: local(provenance.lineage(Graph.of(s, [(f"ex:v{k}", "prov:wasDerivedFrom", f"ex:v{k + 1}") for k in range(5)] + [("ex:v5", "prov:wasDerivedFrom", "ex:v3")]))).select("entity", "source", "steps"), """
WITH RECURSIVE e AS (SELECT 'v' || k AS a, 'v' || (k + 1) AS b FROM range(5) t(k) UNION ALL SELECT 'v5', 'v3'),
w AS (SELECT a, b, 1 AS n FROM e UNION ALL SELECT w.a, e.b, n + 1 FROM w JOIN e ON w.b = e.a WHERE n < 12)
SELECT a AS entity, b AS source, min(n)::INT AS steps FROM w WHERE a <> b GROUP BY 1, 2""")

# export

_WALK = f"WITH {_CTES['calls']}"


def _percolated(g: FlowGraph) -> DataFrame:
    """Links between the numbered nodes of their compositions: a function that is used again is a node of its own."""
    return visual.percolated(visual.links(g, owned=True), visual.applied_nodes(g, owned=True)).select("composition", "source", "source_node", "target", "target_node")


_q("v01_hierarchy", lambda s, d: local(visual.hierarchy(FlowGraph(calls_graph(s, d).triples))), _WALK + """, stop AS (SELECT *, min(CASE WHEN flag <> 'N' THEN n END) OVER (PARTITION BY o) AS s FROM calls)
SELECT 'order' || o || 'Composition' AS composition, CAST(n - 1 AS INT) AS depth, 'call' || o || '_' || n AS call FROM stop WHERE s IS NULL OR n <= s""")
_q("v02_applied", lambda s, d: local(visual.applied_nodes(FlowGraph(calls_graph(s, d).triples))).groupBy("composition", "f").agg(F.count("*").alias("n"), F.max("node").alias("last")), _WALK + """
SELECT 'order' || o || 'Composition' AS composition, 'part' || p AS f, count(*) AS n, max(CASE WHEN r > 1 THEN 'part' || p || '_' || r ELSE 'part' || p END) AS last
FROM (SELECT o, p, row_number() OVER (PARTITION BY o, p ORDER BY 'call' || o || '_' || n) r FROM calls) GROUP BY o, p""")
_q("v03_links", lambda s, d: local(visual.links(FlowGraph(calls_graph(s, d).triples))), _WALK + """
SELECT 'order' || o || 'Composition' AS composition, 'call' || o || '_' || n AS source, 'part' || p || 'Output' AS source_port, 'call' || o || '_' || (n + 1) AS target, 'part' || nxt || 'Parameter0' AS target_port FROM calls WHERE nxt IS NOT NULL""")
_q("v04_ports", lambda s, d: local(visual.ports(FlowGraph(functions_graph(s, d).triples, True))), f"WITH {_CTES['funs']}, {_CTES['params']} SELECT 'part' || k AS f, 'part' || k || 'Parameter' || i AS terminal, 'p' || i AS label FROM params UNION ALL SELECT 'part' || k, 'part' || k || 'Output', 'out' FROM funs")
_EDGE = "array<struct<id:string,sources:array<string>,targets:array<string>>>"
_q("v05_elk", lambda s, d: visual.elk(FlowGraph(calls_graph(s, d).triples)).select(t.local_name(F.col("composition")).alias("composition"), F.explode(F.from_json("json", f"edges {_EDGE}")["edges"]).alias("e")).select("composition", F.array_join("e.sources", " ").alias("source"), F.array_join("e.targets", " ").alias("target")), _WALK + """
SELECT 'order' || o || 'Composition' AS composition, 'call' || o || '_' || n || '.part' || p || 'Output' AS source, 'call' || o || '_' || (n + 1) || '.part' || nxt || 'Parameter0' AS target FROM calls WHERE nxt IS NOT NULL""")
_q("v05_elk_ports", lambda s, d: visual.elk(FlowGraph(calls_graph(s, d).triples)).select(F.explode(F.from_json("json", "children array<struct<id:string,ports:array<struct<id:string,properties:struct<port_side:string>>>>>")["children"]).alias("c")).select(F.col("c.id").alias("call"), F.explode("c.ports").alias("port")).select("call", F.col("port.id").alias("port"), F.col("port.properties.port_side").alias("side")), _WALK + """
SELECT 'call' || o || '_' || n AS call, 'call' || o || '_' || n || '.part' || p || 'Output' AS port, 'EAST' AS side FROM calls WHERE nxt IS NOT NULL
UNION SELECT 'call' || o || '_' || (n + 1), 'call' || o || '_' || (n + 1) || '.part' || nxt || 'Parameter0', 'WEST' FROM calls WHERE nxt IS NOT NULL""")
_q("v07_dot", lambda s, d: visual.dot(FlowGraph(calls_graph(s, d).triples)).select(t.local_name(F.col("composition")).alias("composition"), F.explode(F.split("dot", "\n")).alias("line")), _WALK + """
SELECT 'order' || o || 'Composition' AS composition, '  "call' || o || '_' || n || '" -> "call' || o || '_' || (n + 1) || '" [label="' || CASE flag WHEN 'N' THEN 'next' WHEN 'R' THEN 'iterate' ELSE 'true' END || '"];' AS line FROM calls WHERE nxt IS NOT NULL
UNION ALL SELECT 'order' || o || 'Composition', unnest(['digraph {', '}']) FROM calls WHERE nxt IS NOT NULL AND n = 1""")


def _elk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout objects as files of JSON lines, read again."""
    path = _folder(spark, "elk")
    visual.write_elk(FlowGraph(calls_graph(spark, sf_dir).triples), path)
    back = spark.read.schema(f"id string, edges {_EDGE}").json(path)
    return back.select(F.col("id").alias("composition"), F.explode("edges").alias("e")).select("composition", F.array_join("e.sources", " ").alias("source"), F.array_join("e.targets", " ").alias("target"))


_q("src11_elk_files", _elk_files, ORACLE_SQL["v05_elk"])
_q("j09_percolated", lambda s, d: local(_percolated(FlowGraph(calls_graph(s, d).triples))), _WALK + """,
named AS (SELECT o, n, nxt, CASE WHEN r > 1 THEN 'part' || p || '_' || r ELSE 'part' || p END AS node FROM (SELECT *, row_number() OVER (PARTITION BY o, p ORDER BY 'call' || o || '_' || n) r FROM calls))
SELECT 'order' || a.o || 'Composition' AS composition, 'call' || a.o || '_' || a.n AS source, a.node AS source_node, 'call' || b.o || '_' || b.n AS target, b.node AS target_node FROM named a JOIN named b ON a.o = b.o AND b.n = a.n + 1""")
_q("a09_layers", lambda s, d: visual.layers(FlowGraph(calls_graph(s, d).triples)), "SELECT count(DISTINCT l_orderkey) + 1 AS layers FROM lineitem")

# described programs

_fixed("src06_described_shape", lambda s, d: describe.describe(TRIPLE_SUM, "demo").graph(s).triples.groupBy("p").agg(F.count("*").alias("n")).select(t.local_name(F.col("p")).alias("p"), "n").where("p in ('applies', 'mapTo', 'composedOf', 'start', 'represents', 'next', 'required')"), "SELECT p, CAST(n AS BIGINT) AS n FROM (VALUES ('applies', 3), ('mapTo', 8), ('composedOf', 8), ('start', 2), ('represents', 2), ('next', 1), ('required', 5)) v(p, n)")
_SUM = "def simple_sum(a: int, b: int = 2):\n    return a + b\n"
_KINDS = "def f(a, b=2, *rest, c=3, **named):\n    return a\n"


def _built(name: str, make: Callable[[FlowGraph], DataFrame], rows: str, columns: str, source: str = _SUM) -> None:
    """Rows of a described program, without the hashes that end minted names, against the rows spelt out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = local(make(FlowGraph(describe.describe(source, "demo").graph(spark).triples)))
        return out.select(*[F.regexp_replace(c, "[0-9a-f]{8}$", "").alias(c) if kind == "string" else F.col(c) for c, kind in out.dtypes])

    _fixed(name, run, f"SELECT * FROM (VALUES {rows}) v({columns})")


def _of(*predicates: str, kinds: tuple[str, ...] = ()) -> Callable[[FlowGraph], DataFrame]:
    """(s, p, o) of the predicates, of subjects of the types if there are any."""

    def make(g: FlowGraph) -> DataFrame:
        rows = g.triples.where(F.col("p").isin([t.expand(p) for p in predicates]))
        return (rows.join(g.of_type(*kinds), rows["s"] == F.col("term"), "left_semi") if kinds else rows).select("s", "p", "o")

    return make


_built("b01_apply", _of("fnoc:applies"), "('op_add_1', 'applies', 'op_add')", "s, p, o")
_built("b03_start", _of("fnoc:start"), "('simple_sumComposition', 'start', 'op_add_1')", "s, p, o")
_ENDS = [("?edge", "fnoc:mapFrom", "?a"), ("?a", "fnoc:constituentFunction", "?source"), ("?a", ("fnoc:functionOutput", "fnoc:functionParameter"), "?port"), ("?edge", "fnoc:mapTo", "?b"), ("?b", "fnoc:constituentFunction", "?target"), ("?b", ("fnoc:functionParameter", "fnoc:functionOutput"), "?place")]
_built(
    "b04_composition", lambda g: g.match([("?composition", "fnoc:represents", "?f"), ("?composition", "fnoc:composedOf", "?edge"), *_ENDS], "?composition", "?f", "?source", "?port", "?target", "?place"),
    "('simple_sumComposition', 'simple_sum', 'simple_sum', 'simple_sumParameter0', 'op_add_1', 'op_addParameter0'), ('simple_sumComposition', 'simple_sum', 'simple_sum', 'simple_sumParameter1', 'op_add_1', 'op_addParameter1'), ('simple_sumComposition', 'simple_sum', 'op_add_1', 'op_addOutput', 'simple_sum', 'simple_sumOutput')",
    "composition, f, source, port, target, place",
)
_built(
    "b05_function", lambda g: g.match([("?f", "a", "?type"), ("?f", "rdfs:label", "?label"), ("?f", ("fno:expects", "fno:returns"), "?list"), ("?list", ("rdf:_1", "rdf:_2"), "?terminal")], "?f", "?type", "?label", "?list", "?terminal"),
    ", ".join(f"('{f}', '{kind}', '{label}', '_:{f}{of}', '{f}{term}')" for f, label in (("simple_sum", "simple_sum"), ("op_add", "add")) for kind in ("Function", "Entity") for of, term in (("expects", "Parameter0"), ("expects", "Parameter1"), ("returns", "Output"))),
    "f, type, label, list, terminal",
)
_built(
    "b06_terminals", _of("a", "fno:predicate", "fno:required", "fno:type", kinds=("fno:Parameter", "fno:Output")),
    "('simple_sumParameter0', 'type', 'Parameter'), ('simple_sumParameter0', 'predicate', 'a'), ('simple_sumParameter0', 'required', 'true'), ('simple_sumParameter0', 'type', 'int'), ('simple_sumParameter1', 'type', 'Parameter'), ('simple_sumParameter1', 'predicate', 'b'), ('simple_sumParameter1', 'required', 'false'), ('simple_sumParameter1', 'type', 'int'), ('simple_sumOutput', 'type', 'Output'), ('simple_sumOutput', 'predicate', 'simple_sumResult'), ('op_addParameter0', 'type', 'Parameter'), ('op_addParameter0', 'predicate', 'p0'), ('op_addParameter1', 'type', 'Parameter'), ('op_addParameter1', 'predicate', 'p1'), ('op_addOutput', 'type', 'Output'), ('op_addOutput', 'predicate', 'op_addResult')",
    "s, p, o",
)
_built("b07_implementation", _of("a", "doap:name", kinds=("fnoi:Implementation",)), ", ".join(f"('{f}', '{p}', '{o}')" for f in ("simple_sum", "op_add") for p, o in (("type", "Implementation"), ("type", "PythonFunction"), ("name", f))), "s, p, o")
_built("b09_implementation_link", lambda g: g.implemented(), "('simple_sum', 'simple_sumMapping', 'simple_sum'), ('op_add', 'op_addMapping', 'op_add')", "f, mapping, implementation")
_built("b11_python_objects", lambda g: g.python_objects().select("implementation", "kind", "name", "module"), "('simple_sum', 'PythonFunction', 'simple_sum', 'demo'), ('op_add', 'PythonFunction', 'op_add', '_operator')", "implementation, kind, name, module")
_built(
    "b08_mapping_kinds",
    lambda g: g.match([("?mapping", "fno:parameterMapping", "?node"), ("?node", "a", "?kind"), ("?node", "fnom:functionParameter", "?term"), ("?term", "fno:predicate", "?name")], "?mapping", "?kind", "?name"),
    "('fMapping', 'PositionParameterMapping', 'a'), ('fMapping', 'PropertyParameterMapping', 'a'), ('fMapping', 'PositionParameterMapping', 'b'), ('fMapping', 'PropertyParameterMapping', 'b'), ('fMapping', 'DefaultParameterMapping', 'b'), ('fMapping', 'VarPositionalParameterMapping', 'rest'), ('fMapping', 'PropertyParameterMapping', 'c'), ('fMapping', 'DefaultParameterMapping', 'c'), ('fMapping', 'VarPropertyParameterMapping', 'named')",
    "mapping, kind, name", _KINDS,
)
_built("b18_signature_values", lambda g: g.match([("?node", ("fnom:implementationParameterPosition", "fnom:implementationProperty", "fnom:defaultValue"), "?value"), ("?node", "fnom:functionParameter", "?term"), ("?term", "fno:predicate", "?name")], "?name", "?value"), "('a', '0'), ('a', 'a'), ('b', '1'), ('b', 'b'), ('b', '2'), ('c', 'c'), ('c', '3')", "name, value", _KINDS)
_fixed("src06_flow", lambda s, d: local(FlowGraph(describe.describe("def n_sum(n: int):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n").graph(s).triples).depends()).select("call", "on"), "SELECT * FROM (VALUES ('range_1', 'n_sum'), ('iter_1', 'range_1'), ('next_1', 'iter_1'), ('op_add_1', 'next_1'), ('op_add_1', 'op_add_1'), ('n_sum', 'op_add_1')) v(call, \"on\")")
_fixed("f04_control", lambda s, d: local(FlowGraph(describe.describe("def n_sum(n: int):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n").graph(s).triples).order().select("call", "next", "iterate")), "SELECT * FROM (VALUES ('range_1', 'iter_1', NULL), ('iter_1', 'next_1', NULL), ('next_1', NULL, 'op_add_1'), ('op_add_1', 'next_1', NULL)) v(call, \"next\", iterate)")


def _turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as N-Triples and read again."""
    from loomflow.operators.graph import direct

    folder = _folder(spark, "graph")
    turtle.write(direct(table(spark, sf_dir, "nation"), "nation", "n_nationkey"), folder)
    return local(turtle.read(spark, folder).triples.select("s", "p", "o"))


_q("src08_turtle_round_trip", _turtle, """
SELECT 'nation/' || n_nationkey AS s, 'n_nationkey' AS p, n_nationkey::VARCHAR AS o FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'n_name', n_name FROM nation
UNION ALL SELECT 'nation/' || n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation""")
_fixed("b17_literals", lambda s, d: Graph.of(s, [("ex:a", "ex:p", Lit(v)) for v in (1, 2.5, True, "x")]).triples.select("o", t.local_name(F.col("o_dt")).alias("dt")), "SELECT * FROM (VALUES ('1', 'integer'), ('2.5', 'double'), ('true', 'boolean'), ('x', NULL)) v(o, dt)")
_q("b15_curies", lambda s, d: table(s, d, "region").select(F.explode(F.array(F.concat(F.lit("fno:"), "r_name"), F.lit("a"), F.lit("x:y"))).alias("c")).distinct().select("c", t.expanded(F.col("c")).alias("uri")), "SELECT 'fno:' || r_name AS c, 'https://w3id.org/function/ontology#' || r_name AS uri FROM region UNION ALL SELECT 'a', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' UNION ALL SELECT 'x:y', 'x:y'")



def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A described function run by the first backend that can."""
    from loomflow.plans.execute import execute

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    graph = FlowGraph(describe.describe(TRIPLE_SUM, "demo").graph(spark).triples)
    return execute(rows, graph, "triple_sum", TRIPLE_SUM, ["l_partkey", "l_suppkey", "l_orderkey"], "out")[0].select("l_orderkey", "l_linenumber", "out")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled library function, described by its number of arguments, read back from Turtle and run without its source."""
    import math

    from loomflow.plans.execute import execute

    folder = _folder(spark, "library")
    turtle.write(describe.describe_callable(math.gcd, 2).graph(spark), folder)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return execute(rows, FlowGraph(turtle.read(spark, folder).triples), "gcd", "", ["l_partkey", "l_suppkey"], "out", "bigint")[0].select("l_orderkey", "l_linenumber", "out")


_q("f17_library", _library, "SELECT l_orderkey, l_linenumber, CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS out FROM lineitem")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live objects of every kind as rows of implementations."""
    import math

    out = None
    for f, n in ((math.gcd, 2), (str.upper, 1), (dict, 1)):
        graph = describe.describe_callable(f, n).graph(spark)
        out = graph if out is None else out | graph
    return local(FlowGraph(out.triples).python_objects().select("kind", "name", "module", F.regexp_replace("method_of", "[0-9a-f]{8}$", "").alias("method_of")))


_fixed("b16_live_objects", _objects, "SELECT * FROM (VALUES ('PythonFunction', 'gcd', 'math', NULL), ('PythonMethod', 'upper', 'builtins', 'str'), ('PythonClass', 'dict', 'builtins', NULL)) v(kind, name, module, method_of)")
_fixed("b19_by_count", lambda s, d: local(FlowGraph(describe.describe_callable(max, 3).graph(s).triples).positions()), "SELECT 'max' AS f, 'maxParameter' || i AS parameter, CAST(i AS INT) AS position FROM range(3) t(i)")


def _sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A described function called from SQL text, inlined by the analyzer."""
    from loomflow.plans import sqlfunction

    graph = describe.describe(TRIPLE_SUM, names=["triple_sum"]).graph(spark)
    sqlfunction.create(spark, graph, "triple_sum", {"a": "bigint", "b": "bigint", "c": "bigint"})
    price = "def price(x, d, q):\n    if d > 0.05:\n        return x * (1 - d)\n    return x + q // 10\n"
    sqlfunction.create(spark, price, "price", {"x": "double", "d": "double", "q": "bigint"}, "line_price")
    lines = table(spark, sf_dir, "lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, triple_sum(l_partkey, l_suppkey, l_orderkey) AS total, round(line_price(l_extendedprice, l_discount, CAST(l_quantity AS BIGINT)), 4) AS price FROM {lines} WHERE triple_sum(l_partkey, 1, 1) % 2 = 0", lines=lines)


def _own_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A described function run by a backend that a caller has put first."""
    from loomflow.plans.execute import BACKENDS, execute
    from loomflow.plans.sqlfunction import SqlBackend

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    graph = FlowGraph(describe.describe(TRIPLE_SUM, "demo").graph(spark).triples)
    out, chosen = execute(rows, graph, "simple_sum", TRIPLE_SUM, ["l_partkey", "l_suppkey"], "out", backends=[SqlBackend(), *BACKENDS])
    return out.select("l_orderkey", "l_linenumber", "out", F.lit(chosen["backend"]).alias("backend"))




def _own_describer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables described by a describer that a caller has added: a resource that the others do not know."""
    from loomflow.operators.graph import direct
    from loomflow.plans.execute import DESCRIBERS, describe as described

    def make(spark: SparkSession, resource: tuple[str, str]) -> Graph:
        return direct(table(spark, sf_dir, resource[0]), *resource)

    own = (lambda resource: isinstance(resource, tuple), make)
    DESCRIBERS.insert(0, own)
    try:
        rows = (described(spark, ("nation", "n_nationkey")) | described(spark, ("customer", "c_custkey"))).triples.where(F.rlike("p", F.lit("name$")))
        return rows.select(t.local_name(F.col("s")).alias("s"), t.local_name(F.col("p")).alias("p"), "o")
    finally:
        DESCRIBERS.remove(own)


_q("p04_own_describer", _own_describer, "SELECT 'nation/' || n_nationkey AS s, 'n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'c_name', c_name FROM customer")
_q("p03_sql_function", _sql_function, """
SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey + l_orderkey AS total, round(CASE WHEN l_discount > 0.05 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice + CAST(l_quantity AS BIGINT) // 10 END, 4) AS price FROM lineitem WHERE (l_partkey + 2) % 2 = 0""")
_q("p03_own_backend", _own_backend, "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS out, 'SqlBackend' AS backend FROM lineitem")
_q("f16_execute", _executed, "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey + l_orderkey AS out FROM lineitem")
_fixed("src09_standard_library", lambda s, d: local(FlowGraph(standard.library(s).triples).functions()), "SELECT unnest(['Is', 'IsNot', 'for', 'if', 'ifexpr', 'slice', 'list', 'tuple', 'dict', 'attribute', 'joinstr', 'format', 'build', 'from', 'entrypoint', 'user', 'add', 'label', 'workdir', 'arg', 'cmd', 'run', 'env', 'port', 'volume', 'copy', 'maintainer', 'expose']) AS f")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read again by a schema."""
    path = _folder(spark, "csv")
    readers.write_csv(table(spark, sf_dir, "supplier"), path)
    return readers.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", ["key", "name", "nation", "balance"], header=True)


def _arrow(spark: SparkSession, sf_dir: str) -> str:
    """The events as Arrow files, written by tasks."""
    path = _folder(spark, "arrow")
    arrow.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return path


_EVENT = "event_id bigint, event_type string, value double"
_q("src14_arrow", lambda s, d: arrow.read(s, _arrow(s, d), _EVENT), "SELECT event_id, event_type, value FROM events")
_q("src14_arrow_stream", lambda s, d: windows.to_table(arrow.stream(s, _arrow(s, d), _EVENT), _folder(s, "arrow"), _folder(s, "checkpoint")), "SELECT event_id, event_type, value FROM events")


def _orders_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' triples as text and back, in tasks by ranges of the files."""
    from loomflow.operators.graph import direct

    folder = _folder(spark, "orders")
    turtle.write(direct(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders", "o_orderkey"), folder)
    return local(turtle.read(spark, folder).triples.select("s", "p", "o"))


_q("src08_orders", _orders_turtle, " UNION ALL ".join(f"SELECT 'orders/' || o_orderkey AS s, '{c}' AS p, {c}::VARCHAR AS o FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part, in a package for each brand; what a part does not define it takes from the next part, under another name."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), brand.alias("brand"), "p_size")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("brand").alias("then"), F.col("k").alias("m"))
    own = F.concat(F.lit("def make"), "k", F.lit("(x):\n    return x\n"))
    taken = F.concat(F.lit("from .."), F.coalesce("then", F.lit("gone")), F.lit(".m"), F.coalesce("m", F.lit("0")), F.lit(" import make"), F.coalesce("m", F.lit("0")), F.lit(" as make"), "k", F.lit("\n"))
    star = F.concat(F.lit("from .m"), "k", F.lit(" import *\n"))
    rows = parts.join(after, "p_partkey", "left").select("brand", "k", F.when(F.col("p_size") % 3 == 0, own).otherwise(taken).alias("text"), star.alias("star"))
    path = F.concat(F.lit("/src/parts/"), "brand", F.lit("/"))
    return rows.select(F.concat(path, F.lit("m"), "k", F.lit(".py")).alias("path"), "text").union(rows.select(F.concat(path, F.lit("all"), "k", F.lit(".py")), "star"))


_q("p05_imports", lambda s, d: imports.resolved(_modules(s, d), "/src").select("module", "name", "kind", F.when(F.col("kind") == "def", F.concat_ws(".", "target", "attribute")).alias("of"), "file"), """
WITH RECURSIVE p AS (SELECT p_partkey AS k, 'parts.' || lower(replace(p_brand, '#', '_')) AS brand, p_size % 3 = 0 AS own FROM part),
r AS (SELECT k, k AS pos, own FROM p UNION ALL SELECT r.k, p.k, p.own FROM r JOIN p ON p.k = r.pos + 1 WHERE NOT r.own),
ends AS (SELECT k, max(pos) AS pos, bool_or(own) AS found FROM r GROUP BY k),
told AS (SELECT ends.k, p.brand, CASE WHEN found THEN 'def' ELSE 'outside' END AS kind, CASE WHEN found THEN q.brand || '.m' || q.k || '.make' || q.k END AS "of", CASE WHEN found THEN '/src/' || replace(q.brand, '.', '/') || '/m' || q.k || '.py' END AS file
    FROM ends JOIN p ON p.k = ends.k JOIN p q ON q.k = ends.pos)
SELECT brand || '.m' || k AS module, 'make' || k AS name, kind, "of", file FROM told UNION ALL SELECT brand || '.all' || k, 'make' || k, kind, "of", file FROM told""")

_q("src13_csv", _csv, "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")



def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of programs and a build file, described in parallel."""
    path = _folder(spark, "tree")
    texts = [("a/n_sum.py", "def n_sum(n):\n    t = 0\n    for i in range(n):\n        t += i\n    return t\n"), ("b/triple.py", TRIPLE_SUM), ("b/Dockerfile", "FROM x\nRUN y\n"), ("bad.py", "def (:\n")]
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, text in texts:
        to = hadoop.Path(f"{path}/{name}")
        out = to.getFileSystem(conf).create(to)
        out.write(bytearray(text.encode()))
        out.close()
    rows = describe.describe_tree(spark, path)
    return rows.where(F.col("p").isin(t.expand("fnoc:applies"), "error")).groupBy(t.base_name(F.col("file")).alias("file"), t.local_name(F.col("p")).alias("p")).agg(F.count("*").alias("n"))


_fixed("src03_folder", _tree, "SELECT file, p, CAST(n AS BIGINT) AS n FROM (VALUES ('n_sum.py', 'applies', 4), ('triple.py', 'applies', 3), ('Dockerfile', 'applies', 2), ('bad.py', 'error', 1)) v(file, p, n)")


def _own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python callable as an aggregate, on the values of each group as one Arrow array."""
    spread = frames.aggregate_of(lambda values: float(max(values) - min(values)), "double")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(spread("l_quantity").alias("spread"))


_q("p02_own_aggregate", _own_aggregate, "SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1")

# streams


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{name}{os.urandom(6).hex()}"


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    schema = table(spark, sf_dir, "events").schema
    base = _folder(spark, "stream")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), base + "/checkpoint"


def _t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, checkpoint = _stream(spark, sf_dir)
    out = windows.time_windows(stream, ["event_type"], "ts", "1 day", None, "1 hour", n=F.count("*"))
    return windows.to_end(out, checkpoint, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, checkpoint = _stream(spark, sf_dir)
    parts = windows.to_end(windows.chunks(stream, ["event_type"], "ts", "30 minutes", "1 hour"), checkpoint, "complete")
    return series.sessions(parts, ["event_type"], "30 minutes").groupBy("event_type").agg(F.count("*").alias("chunks"), F.sum("n").alias("n"))



def _t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of a stream by itself: its rows by kind, summed at the end."""
    stream, checkpoint = _stream(spark, sf_dir)
    path = _folder(spark, "batches")
    windows.each_batch(stream, lambda batch, n: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


def _t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one state for each user, carried between batches; what is still open is not told."""
    stream, checkpoint = _stream(spark, sf_dir)
    with windows.rocks_db(spark):
        out = windows.to_end(windows.state_intervals(stream, "user_id", "ts", "event_type"), checkpoint)
    return out.groupBy("key").agg(F.count("*").alias("intervals"), F.sum("n").alias("rows"))



def _t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come in eight files, every tenth two files late, by day: what is too late for the watermark of an hour is dropped."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    low, high = events.agg(F.min(us), F.max(us)).first()
    dealt = events.withColumn("file", F.expr(f"int((unix_micros(ts) - {low or 0}) * 6 div ({high or 0} - {low or 0} + 1))") + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0))
    path = _folder(spark, "late")
    for n in range(8):  # one write after another: streams read files by the time they were written
        dealt.where(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(path)
    stream = windows.source(spark, path, "event_id bigint, ts timestamp")
    out, dropped = windows.to_table_counted(windows.time_windows(stream, [], "ts", "1 day", None, "1 hour", n=F.count("*")), _folder(spark, "late-result"), _folder(spark, "checkpoint"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.lit(dropped > 0).alias("some_dropped"))


#: A row is late by the watermark that the batch before had, which knows the rows of those before it.
_q("t05_late_rows", _t05, """
WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us FROM events), w AS (SELECT min(us) AS low, max(us) AS high FROM e),
dealt AS (SELECT ts, date_trunc('day', ts)::TIMESTAMP AS start, CAST((us - low) * 6 // (high - low + 1) AS INT) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS file FROM e, w),
marks AS (SELECT file, max(max(ts)) OVER (ORDER BY file RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 HOUR AS mark FROM dealt GROUP BY file),
kept AS (SELECT start, mark IS NULL OR start + INTERVAL 1 DAY > date_trunc('milliseconds', mark) AS kept FROM dealt JOIN marks USING (file))
SELECT start, count(*) FILTER (kept) AS n, (SELECT count(*) FILTER (NOT kept) > 0 FROM kept) AS some_dropped FROM kept
WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY start HAVING count(*) FILTER (kept) > 0""")
_q("t01_batches", _t01, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
_q("t04_stream_intervals", _t04, """
WITH c AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) run FROM (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 1) ch FROM events)),
g AS (SELECT user_id, run, count(*) n, lead(run) OVER (PARTITION BY user_id ORDER BY run) later FROM c GROUP BY 1, 2)
SELECT user_id AS key, count(*) AS intervals, CAST(sum(n) AS BIGINT) AS rows FROM g WHERE later IS NOT NULL GROUP BY 1""")
_q("t02_stream_windows", _t02, "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2")
_q("t03_stream_sessions", _t03, """
SELECT event_type, count(*) FILTER (new = 1) AS chunks, count(*) AS n FROM (SELECT event_type, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END new FROM events) GROUP BY 1""")

# learners

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): lines with the label dear where their price a piece, less the discount, is over 1,000; no feature tells it alone."""
    dear = F.col("l_extendedprice") * (1 - F.col("l_discount")) > F.col("l_quantity") * 1000
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, F.when(dear, "dear").otherwise("cheap").alias("label"))
    return li.where("l_orderkey % 10 >= 3"), li.where("l_orderkey % 10 < 3")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _labelled(spark, sf_dir)
    model = learn.fit(train, "gaussian_nb", _FEATURES, "label")
    return learn.predict(model, test, "predicted").select("l_orderkey", "l_linenumber", "label", "predicted")


_LABELLED = """
li AS (SELECT l_orderkey, l_linenumber, l_quantity q, l_extendedprice x, l_discount d, CASE WHEN l_extendedprice * (1 - l_discount) > l_quantity * 1000 THEN 'dear' ELSE 'cheap' END AS label FROM lineitem),
train AS (SELECT * FROM li WHERE l_orderkey % 10 >= 3), test AS (SELECT * FROM li WHERE l_orderkey % 10 < 3)"""
#: A normal distribution of each feature for each label; variances have a billionth of the largest one added.
_q("m01_gaussian_nb", _predicted, f"""
WITH {_LABELLED}, whole AS (SELECT count(*) AS n, 1e-9 * greatest(var_pop(q), var_pop(x), var_pop(d)) AS e FROM train),
seen AS (SELECT label, count(*) AS n, avg(q) mq, avg(x) mx, avg(d) md, var_pop(q) + any_value(e) vq, var_pop(x) + any_value(e) vx, var_pop(d) + any_value(e) vd, any_value(whole.n) AS total FROM train, whole GROUP BY label),
scored AS (SELECT test.*, seen.label AS told, ln(n / total) - 0.5 * (ln(vq) + (q - mq) ** 2 / vq + ln(vx) + (x - mx) ** 2 / vx + ln(vd) + (d - md) ** 2 / vd) AS score FROM test, seen)
SELECT l_orderkey, l_linenumber, label, told AS predicted FROM scored QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, q, x, d ORDER BY score DESC) = 1""")


def _learned(learner: str) -> Callable[[SparkSession, str], DataFrame]:
    """Rows that the learner was not shown, and whether it is right on more of them than the more frequent label would be, by a twentieth of all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _labelled(spark, sf_dir)
        out = learn.predict(learn.fit(train, learner, _FEATURES, "label"), test, "predicted")
        right, dear = F.avg((F.col("predicted") == F.col("label")).cast("double")), F.avg((F.col("label") == "dear").cast("double"))
        return out.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "dear").alias("dear"), (right > F.greatest(dear, 1 - dear) + 0.05).alias("better"))

    return run


for _name in learn.LEARNERS:
    if _name not in ("gaussian_nb", "rbf_svc"):
        _q(f"m01_{_name}", _learned(_name), f"WITH {_LABELLED} SELECT count(*) AS n, count(*) FILTER (label = 'dear') AS dear, true AS better FROM test")


def _told_rows(learner: str, label: str, sure: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a learner says of each row that it was not shown and that is not near a border."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.when(F.expr(label), "yes").otherwise("no").alias("label"))
        train = li.where("l_orderkey % 10 >= 3")
        if learner == "network":  # built, written, read again
            from pyspark.ml import PipelineModel

            path = _folder(spark, "network")
            readers.save_model(learn.network(train, ["l_quantity", "l_discount"], "label"), path)
            model = PipelineModel.load(path)
        else:
            model = learn.fit(train, learner, ["l_quantity", "l_discount"], "label")
        out = learn.predict(model, li.where("l_orderkey % 10 < 3").where(sure), "predicted")
        return out.select("l_orderkey", "l_linenumber", "predicted")

    return run


_ONE, _XOR = "l_quantity > 25", "(l_quantity > 25) <> (l_discount > 0.05)"
_FAR = "abs(l_quantity - 25) >= 8 AND abs(l_discount - 0.05) >= 0.03"
for _name, _label in (("random_forest", _XOR), ("linear_svc", _ONE), ("rbf_svc", _XOR), ("network", _XOR)):
    _q(f"{'m02' if _name == 'network' else 'm01'}_{_name}_rows", _told_rows(_name, _label, _FAR), f"SELECT l_orderkey, l_linenumber, CASE WHEN {_label} THEN 'yes' ELSE 'no' END AS predicted FROM lineitem WHERE l_orderkey % 10 < 3 AND {_FAR}")


def _saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive Bayes model written to the shared folder and read again."""
    from pyspark.ml import PipelineModel

    train, test = _labelled(spark, sf_dir)
    path = _folder(spark, "model")
    readers.save_model(learn.fit(train, "gaussian_nb", _FEATURES, "label"), path)
    return learn.predict(PipelineModel.load(path), test, "predicted").select("l_orderkey", "l_linenumber", "label", "predicted")


_q("src16_saved_model", _saved_model, ORACLE_SQL["m01_gaussian_nb"])
