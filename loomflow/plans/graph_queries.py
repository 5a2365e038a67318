"""Queries of the accessors and of the pattern compiler, with SQL over the tables that the graphs are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions import terms as t
from loomflow.operators import frames
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Graph, Group, direct
from loomflow.session import table
from loomflow.sources.flowtables import calls_graph, compositions_graph, functions_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CTES = {
    "funs": "funs AS (SELECT p_partkey k, p_size z, p_size % 3 AS last, replace(p_brand, '#', '_') brand, p_name, p_retailprice FROM part)",
    "params": "params AS (SELECT *, unnest(range(0, last + 1)) AS i FROM funs)",
    "brands": "brands AS (SELECT DISTINCT brand, CASE (length(brand) + ascii(right(brand, 1))) % 4 WHEN 0 THEN 'PythonFunction' WHEN 1 THEN 'PythonMethod' WHEN 2 THEN 'PythonClass' ELSE 'PythonFile' END kind FROM funs)",
    "calls": "calls AS (SELECT l_orderkey o, row_number() OVER w n, l_partkey p, lead(l_partkey) OVER w nxt, l_quantity q, l_returnflag flag, l_linestatus st FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))",
}


def local(df: DataFrame) -> DataFrame:
    """Local names instead of URIs."""
    return df.select(*[t.local_name(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def _add(name: str, make: Callable, graph: Callable, ctes: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = graph(spark, sf_dir)
        return local(make(FlowGraph(found.triples, found.wide)))

    QUERIES[name] = run
    head = ", ".join(_CTES[c] for c in ctes.split())
    ORACLE_SQL[name] = f"WITH {head} {sql}" if head else sql


def _functions(spark: SparkSession, sf_dir: str) -> Graph:
    return functions_graph(spark, sf_dir)


def _calls(spark: SparkSession, sf_dir: str) -> Graph:
    return calls_graph(spark, sf_dir)


def _compositions(spark: SparkSession, sf_dir: str) -> Graph:
    return compositions_graph(spark, sf_dir)


def _o(name: str, make: Callable, ctes: str, sql: str) -> None:
    _add(name, make, _compositions, ctes, sql)


def _f(name: str, make: Callable, ctes: str, sql: str) -> None:
    _add(name, make, _functions, ctes, sql)


def _c(name: str, make: Callable, ctes: str, sql: str) -> None:
    _add(name, make, _calls, ctes, sql)


def _both(spark: SparkSession, sf_dir: str) -> Graph:
    return _functions(spark, sf_dir) | _compositions(spark, sf_dir)


PART = "'part' || k"
PARAM = "'part' || k || 'Parameter' || i"

_f("q01_exists", lambda g: g.found("ex:part1", "ex:part1Parameter0", "ex:nothing", "fno:expects"), "", "SELECT * FROM (VALUES ('part1', true), ('part1Parameter0', true), ('nothing', false), ('expects', true)) v(term, found)")
_f("q02_types", lambda g: g.types().where(t.local_name(F.col("type")).isin("Function", "Parameter", "Output", "Mapping")), "funs params", f"""
SELECT {PART} AS term, 'Function' AS type FROM funs UNION ALL SELECT {PARAM}, 'Parameter' FROM params
UNION ALL SELECT 'part' || k || 'Self', 'Parameter' FROM funs WHERE z % 5 = 0 UNION ALL SELECT 'part' || k || 'Output', 'Output' FROM funs
UNION ALL SELECT 'part' || k || 'SelfOutput', 'Output' FROM funs WHERE z % 7 = 0 UNION ALL SELECT 'part' || k || 'Mapping', 'Mapping' FROM funs""")
_f("q03_functions", lambda g: g.functions(), "funs", f"SELECT {PART} AS f FROM funs")
_c("q04_check_call", lambda g: g.applied(g.match([("?term", ("fnoc:applies", "fnoc:represents"), "?x")], "?term")), "calls", "SELECT 'call' || o || '_' || n AS term, 'part' || p AS f FROM calls UNION ALL SELECT 'order' || o_orderkey || 'Composition', 'order' || o_orderkey || 'Composition' FROM orders")
_c("q05_order", lambda g: g.order(), "calls", """
SELECT 'call' || o || '_' || n AS call, CASE WHEN flag = 'N' THEN 'call' || o || '_' || (n + 1) END AS "next", CASE WHEN flag = 'R' THEN 'call' || o || '_' || (n + 1) END AS iterate,
CASE WHEN flag = 'A' THEN 'call' || o || '_' || (n + 1) END AS "true", CAST(NULL AS VARCHAR) AS "false" FROM calls WHERE nxt IS NOT NULL""")
_f("q06_get_name", lambda g: g.labels(), "funs", f"SELECT {PART} AS term, p_name AS label FROM funs")
_f("q07_is_kind", lambda g: g.of_type("fno:Function").withColumn("kind", F.lit("function")).union(g.of_type("fno:Parameter").withColumn("kind", F.lit("parameter"))).union(g.of_type("fno:Output").withColumn("kind", F.lit("output"))).groupBy("kind").agg(F.count("*").alias("n")), "funs params", """
SELECT 'function' AS kind, count(*) AS n FROM funs UNION ALL SELECT 'parameter', (SELECT count(*) FROM params) + count(*) FROM funs WHERE z % 5 = 0
UNION ALL SELECT 'output', (SELECT count(*) FROM funs) + count(*) FROM funs WHERE z % 7 = 0""")
QUERIES["q08_has_function"] = lambda spark, sf_dir: local(table(spark, sf_dir, "customer").select(F.concat(F.lit(t.expand("ex:part")), (F.col("c_custkey") * 2).cast("string")).alias("f")).join(FlowGraph(_functions(spark, sf_dir).triples, True).functions().hint("merge"), "f", "left_semi"))
ORACLE_SQL["q08_has_function"] = "SELECT 'part' || (c_custkey * 2) AS f FROM customer WHERE c_custkey * 2 IN (SELECT p_partkey FROM part)"
_f("q09_get_function", lambda g: g.functions_named("part7"), "funs", f"SELECT {PART} AS f FROM funs WHERE k = 7")
_f("q10_get_parameters", lambda g: g.parameters().select("f", F.col("n").cast("long").alias("n"), "parameter"), "funs params", f"SELECT {PART} AS f, CAST(i AS BIGINT) AS n, {PARAM} AS parameter FROM params")
_f("q11_get_parameter_at", lambda g: g.parameter_at().where("position = 1"), "funs params", f"SELECT {PART} AS f, CAST(i AS INTEGER) AS position, {PARAM} AS parameter FROM params WHERE i = 1")
_f("q12_get_parameter_index", lambda g: g.positions(), "funs params", f"SELECT {PART} AS f, {PARAM} AS parameter, CAST(i AS INTEGER) AS position FROM params")
_f("q13_get_param_predicates", lambda g: g.parameters().select("f", "parameter", "predicate"), "funs params", f"SELECT {PART} AS f, {PARAM} AS parameter, 'p' || i AS predicate FROM params")
_f("q14_get_predicate", lambda g: g.predicates(), "funs params", f"""
SELECT {PARAM} AS term, 'p' || i AS predicate FROM params UNION ALL SELECT 'part' || k || 'Self', 'self' FROM funs WHERE z % 5 = 0
UNION ALL SELECT 'part' || k || 'Output', 'result' FROM funs UNION ALL SELECT 'part' || k || 'SelfOutput', 'self_output' FROM funs WHERE z % 7 = 0""")
_f("q15_get_predicate_param", lambda g: g.parameters().where(t.local_name(F.col("predicate")) == "p2").select("f", "parameter"), "funs params", f"SELECT {PART} AS f, {PARAM} AS parameter FROM params WHERE i = 2")
_f("q16_get_param_type", lambda g: g.terminal_types("fno:Parameter"), "funs params", f"SELECT {PARAM} AS term, CASE WHEN i = 0 THEN brand ELSE 'Any41485baa' END AS type FROM params UNION ALL SELECT 'part' || k || 'Self', 'Any41485baa' FROM funs WHERE z % 5 = 0")
_f("q17_get_self", lambda g: g.self_parameters(), "funs", f"SELECT {PART} AS f, 'part' || k || 'Self' AS parameter FROM funs WHERE z % 5 = 0")
_f("q18_get_output", lambda g: g.outputs().select("f", "output"), "funs", f"SELECT {PART} AS f, 'part' || k || 'Output' AS output FROM funs")
_f("q19_get_self_output", lambda g: g.self_outputs(), "funs", f"SELECT {PART} AS f, 'part' || k || 'SelfOutput' AS output FROM funs WHERE z % 7 = 0")
_f("q20_get_output_predicate", lambda g: g.outputs(), "funs", f"SELECT {PART} AS f, 'part' || k || 'Output' AS output, 'result' AS predicate FROM funs")
_f("q21_get_output_type", lambda g: g.terminal_types("fno:Output"), "funs", "SELECT 'part' || k || 'Output' AS term, CASE WHEN z % 2 = 0 THEN brand ELSE 'Any41485baa' END AS type FROM funs UNION ALL SELECT 'part' || k || 'SelfOutput', 'Any41485baa' FROM funs WHERE z % 7 = 0")
_o("q22_get_compositions", lambda g: g.compositions(), "", "SELECT 'order' || o_orderkey || 'Composition' AS composition, 'part' || o_custkey AS f FROM orders")
_o("q23_is_composition", lambda g: g.of_type("fno:Composition").groupBy().agg(F.count("*").alias("n")), "", "SELECT count(*) AS n FROM orders")
_c("q24_get_start", lambda g: g.composed().starts(), "calls", "SELECT 'order' || o || 'Composition' AS composition, 'call' || o || '_1' AS start FROM calls WHERE n = 1")
_c("q24_start_arms", lambda g: frames.cardinality(g.of_type("fno:Composition"), g.match([("?term", "fnoc:start", "?call")]), "term").select("term", "kind"), "", "SELECT 'order' || o_orderkey || 'Composition' AS term, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'one' ELSE 'none' END AS kind FROM orders")
_o("q25_get_representations", lambda g: g.match([("?composition", "fnoc:represents", "?f")], "?f"), "", "SELECT DISTINCT 'part' || o_custkey AS f FROM orders")
_c("q26_get_mappings", lambda g: g.flow(), "calls", """
SELECT 'order' || o || 'Composition' AS composition, CASE WHEN nxt IS NULL THEN CAST(q AS VARCHAR) ELSE '_:from' || o || '_' || n END AS source, '_:to' || o || '_' || n AS target,
CASE WHEN nxt IS NOT NULL AND st = 'O' THEN 'call' || o || '_' || n END AS priority FROM calls""")
_c("q27_is_function_mapping", lambda g: g.match([("?e", "fnoc:constituentFunction", "?c")], "?e").withColumn("kind", F.lit("function")).union(g.terms_mapped().select("edge", F.lit("term"))).groupBy("kind").agg(F.count("*").alias("n")), "calls", "SELECT 'function' AS kind, count(*) + count(nxt) AS n FROM calls UNION ALL SELECT 'term', count(*) FROM calls WHERE nxt IS NULL")
_c("q28_get_function_mapping", lambda g: g.endpoints(), "calls", """
SELECT '_:from' || o || '_' || n AS endpoint, 'call' || o || '_' || n AS call, 'part' || p || 'Output' AS terminal FROM calls WHERE nxt IS NOT NULL
UNION ALL SELECT '_:to' || o || '_' || n, CASE WHEN nxt IS NULL THEN 'call' || o || '_1' ELSE 'call' || o || '_' || (n + 1) END, 'part' || coalesce(nxt, p) || 'Parameter0' FROM calls""")
_c("q29_get_strategy", lambda g: g.strategies(), "calls", "SELECT '_:to' || o || '_' || n AS endpoint, 'toList' AS strategy, CAST(n AS VARCHAR) AS key FROM calls WHERE flag = 'R'")
_f("q30_fun_to_imp", lambda g: g.implemented(), "funs", f"SELECT {PART} AS f, 'part' || k || 'Mapping' AS mapping, brand AS implementation FROM funs")
_f("q31_imp_to_fun", lambda g: g.implemented().where(t.local_name(F.col("implementation")) == "Brand_11").select("mapping", "f"), "funs", f"SELECT 'part' || k || 'Mapping' AS mapping, {PART} AS f FROM funs WHERE brand = 'Brand_11'")
_f("q32_mappings", lambda g: g.implemented().where(t.local_name(F.col("implementation")) == "Brand_12").select("f", "mapping"), "funs", f"SELECT {PART} AS f, 'part' || k || 'Mapping' AS mapping FROM funs WHERE brand = 'Brand_12'")
_f("q33_imp_from_file", lambda g: g.by_file(), "funs", f"SELECT 'file:///src/' || brand || '.py' AS file, {PART} AS f, 'part' || k || 'Mapping' AS mapping, brand AS implementation FROM funs")
_f("q34_get_imp_metadata", lambda g: g.metadata().select("implementation", F.explode("metadata").alias("predicate", "objects")).select("implementation", "predicate", F.concat_ws(",", F.transform("objects", t.local_name)).alias("objects")), "funs brands", """
SELECT brand AS implementation, 'type' AS predicate, 'Implementation,' || kind AS objects FROM brands UNION ALL SELECT brand, 'name', brand FROM brands UNION ALL SELECT brand, 'module', 'm.' || brand FROM brands
UNION ALL SELECT brand, 'file', 'file:///src/' || brand || '.py' FROM brands UNION ALL SELECT brand, 'methodOf', 'Base' FROM brands WHERE kind = 'PythonMethod'""")
_add("q35_represents_python", lambda g: g.represents_python(), _both, "funs", "SELECT 'order' || o_orderkey || 'Composition' AS composition FROM orders JOIN funs ON o_custkey = k")
_f("q36_get_positional", lambda g: g.positional().select("f", F.concat_ws(",", F.transform("parameters", t.local_name)).alias("parameters")), "funs params", f"SELECT {PART} AS f, string_agg({PARAM}, ',' ORDER BY i) AS parameters FROM params GROUP BY k")
_f("q37_get_keyword", lambda g: g.keywords(), "funs params", f"SELECT {PART} AS f, {PARAM} AS parameter, 'p' || i AS property FROM params")
_f("q38_get_varpositional", lambda g: g.var_positional(), "funs", f"SELECT {PART} AS f, 'part' || k || 'Parameter' || last AS parameter FROM funs WHERE z % 11 = 0")
_f("q39_get_varkeyword", lambda g: g.var_keyword(), "funs", f"SELECT {PART} AS f, 'part' || k || 'Parameter' || last AS parameter FROM funs WHERE z % 13 = 0")
_f("q40_get_param_mapping", lambda g: g.parameter_mappings(), "funs params", f"SELECT {PART} AS f, {PARAM} AS parameter, CAST(i AS INTEGER) AS position, 'p' || i AS property FROM params")
_f("q41_get_default_mapping", lambda g: g.defaults().select("f", "parameter", F.round(F.col("value").cast("double"), 4).alias("value")), "funs", f"SELECT {PART} AS f, 'part' || k || 'Parameter' || last AS parameter, round(p_retailprice, 4) AS value FROM funs WHERE z % 2 = 0")
_c("q42_get_used_functions", lambda g: g.used_functions(), "calls", "SELECT DISTINCT 'order' || o || 'Composition' AS composition, 'call' || o || '_' || n AS call FROM calls")
_c("q43_depends_on", lambda g: g.depends(), "calls", "SELECT 'order' || o || 'Composition' AS composition, 'call' || o || '_' || (n + 1) AS call, 'call' || o || '_' || n AS \"on\" FROM calls WHERE nxt IS NOT NULL")
_c("q43_closure", lambda g: g.depends_closure(), "calls", "SELECT 'order' || a.o || 'Composition' AS composition, 'call' || b.o || '_' || b.n AS call, 'call' || a.o || '_' || a.n AS \"on\", CAST(b.n - a.n AS INTEGER) AS steps FROM calls a JOIN calls b ON a.o = b.o AND a.n < b.n")


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a call's value gets to another call, for pairs from lines and orders, which meet the closed order of their first call."""
    call = lambda o, n: F.concat(F.lit(t.expand("ex:call")), F.col(o), F.lit("_"), F.col(n) if isinstance(n, str) else n)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_of_a"), call("l_orderkey", F.lit(1)).alias("a"), call("l_orderkey", "l_linenumber").alias("b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_of_a"), call("o_orderkey", F.lit(2)).alias("a"), F.explode(F.array(call("o_orderkey", F.lit(1)), call("o_orderkey", F.lit(4)), call("o_custkey", F.lit(3)))).alias("b"))
    return local(FlowGraph(_calls(spark, sf_dir).triples).reaches(lines.union(orders)))


QUERIES["q43_reach"] = _reach
ORACLE_SQL["q43_reach"] = f"""
WITH RECURSIVE {_CTES['calls']}, r AS (SELECT o, n AS a, n + 1 AS b FROM calls WHERE nxt IS NOT NULL UNION SELECT r.o, r.a, c.n + 1 FROM r JOIN calls c ON c.o = r.o AND c.n = r.b AND c.nxt IS NOT NULL),
pairs AS (SELECT 'call' || l_orderkey || '_1' AS a, 'call' || l_orderkey || '_' || l_linenumber AS b FROM lineitem UNION SELECT 'call' || o_orderkey || '_2', unnest(['call' || o_orderkey || '_1', 'call' || o_orderkey || '_4', 'call' || o_custkey || '_3']) FROM orders),
told AS (SELECT 'call' || o || '_' || a AS a, 'call' || o || '_' || b AS b, true AS hit FROM r)
SELECT pairs.a, pairs.b, coalesce(hit, false) AS reached FROM pairs LEFT JOIN told USING (a, b)"""
_TOLD = {
    "funs": [
        (PART, "'type'", "'Function'", ""), (PART, "'type'", "'Entity'", ""), (PART, "'label'", "p_name", ""), (PART, "'expects'", "'_:expects' || k", ""), (PART, "'returns'", "'_:returns' || k", ""),
        ("'_:expects' || k", "'type'", "'Seq'", ""), ("'_:returns' || k", "'type'", "'Seq'", ""), ("'_:returns' || k", "'_1'", f"{PART} || 'Output'", ""),
        ("'_:expects' || k", "'_' || (last + 2)", f"{PART} || 'Self'", "z % 5 = 0"), ("'_:returns' || k", "'_2'", f"{PART} || 'SelfOutput'", "z % 7 = 0"),
        (f"{PART} || 'Self'", "'type'", "'Parameter'", "z % 5 = 0"), (f"{PART} || 'Self'", "'predicate'", "'self'", "z % 5 = 0"),
        (f"{PART} || 'Output'", "'type'", "'Output'", ""), (f"{PART} || 'Output'", "'predicate'", "'result'", ""), (f"{PART} || 'Output'", "'type'", "brand", "z % 2 = 0"),
        (f"{PART} || 'SelfOutput'", "'type'", "'Output'", "z % 7 = 0"), (f"{PART} || 'SelfOutput'", "'predicate'", "'self_output'", "z % 7 = 0"),
        (f"{PART} || 'Mapping'", "'type'", "'Mapping'", ""), (f"{PART} || 'Mapping'", "'function'", PART, ""), (f"{PART} || 'Mapping'", "'implementation'", "brand", ""), (f"{PART} || 'Mapping'", "'mappingMethod'", "'default'", ""),
        ("brand", "'type'", "'Implementation'", ""), ("brand", "'name'", "brand", ""), ("brand", "'module'", "'m.' || brand", ""), ("brand", "'file'", "'file:///src/' || brand || '.py'", ""),
        ("'_:def' || k", "'defaultValue'", "CAST(p_retailprice AS VARCHAR)", "z % 2 = 0"),
    ],
    "funs JOIN brands USING (brand)": [("brand", "'type'", "kind", ""), ("brand", "'methodOf'", "'Base'", "kind = 'PythonMethod'")],
    "params": [
        ("'_:expects' || k", "'_' || (i + 1)", PARAM, ""), (PARAM, "'type'", "'Parameter'", ""), (PARAM, "'predicate'", "'p' || i", ""), (PARAM, "'type'", "brand", "i = 0"),
        (PARAM, "'required'", "CASE WHEN i <> last OR z % 2 = 1 THEN 'true' ELSE 'false' END", ""),
        ("'_:pos' || k || '_' || i", "'implementationParameterPosition'", "CAST(i AS VARCHAR)", ""), ("'_:prop' || k || '_' || i", "'implementationProperty'", "'p' || i", ""),
    ],
}
for _node, _kind, _when in (
    ("'_:pos' || k || '_' || i", "PositionParameterMapping", ""), ("'_:prop' || k || '_' || i", "PropertyParameterMapping", ""), ("'_:def' || k", "DefaultParameterMapping", "i = last AND z % 2 = 0"),
    ("'_:args' || k", "VarPositionalParameterMapping", "i = last AND z % 11 = 0"), ("'_:kwargs' || k", "VarPropertyParameterMapping", "i = last AND z % 13 = 0"),
):
    _TOLD["params"] += [(f"{PART} || 'Mapping'", "'parameterMapping'", _node, _when), (_node, "'type'", f"'{_kind}'", _when), (_node, "'functionParameter'", PARAM, _when)]
_f(
    "q44_describe", lambda g: g.description().select("f", "s", "p", "o"), "funs brands params",
    " UNION ALL ".join(f"SELECT {PART} AS f, {s} AS s, {p} AS p, {o} AS o FROM {rows}" + f" WHERE {when}" * bool(when) for rows, told in _TOLD.items() for s, p, o, when in told),
)
_f("q45_is_python", lambda g: g.of_type("fnoi:PythonClass", "fnoi:PythonMethod", "fnoi:PythonFunction", "fnoi:PythonFile"), "funs brands", "SELECT brand AS term FROM brands")
_f("q46_get_file", lambda g: g.files(), "funs brands", "SELECT brand AS term, '/src/' || brand || '.py' AS file FROM brands")
_f("q47_python_object", lambda g: g.python_objects(), "funs brands", """
SELECT brand AS implementation, kind, brand AS name, 'm.' || brand AS module, CAST(NULL AS VARCHAR) AS package, 'file:///src/' || brand || '.py' AS file,
CASE WHEN kind = 'PythonMethod' THEN 'Base' END AS method_of FROM brands""")


def _q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("http://x.org/"), F.col("n_name"), F.lit("#"), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select(t.local_name(uri).alias("name"), t.prefix_of(uri).alias("prefix"), t.to_uri(t.prefix_of(uri), t.local_name(uri)).alias("uri"))


QUERIES["q48_local_name"] = _q48
ORACLE_SQL["q48_local_name"] = "SELECT CAST(n_nationkey AS VARCHAR) AS name, 'http://x.org/' || n_name || '#' AS prefix, 'http://x.org/' || n_name || '#' || n_nationkey AS uri FROM nation"


def _direct(*names: str):
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "part": "p_partkey"}

    def make(spark: SparkSession, sf_dir: str) -> Graph:
        out = None
        for n in names:
            g = direct(table(spark, sf_dir, n), n, keys[n])
            out = g if out is None else out | g
        return out

    return make


def _b(name: str, tables: str, make: Callable, sql: str) -> None:
    build = _direct(*tables.split())
    QUERIES[name] = lambda spark, sf_dir: make(build(spark, sf_dir))
    ORACLE_SQL[name] = sql


_b("bgp_join2", "nation region", lambda g: g.match([("?n", "ex:n_regionkey", "?k"), ("?r", "ex:r_regionkey", "?k"), ("?n", "ex:n_name", "?nation"), ("?r", "ex:r_name", "?region")], "?nation", "?region"), "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_b("bgp_join3", "customer nation region", lambda g: g.match([("?c", "ex:c_nationkey", "?k"), ("?n", "ex:n_nationkey", "?k"), ("?n", "ex:n_regionkey", "?j"), ("?r", "ex:r_regionkey", "?j"), ("?r", "ex:r_name", "?region"), ("?c", "ex:c_mktsegment", "?segment")], "?c", "?region", "?segment", distinct=False).groupBy("region", "segment").agg(F.count("*").alias("n")), "SELECT r_name AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
_b("bgp_join4", "orders customer", lambda g: g.match([("?o", "ex:o_custkey", "?k"), ("?c", "ex:c_custkey", "?k"), ("?c", "ex:c_mktsegment", "?segment"), ("?o", "ex:o_orderpriority", "?priority")], "?o", "?segment", "?priority", distinct=False).groupBy("segment", "priority").agg(F.count("*").alias("n")), "SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
_b("bgp_optional", "customer orders", lambda g: g.match(Group([("?c", "ex:c_custkey", "?k")], optional=[Group([("?o", "ex:o_custkey", "?k"), ("?o", "ex:o_orderkey", "?order")])]), "?k", "?order"), "SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(o_orderkey AS VARCHAR) AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
_b("bgp_alternative", "customer supplier", lambda g: g.match([("?x", ("ex:c_nationkey", "ex:s_nationkey"), "?k")], "?x", "?k").groupBy("k").agg(F.count("*").alias("n")), "SELECT CAST(k AS VARCHAR) AS k, count(*) AS n FROM (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
_b("bgp_values", "orders", lambda g: g.match(Group([("?o", "ex:o_orderstatus", "?status"), ("?o", "ex:o_orderkey", "?k")], values={"?status": ("F", "P")}), "?k", "?status"), "SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P')")
_b("bgp_filter", "customer", lambda g: g.match(Group([("?c", "ex:c_mktsegment", "?segment"), ("?c", "ex:c_name", "?name")], filters=[lambda b: b["segment"] != "BUILDING"]), "?name", "?segment"), "SELECT c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'")
_b("bgp_ask", "nation region", lambda g: g.triples.sparkSession.createDataFrame([(g.ask([("ex:nation/1", "ex:n_name", "?x")]), g.ask([("ex:nation/999", "ex:n_name", "?x")]))], "yes boolean, no boolean"), "SELECT true AS yes, false AS no")
_b("graph_union", "nation", lambda g: Graph((g | g).distinct()).triples.groupBy("p").agg(F.count("*").alias("n")).select(t.local_name(F.col("p")).alias("p"), "n"), "SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(p), (SELECT count(*) AS n FROM nation)")
_b("graph_difference", "nation region", lambda g: g.minus(Graph(g.triples.where(F.startswith("s", F.lit(t.expand("ex:region")))))).triples.groupBy().agg(F.count("*").alias("n")), "SELECT 3 * count(*) AS n FROM nation")
_b("b14_union_rows", "nation region", lambda g: local(Graph((g | g).distinct()).triples.select("s", "p", "o")), " UNION ALL ".join(f"SELECT '{table_}/' || {key} AS s, '{c}' AS p, {c}::VARCHAR AS o FROM {table_}" for table_, key, columns in (("nation", "n_nationkey", ("n_nationkey", "n_name", "n_regionkey")), ("region", "r_regionkey", ("r_regionkey", "r_name"))) for c in columns))
