"""Queries of the graph builders over tables: the rows that they build, against SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.functions import terms as t
from loomflow.operators import build
from loomflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _ex(*parts: Column | str) -> Column:
    return F.concat(F.lit(t.expand("ex:")), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _node(*parts: Column | str) -> Column:
    return F.concat(F.lit("_:"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _q(name: str, rows: Callable[[SparkSession, str], DataFrame], make: Callable[[DataFrame], DataFrame], sql: str, datatypes: bool = False) -> None:
    """(s, p, o) of what is built, by local names of terms; literals as they are, with their datatypes if asked for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(t.local_name(F.col("o")))
        more = [t.local_name(F.col("o_dt")).alias("dt")] if datatypes else []
        return make(rows(spark, sf_dir)).select(t.local_name(F.col("s")).alias("s"), t.local_name(F.col("p")).alias("p"), o.alias("o"), *more)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each line of an order, and the one after it."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_partkey", "l_quantity", F.row_number().over(order).alias("n"), F.lead("l_partkey").over(order).alias("then"),
        F.when(F.col("l_returnflag") == "N", "next").when(F.col("l_returnflag") == "R", "iterate").otherwise("true").alias("kind"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", "p_retailprice", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"))




def _k() -> Column:
    return F.col("k")


def _n() -> Column:
    return F.col("n")


def _i() -> Column:
    return F.col("i")


def _call() -> Column:
    return _ex("call", _k(), "_", _n())


def _comp() -> Column:
    return _ex("order", _k(), "Composition")


def _then() -> Column:
    return F.when(F.col("then").isNotNull(), _ex("call", _k(), "_", _n() + 1))


def _function() -> Column:
    return _ex("part", _k())


def _imp() -> Column:
    return F.concat(F.lit(t.NAMESPACES["python"]), F.col("brand"))


def _mapping() -> Column:
    return _ex("part", _k(), "Mapping")


def _term() -> Column:
    return _ex("part", _k(), "Parameter", _i())


_LINES = """WITH c AS (SELECT l_orderkey k, row_number() OVER w n, l_partkey p, lead(l_partkey) OVER w nxt, l_quantity q, CASE l_returnflag WHEN 'N' THEN 'next' WHEN 'R' THEN 'iterate' ELSE 'true' END kind
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""
_PARTS = "WITH f AS (SELECT p_partkey k, p_name, p_size z, p_retailprice, replace(p_brand, '#', '_') brand FROM part), p AS (SELECT *, unnest(range(0, z % 3 + 1)) AS i FROM f)"

_q("b01_apply", _calls, lambda c: build.call(c, _call(), _ex("part", F.col("l_partkey"))), f"{_LINES} SELECT 'call' || k || '_' || n AS s, 'applies' AS p, 'part' || p AS o FROM c")
_q("b02_control", _calls, lambda c: build.control(c, _call(), _then(), F.col("kind")), f"{_LINES} SELECT 'call' || k || '_' || n AS s, kind AS p, 'call' || k || '_' || (n + 1) AS o FROM c WHERE nxt IS NOT NULL")
_q("b03_start", _calls, lambda c: build.start(c.where("n = 1"), _comp(), _call()), f"{_LINES} SELECT 'order' || k || 'Composition' AS s, 'start' AS p, 'call' || k || '_1' AS o FROM c WHERE n = 1")


def _composition(c: DataFrame) -> DataFrame:
    """Each call's output goes to the next call; a constant goes to the first."""
    flow, source, target = _node("flow", _k(), "_", _n()), _node("from", _k(), "_", _n()), _node("to", _k(), "_", _n())
    linked = c.where("then is not null")
    return build.union(
        build.composition(c.where("n = 1"), _comp(), _ex("part", F.col("l_partkey"))),
        build.data_edge(linked, _comp(), flow, source, target, priority=F.when(F.col("kind") == "next", _call())),
        build.endpoint(linked, source, _call(), _ex("part", F.col("l_partkey"), "Output"), True),
        build.endpoint(linked, target, _then(), _ex("part", F.col("then"), "Parameter0"), False, strategy=F.when(F.col("kind") == "iterate", F.lit(t.expand("fnoc:toList"))), key=F.when(F.col("kind") == "iterate", _n())),
        build.data_edge(c.where("n = 1"), _comp(), _node("constant", _k()), None, _node("first", _k()), term=F.col("l_quantity").cast("string")),
        build.endpoint(c.where("n = 1"), _node("first", _k()), _call(), _ex("part", F.col("l_partkey"), "Parameter0"), False),
    )


_LINKED, _FIRST = "FROM c WHERE nxt IS NOT NULL", "FROM c WHERE n = 1"
_q("b04_composition", _calls, _composition, f"{_LINES} " + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o {rows}" for s, p, o, rows in (
    ("'order' || k || 'Composition'", "type", "'Composition'", _FIRST), ("'order' || k || 'Composition'", "represents", "'part' || p", _FIRST), ("'order' || k || 'Composition'", "composedOf", "'_:flow' || k || '_' || n", _LINKED),
    ("'_:flow' || k || '_' || n", "mapFrom", "'_:from' || k || '_' || n", _LINKED), ("'_:flow' || k || '_' || n", "mapTo", "'_:to' || k || '_' || n", _LINKED), ("'_:flow' || k || '_' || n", "priority", "'call' || k || '_' || n", _LINKED + " AND kind = 'next'"),
    ("'_:from' || k || '_' || n", "constituentFunction", "'call' || k || '_' || n", _LINKED), ("'_:from' || k || '_' || n", "functionOutput", "'part' || p || 'Output'", _LINKED),
    ("'_:to' || k || '_' || n", "constituentFunction", "'call' || k || '_' || (n + 1)", _LINKED), ("'_:to' || k || '_' || n", "functionParameter", "'part' || nxt || 'Parameter0'", _LINKED),
    ("'_:to' || k || '_' || n", "mappingStrategy", "'toList'", _LINKED + " AND kind = 'iterate'"), ("'_:to' || k || '_' || n", "key", "CAST(n AS VARCHAR)", _LINKED + " AND kind = 'iterate'"),
    ("'order' || k || 'Composition'", "composedOf", "'_:constant' || k", _FIRST), ("'_:constant' || k", "mapFromTerm", "CAST(q AS VARCHAR)", _FIRST), ("'_:constant' || k", "mapTo", "'_:first' || k", _FIRST),
    ("'_:first' || k", "constituentFunction", "'call' || k || '_1'", _FIRST), ("'_:first' || k", "functionParameter", "'part' || p || 'Parameter0'", _FIRST),
)))
_q("b05_function", _parts, lambda p: build.function(p, _function(), F.col("p_name"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: _ex("part", _k(), "Parameter", i)), F.array(_ex("part", _k(), "Output"))), f"{_PARTS} " + " UNION ALL ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {rows}" for s, p, o, rows in (
    ("'part' || k", "'type'", "'Function'", "f"), ("'part' || k", "'label'", "p_name", "f"), ("'part' || k", "'expects'", "'_:part' || k || 'expects'", "f"), ("'part' || k", "'returns'", "'_:part' || k || 'returns'", "f"),
    ("'_:part' || k || 'expects'", "'type'", "'Seq'", "f"), ("'_:part' || k || 'returns'", "'type'", "'Seq'", "f"), ("'_:part' || k || 'expects'", "'_' || (i + 1)", "'part' || k || 'Parameter' || i", "p"), ("'_:part' || k || 'returns'", "'_1'", "'part' || k || 'Output'", "f"),
)))


def _given(p: DataFrame) -> DataFrame:
    return p.select("*", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("i"))


_q("b06_terminals", _parts, lambda p: build.union(build.terminal(_given(p), _term(), "Parameter", _ex("p", _i()), F.when(_i() == 0, _imp()), _i() < F.col("p_size") % 3), build.terminal(p, _ex("part", _k(), "Output"), "Output", _ex("result"))), f"{_PARTS} " + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {rows}" for s, p, o, rows in (
    ("'part' || k || 'Parameter' || i", "type", "'Parameter'", "p"), ("'part' || k || 'Parameter' || i", "predicate", "'p' || i", "p"), ("'part' || k || 'Parameter' || i", "type", "brand", "p WHERE i = 0"), ("'part' || k || 'Parameter' || i", "required", "CAST(i < z % 3 AS VARCHAR)", "p"),
    ("'part' || k || 'Output'", "type", "'Output'", "f"), ("'part' || k || 'Output'", "predicate", "'result'", "f"),
)))
_q("b07_implementation", _parts, lambda p: build.implementation(p.select("brand").distinct(), _imp(), F.lit(t.expand("fnoi:PythonFunction")), F.col("brand"), F.concat(F.lit("m."), F.col("brand")), F.concat(F.lit("file:///src/"), F.col("brand"), F.lit(".py")), F.when(F.endswith("brand", F.lit("1")), F.lit(t.NAMESPACES["python"] + "Base"))), f"{_PARTS}, b AS (SELECT DISTINCT brand FROM f) " + " UNION ALL ".join(f"SELECT brand AS s, '{p}' AS p, {o} AS o FROM b{when}" for p, o, when in (
    ("type", "'Implementation'", ""), ("type", "'PythonFunction'", ""), ("name", "brand", ""), ("module", "'m.' || brand", ""), ("file", "'file:///src/' || brand || '.py'", ""), ("methodOf", "'Base'", " WHERE brand LIKE '%1'"),
)))


def _mapped(p: DataFrame) -> DataFrame:
    given, node = _given(p), _node("map", _k(), "_", _i())
    last = _i() == F.col("p_size") % 3
    return build.union(
        build.parameter_mapping(given, _mapping(), node, _term(), position=_i(), name=F.concat(F.lit("p"), _i().cast("string")), default=F.when(last & (F.col("p_size") % 2 == 0), F.col("p_size"))),
        build.parameter_mapping(given.where(last & (F.col("p_size") % 5 == 0)), _mapping(), node, _term(), rest="args"),
        build.parameter_mapping(given.where(last & (F.col("p_size") % 7 == 0)), _mapping(), node, _term(), rest="kwargs"),
    )


_KINDS = [("Position", "implementationParameterPosition", "CAST(i AS VARCHAR)", ""), ("Property", "implementationProperty", "'p' || i", ""), ("Default", "defaultValue", "CAST(z AS VARCHAR)", " WHERE i = z % 3 AND z % 2 = 0"), ("VarPositional", None, None, " WHERE i = z % 3 AND z % 5 = 0"), ("VarProperty", None, None, " WHERE i = z % 3 AND z % 7 = 0")]
_q("b08_mapping_kinds", _parts, _mapped, f"{_PARTS} " + " UNION ALL ".join(
    f"SELECT 'part' || k || 'Mapping' AS s, 'parameterMapping' AS p, '_:map' || k || '_' || i || '_{kind}' AS o FROM p{when} UNION ALL SELECT '_:map' || k || '_' || i || '_{kind}', 'type', '{kind}ParameterMapping' FROM p{when} UNION ALL SELECT '_:map' || k || '_' || i || '_{kind}', 'functionParameter', 'part' || k || 'Parameter' || i FROM p{when}"
    + (f" UNION ALL SELECT '_:map' || k || '_' || i || '_{kind}', '{predicate}', {value} FROM p{when}" if predicate else "") for kind, predicate, value, when in _KINDS
))
_q("b09_implementation_link", _parts, lambda p: build.mapping(p, _mapping(), _function(), _imp()), f"{_PARTS} " + " UNION ALL ".join(f"SELECT 'part' || k || 'Mapping' AS s, '{p}' AS p, {o} AS o FROM f" for p, o in (("type", "'Mapping'"), ("function", "'part' || k"), ("implementation", "brand"))))
_q("b17_literals", lambda s, d: table(s, d, "orders"), lambda o: build.literals(o, _ex("order", F.col("o_orderkey")), o_orderkey="ex:key", o_orderstatus="ex:status"), """
SELECT 'order' || o_orderkey AS s, 'key' AS p, o_orderkey::VARCHAR AS o, 'integer' AS dt FROM orders UNION ALL SELECT 'order' || o_orderkey, 'status', o_orderstatus, NULL FROM orders""", datatypes=True)
_q("b19_by_count", _parts, lambda p: build.parameters_by_count(p, _function(), F.col("p_size") % 4), "WITH p AS (SELECT p_partkey k, unnest(range(0, p_size % 4)) AS i FROM part) " + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM p" for s, p, o in (
    ("'part' || k || 'Parameter' || i", "type", "'Parameter'"), ("'part' || k || 'Parameter' || i", "predicate", "'p' || i"), ("'part' || k || 'Mapping'", "parameterMapping", "'_:part' || k || '_' || i || '_Position'"),
    ("'_:part' || k || '_' || i || '_Position'", "type", "'PositionParameterMapping'"), ("'_:part' || k || '_' || i || '_Position'", "functionParameter", "'part' || k || 'Parameter' || i"), ("'_:part' || k || '_' || i || '_Position'", "implementationParameterPosition", "CAST(i AS VARCHAR)"),
)))
