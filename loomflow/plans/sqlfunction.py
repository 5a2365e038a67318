"""Described functions as functions of Spark SQL.

A graph becomes a column over the parameters; the analyzer's text of that column
is the body of a SQL function, which Spark inlines where a query calls it: no
Python runs, and filters and projections go through it as through any expression.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions.pysem import Unsupported
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Graph
from loomflow.plans import graphplan
from loomflow.plans import compile as plan


def _text(rows: DataFrame, column) -> tuple[str, str]:
    """(SQL text, type) of a column of rows."""
    out = rows.select(column.alias("out"))
    made = out._jdf.queryExecution().analyzed().projectList().last().child()
    return made.sql(), out.schema["out"].dataType.simpleString()


def create(spark: SparkSession, graph: Graph | FlowGraph | str, f: str, types: dict[str, str], name: str | None = None) -> str:
    """Register function f of a graph, or of a source text, as a temporary SQL function; its name.

    types are the parameters' Spark types, in order. Raises Unsupported where the
    function's column has no SQL text, as where it holds lambda functions.
    """
    name = name or f
    if not all(re.fullmatch(r"[A-Za-z_]\w*", x) for x in (name, *types)):
        raise Unsupported(f"{name} is no SQL name")
    empty = spark.range(0).select(*[F.lit(None).cast(kind).alias(p) for p, kind in types.items()])
    column = plan.column(empty, graph, *types, name=f) if isinstance(graph, str) else graphplan.column(empty, graph, f, *types)
    body, kind = _text(empty, column)
    if "lambda" in body.lower():
        raise Unsupported(f"{f} has no SQL text")
    given = ", ".join(f"{p} {t}" for p, t in types.items())
    try:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
        # its own types must come back
        spark.sql(f"SELECT {name}({', '.join(f'CAST(NULL AS {t})' for t in types.values())}) AS out").schema  # noqa: B018
    except PySparkException as e:
        raise Unsupported(f"{f} has no SQL text: {e}") from e
    return name


class SqlBackend:
    """Described functions through SQL functions that the analyzer inlines; put it into execute.BACKENDS or an own list."""

    def accepts(self, implementation: dict) -> bool:
        return implementation["kind"] == "PythonFunction" and implementation["module"] not in ("builtins", "_operator")

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        functions = plan.parse(source or "pass")
        if implementation["name"] not in functions:
            raise Unsupported(f"no source of {implementation['name']}")
        spec = functions[implementation["name"]].args
        names = [a.arg for a in (*spec.posonlyargs, *spec.args)]
        if len(names) != len(args):
            raise Unsupported("other numbers of arguments than parameters")
        kinds = dict(rows.dtypes)
        name = create(rows.sparkSession, source, implementation["name"], {p: kinds[a] for p, a in zip(names, args, strict=True)}, f"_{implementation['name']}")
        return rows.withColumn(into, F.call_function(name, *map(F.col, args)))
