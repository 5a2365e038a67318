"""Execution of described functions over tables: the first backend that accepts an implementation and can run it.

A backend says whether it accepts an implementation's row, and adds a column
for a call. Backends and describers are lists that callers may extend.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.functions.pysem import Unsupported
from loomflow.operators import provenance
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Graph
from loomflow.plans import compile as plan
from loomflow.plans.resolve import LibraryBackend


class Backend(Protocol):
    def accepts(self, implementation: dict) -> bool:
        """Whether an implementation (kind, name, module, file) is of the kind it runs."""

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        """rows with the function's value; Unsupported where it cannot."""


class ColumnBackend:
    """Described functions as columns."""

    def accepts(self, implementation: dict) -> bool:
        return implementation["kind"] == "PythonFunction" and implementation["module"] not in ("builtins", "_operator")

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        if implementation["name"] not in plan.parse(source or "pass"):
            raise Unsupported(f"no source of {implementation['name']}")
        return rows.withColumn(into, plan.column(rows, source, *args, name=implementation["name"]))


class BuiltinBackend:
    """Builtins and operators as columns."""

    def accepts(self, implementation: dict) -> bool:
        return implementation["module"] in ("builtins", "_operator")

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        names = [f"a{n}" for n in range(len(args))]
        text = f"import operator\ndef call({', '.join(names)}):\n    return {implementation['name']}({', '.join(names)})\n"
        return rows.withColumn(into, plan.column(rows, text, *args, name="call"))


class PythonBackend:
    """The function itself, on Arrow batches; for trusted sources."""

    def accepts(self, implementation: dict) -> bool:
        return implementation["kind"] in ("PythonFunction", "PythonMethod")

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        if implementation["name"] not in plan.parse(source or "pass"):
            raise Unsupported(f"no source of {implementation['name']}")
        return rows.withColumn(into, plan.python_udf(source, implementation["name"], returns)(*args))


BACKENDS: list[Backend] = [ColumnBackend(), BuiltinBackend(), PythonBackend(), LibraryBackend()]
#: Describers of resources: (accepts, describe), the first that accepts one describes it.
DESCRIBERS: list[tuple[Callable[[object], bool], Callable[[SparkSession, object], Graph]]] = []


def describe(spark: SparkSession, resource: object) -> Graph:
    """The graph of a resource: a live function, a source or build file, or a folder; added describers come first."""
    import os

    from loomflow.sources import containers, describe as programs

    for accepts, make in DESCRIBERS:
        if accepts(resource):
            return make(spark, resource)
    if callable(resource):
        try:
            return programs.describe_function(resource).graph(spark)
        except (TypeError, OSError):  # it has no source text
            return programs.describe_callable(resource).graph(spark)
    path = str(resource)
    if os.path.isdir(path) or "://" in path:
        return programs.graph_of(programs.describe_tree(spark, path))
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".py"):
        return programs.describe(text, os.path.basename(path)[:-3], os.path.abspath(path)).graph(spark)
    if os.path.basename(path).startswith("Dockerfile"):
        return containers.describe_dockerfile(text, os.path.abspath(path)).graph(spark)
    raise ValueError(f"nothing describes {path}")


def _class_of(uri: str) -> str:
    """The class's name in the term that was minted for it, which ends in eight digits of a hash."""
    return uri.rpartition("#")[2][:-8]


def candidates(graph: FlowGraph, f: str) -> list[dict]:
    """The implementations of a function, in the order of their mappings."""
    own = graph.implemented().where(F.substring_index("f", "#", -1) == f)
    rows = own.join(graph.python_objects(), "implementation", "left").orderBy("mapping", "implementation").collect()
    local = lambda x: None if x is None else x.rpartition("#")[2]
    return [{"mapping": local(r["mapping"]), "imp": r["implementation"], "kind": local(r["kind"]), "name": r["name"], "module": r["module"], "file": r["file"], "method_of": r["method_of"] and _class_of(r["method_of"])} for r in rows]


def execute(rows: DataFrame, graph: FlowGraph, f: str, source: str, args: list[str], into: str, returns: str = "string", backends: list[Backend] | None = None) -> tuple[DataFrame, dict]:
    """(rows with the value of f, the implementation that was chosen): each implementation with each backend that accepts it, until one can run it."""
    tried = []
    for implementation in candidates(graph, f):
        for backend in backends or BACKENDS:
            if implementation["kind"] and backend.accepts(implementation):
                try:
                    return backend.apply(rows, implementation, source, args, into, returns), implementation | {"backend": type(backend).__name__}
                except Unsupported as e:
                    tried.append(f"{type(backend).__name__}: {e}")
    raise Unsupported(f"{f}: " + ("; ".join(tried) or "no implementation"))


def record(spark: SparkSession, exe: str, f: str, implementation: dict, generated: str, used: list[str], started, ended) -> Graph:
    """The provenance of one execution."""
    row = spark.createDataFrame([(exe, f, implementation["imp"], generated, used, started, ended)], "exe string, fn string, imp string, generated string, used array<string>, started_at timestamp, ended_at timestamp")
    return provenance.executions(row)

