"""From an implementation's row to the object it names, for functions whose graph came without their source.

Modules are imported and files run on the executors: for trusted code only.
"""

from __future__ import annotations

import importlib
import importlib.util
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.functions.pysem import Unsupported


class Unresolved(Unsupported):
    """Nothing of that name can be imported."""


@lru_cache(maxsize=64)
def _module(module: str | None, file: str | None):
    if file:
        spec = importlib.util.spec_from_file_location(module or "_resolved", file.removeprefix("file://"))
        if spec and spec.loader:
            made = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(made)
                return made
            except FileNotFoundError:
                pass
    # the longest leading part that is a module; what follows are attributes
    parts = (module or "builtins").split(".")
    for n in range(len(parts), 0, -1):
        try:
            found = importlib.import_module(".".join(parts[:n]))
        except ModuleNotFoundError:
            continue
        for name in parts[n:]:
            found = getattr(found, name)
        return found
    raise Unresolved(f"no module {module} and no file {file}")


def python_object(name: str, module: str | None = None, file: str | None = None, method_of: str | None = None) -> object:
    """The object that a row of an implementation names: of the file or, without one, the module; a method of its class."""
    try:
        of = _module(module, file)
        return getattr(getattr(of, method_of), name) if method_of else getattr(of, name)
    except AttributeError as e:
        raise Unresolved(str(e)) from e


#: Functions of the module math that Spark has too: as columns, for arguments that both take.
_COLUMNS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "expm1": F.expm1,
    "hypot": F.hypot, "degrees": F.degrees, "radians": F.radians, "cbrt": F.cbrt, "floor": F.floor, "ceil": F.ceil, "fabs": lambda c: F.abs(c.cast("double")),
}


class LibraryBackend:
    """Functions of installed modules and of files: those of math as columns where Spark has them, others on Arrow batches. A null argument gives null."""

    def accepts(self, implementation: dict) -> bool:
        return implementation["kind"] in ("PythonFunction", "PythonMethod", "PythonClass") and bool(implementation["module"] or implementation["file"])

    def apply(self, rows: DataFrame, implementation: dict, source: str, args: list[str], into: str, returns: str) -> DataFrame:
        where = [implementation.get(k) for k in ("name", "module", "file", "method_of")]
        python_object(*where)  # an unknown name is told before any task starts
        if implementation["module"] == "math" and implementation["name"] in _COLUMNS:
            return rows.withColumn(into, _COLUMNS[implementation["name"]](*map(F.col, args)).cast(returns))

        @F.arrow_udf(returns)
        def each(given: pa.Array) -> pa.Array:
            f = python_object(*where)
            return pa.array([None if None in row else f(*row) for row in zip(*(c.to_pylist() for c in given.flatten()), strict=True)])

        return rows.withColumn(into, each(F.struct(*args)))
