"""Import statements resolved over many modules at once.

Every module is a row (path, text). Its statements become bindings: a name of the
module, and what it stands for: a definition here, a module, or a name of another
module. Star imports add the other module's public names, in rounds until nothing
is new. Bindings then point at bindings; pointers are doubled until each is at a
definition, at a module, or outside of what is known.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.stage import Staged

_BOUND = pa.schema([("module", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("attribute", pa.string()), ("line", pa.int32())])
MOST_ROUNDS = 62


def module_of(path: str, root: str) -> tuple[str, bool]:
    """(dotted name, whether it is a package) of a file below a root."""
    parts = path.removeprefix(root).strip("/").removesuffix(".py").split("/")
    package = parts[-1] == "__init__"
    return ".".join(parts[:-1] if package else parts), package


def statements(text: str, module: str, package: bool) -> Iterator[tuple]:
    """(module, name, kind, target, attribute, line) of the imports and definitions of a module, those inside functions and branches too.

    Kinds: def, module, name, star, public (a name that __all__ lists), error.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield module, None, "error", str(e), None, getattr(e, "lineno", None)
        return
    inside = {n for f in ast.walk(tree) if isinstance(f, ast.ClassDef) for n in f.body}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                # without an alias the first package is bound
                yield (module, a.asname, "module", a.name, None, node.lineno) if a.asname else (module, a.name.split(".")[0], "module", a.name.split(".")[0], None, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                at = module.split(".") if module else []
                up = node.level - package
                if up > len(at):
                    yield module, None, "error", "relative import beyond the top", None, node.lineno
                    continue
                base = ".".join(at[: len(at) - up] + ([node.module] if node.module else []))
            for a in node.names:
                if a.name == "*":
                    yield module, "*", "star", base, None, node.lineno
                else:
                    yield module, a.asname or a.name, "name", base, a.name, node.lineno
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node not in inside:
            yield module, node.name, "def", module, node.name, node.lineno
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            for e in node.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    yield module, e.value, "public", None, None, node.lineno


def bindings(files: DataFrame, root: str) -> DataFrame:
    """(module, name, kind, target, attribute, line) of the files (path, text); null texts are empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                module, package = module_of(path, root)
                rows.append((module, None, "file", path, None, None))
                rows += statements(text or "", module, package)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _BOUND.types, strict=True)], schema=_BOUND)

    return files.select("path", "text").mapInArrow(each, "module string, name string, kind string, target string, attribute string, line int")


def resolved(files: DataFrame, root: str) -> DataFrame:
    """(module, name, kind, target, attribute, file): what every name of every module stands for in the end.

    kind is `def` (defined in the module target, of a file), `module` (a known
    module, with its file) or `outside` (nothing known has it: a library, or a name
    that its module lacks). Of several bindings of a name the last line counts; a
    module's own names count before those of stars, and of stars the last. Names
    with a leading underscore, or not in __all__ where there is one, do not go
    through stars. A package's submodule counts before what its stars bring, and for
    what the package itself takes from itself. Imports in a circle are outside. Files that Python cannot read
    bind nothing. Errors are rows of bindings().
    """
    stage = Staged(files.sparkSession, "imports")
    every = stage.save(bindings(files, root))
    modules = stage.save(every.where("kind = 'file'").groupBy("module").agg(F.min("target").alias("file")))
    own = every.where("kind in ('def', 'module', 'name')")
    last = F.max_by(F.struct("kind", "target", "attribute"), F.struct("line", "kind", "target")).alias("b")
    bound = stage.save(own.groupBy("module", "name").agg(last).select("module", "name", "b.*", F.lit(0).alias("far"), F.lit(0).alias("line")))
    stars = stage.save(every.where("kind = 'star'").groupBy("module", "target").agg(F.max("line").alias("line")))
    listed = stage.save(every.where("kind = 'public'").select("module", "name").distinct())
    # names that go through a star: of modules with a list those on it, else all without an underscore
    with_list = listed.select("module").distinct().withColumn("_listed", F.lit(True))
    new, far = bound, 0
    while True:
        far += 1
        public = new.join(with_list, "module", "left").join(listed.withColumn("_in", F.lit(True)), ["module", "name"], "left").where("_in or (_listed is null and not startswith(name, '_'))")
        come = stars.join(public.select(F.col("module").alias("target"), "name"), "target").groupBy("module", "name").agg(F.max_by("target", "line").alias("target"), F.max("line").alias("line"))
        come = come.join(bound.select("module", "name"), ["module", "name"], "left_anti")
        new = stage.save(come.select("module", "name", F.lit("name").alias("kind"), "target", F.col("name").alias("attribute"), F.lit(far).alias("far"), "line"))
        if new.isEmpty():
            break
        bound = bound.unionByName(new)
    bound = stage.save(bound)
    # where a binding points: to another binding, to a module, or nowhere
    names = bound.where("kind = 'name'").select("module", "name", "target", "attribute")
    inner = names.join(bound.select(F.col("module").alias("target"), F.col("name").alias("attribute"), F.when(F.col("far") == 0, "own").otherwise("star").alias("_bound")), ["target", "attribute"], "left")
    sub = F.when(F.col("target") == "", F.col("attribute")).otherwise(F.concat_ws(".", "target", "attribute"))
    inner = inner.join(modules.select(F.col("module").alias("_sub"), F.lit(True).alias("_module")), sub == F.col("_sub"), "left")
    itself = (F.col("module") == F.col("target")) & (F.col("name") == F.col("attribute"))
    kind = F.when((F.col("_bound") == "own") & ~itself, "name").when(F.col("_module"), "module").when(F.col("_bound").isNotNull() & ~itself, "name").otherwise("outside")
    pointed = inner.select("module", "name", kind.alias("kind"), F.when(kind == "module", F.col("_sub")).otherwise(F.col("target")).alias("target"), F.when(kind != "module", F.col("attribute")).alias("attribute"))
    now = stage.save(pointed.unionByName(bound.where("kind <> 'name'").select("module", "name", "kind", "target", "attribute")))
    total = bound.count()
    for n in range(MOST_ROUNDS):
        open_ = now.where("kind = 'name'")
        if open_.isEmpty():
            break
        to = now.select(F.col("module").alias("target"), F.col("name").alias("attribute"), F.col("kind").alias("_k"), F.col("target").alias("_t"), F.col("attribute").alias("_a"))
        moved = open_.join(to, ["target", "attribute"]).select("module", "name", F.col("_k").alias("kind"), F.col("_t").alias("target"), F.col("_a").alias("attribute"))
        then = stage.save(now.where("kind <> 'name'").unionByName(moved))
        stage.drop(now)
        now = then
        if 1 << n > total:
            # as many steps as there are bindings: what still points is a circle
            now = now.withColumn("kind", F.when(F.col("kind") == "name", "outside").otherwise(F.col("kind")))
            break
    file = modules.select(F.col("module").alias("target"), "file")
    out = now.join(file, "target", "left")
    kind = F.when((F.col("kind") == "module") & F.col("file").isNull(), "outside").otherwise(F.col("kind"))
    return out.select("module", "name", kind.alias("kind"), "target", "attribute", F.when(kind != "outside", F.col("file")).alias("file"))
