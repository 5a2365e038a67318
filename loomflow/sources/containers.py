"""Container build files: instructions as a table, and the graph of what they do.

The state that instructions change (working folder, entry point, command) is a
window over their order, so any number of files is handled at once. Images are
not built.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES, base_name, dir_name, minted, moved
from loomflow.operators.graph import Graph, Lit, triples

# Instructions, and those of them that have a function of their own.
INSTRUCTIONS = ("FROM", "RUN", "CMD", "LABEL", "MAINTAINER", "EXPOSE", "ENV", "ADD", "COPY", "ENTRYPOINT", "VOLUME", "USER", "WORKDIR", "ARG", "ONBUILD", "STOPSIGNAL", "HEALTHCHECK", "SHELL")


def parse(text: str) -> list[tuple[int, str, str]]:
    """(order, instruction, value); comments go, lines that end in a backslash continue."""
    joined, held = [], ""
    for line in text.splitlines():
        if line.strip().startswith("#") or (not line.strip() and not held):
            continue
        held += line.strip() if held else line.lstrip()
        if held.rstrip().endswith("\\"):
            held = held.rstrip()[:-1].rstrip() + " "
            continue
        joined.append(held.strip())
        held = ""
    if held.strip():
        joined.append(held.strip())
    out = []
    for line in joined:
        word, _, value = line.partition(" ")
        if word.upper() in INSTRUCTIONS:
            out.append((len(out), word.upper(), value.strip()))
    return out


def instructions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, ord, inst, value) of build files given as whole texts, by column functions only."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*#.*(\r?\n|$)", ""), r"\\[ \t]*\r?\n\s*", " ")
    lines = F.filter(F.transform(F.split(clean, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(r"(?i)^(" + "|".join(INSTRUCTIONS) + r")(\s|$)")))
    rows = files.select(F.col(path).alias("file"), F.posexplode(lines).alias("ord", "line"))
    value = F.trim(F.regexp_replace("line", r"^\S+\s*", ""))
    return rows.select("file", "ord", F.upper(F.regexp_extract("line", r"^\S+", 0)).alias("inst"), F.regexp_replace(value, r"\s+", " ").alias("value"))



def state(rows: DataFrame) -> DataFrame:
    """rows with workdir, entrypoint and command as they are after each instruction; paths join, absolute ones replace."""
    upto = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.collect_list(F.when(F.col("inst") == "WORKDIR", F.col("value"))).over(upto)

    def step(now, x):
        return F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.rtrim(now, F.lit("/")), F.lit("/"), x))

    def parsed(x):
        return F.coalesce(F.from_json(x, "array<string>"), F.array(x))

    entry = F.last(F.when(F.col("inst") == "ENTRYPOINT", F.col("value")), ignorenulls=True).over(upto)
    command = F.last(F.when(F.col("inst") == "CMD", F.col("value")), ignorenulls=True).over(upto)
    return rows.select(
        "*",
        F.aggregate(parts, F.lit("/"), step).alias("workdir"),
        F.when(entry.isNotNull(), parsed(entry)).alias("entrypoint"),
        F.when(command.isNotNull(), parsed(command)).alias("command"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """(file, workdir, call): what a container of the last image runs, the command after the entry point."""
    last = Window.partitionBy("file").orderBy(F.desc("ord"))
    end = state(rows).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    none = F.array().cast("array<string>")
    return end.select("file", "workdir", F.concat(F.coalesce("entrypoint", none), F.coalesce("command", none)).alias("call"))


def chain(rows: DataFrame) -> DataFrame:
    """(file, call, from_call, next): each instruction is a call that takes the image of the one before."""
    by = Window.partitionBy("file").orderBy("ord")
    nth = F.row_number().over(Window.partitionBy("file", "inst").orderBy("ord"))
    named = rows.withColumn("call", F.concat(F.lower("inst"), F.lit("_"), nth))
    return named.select("file", "ord", "inst", "value", "call", F.lag("call").over(by).alias("from_call"), F.lead("call").over(by).alias("next"))


def copies(rows: DataFrame) -> DataFrame:
    """(file, ord, source, target): each source of COPY and ADD with its target, relative ones below the working folder."""
    args = F.filter(F.split("value", " "), lambda x: ~F.startswith(x, F.lit("--")))
    rows = state(rows).where(F.col("inst").isin("COPY", "ADD")).withColumn("args", args).where(F.size("args") >= 2)
    target = F.element_at("args", -1)
    full = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.rtrim("workdir", F.lit("/")), F.lit("/"), F.regexp_replace(target, r"^\./?", "")))
    return rows.select("file", "ord", F.explode(F.slice("args", F.lit(1), F.size("args") - 1)).alias("source"), full.alias("target"))


def relocated(implementations: DataFrame, moves: DataFrame) -> DataFrame:
    """(imp, alternate_of, file, image): implementations whose file a copy brings into an image.

    implementations has imp, name, module, package, file; moves file, source and
    target. A copied file keeps its path below the source folder; what is not
    copied gives no row.
    """
    folder = F.concat(dir_name(F.col("file")), F.lit("/"), F.regexp_replace("source", r"^\./?|/$", ""))
    sources = moves.select(F.rtrim(folder, F.lit("/")).alias("from"), F.col("file").alias("image"), "target")
    # each file stands below all folders of its path: an equal join instead of one by prefix
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = implementations.withColumn("from", F.explode(above)).join(sources, "from")
    target = F.rtrim("target", F.lit("/"))
    itself = F.when(F.endswith("target", F.lit("/")), F.concat(target, F.lit("/"), base_name(F.col("file")))).otherwise(target)
    new = F.when(F.col("file") == F.col("from"), itself).otherwise(moved(F.col("file"), F.col("from"), target))
    return inside.select(minted(F.col("name"), F.col("module"), F.col("package"), new).alias("imp"), F.col("imp").alias("alternate_of"), new.alias("file"), "image")


@dataclass
class DescribedFile:
    """The graph of one build file, as its instructions tell it."""

    path: str
    steps: list[tuple[int, str, str]] = field(default_factory=list)

    def triples(self):
        import hashlib

        do, ex = NAMESPACES["do"], NAMESPACES["ex"]
        name = self.path.rpartition("/")[0].rpartition("/")[2] or "image"
        f = f"{ex}{name}{hashlib.sha256(self.path.encode()).hexdigest()[:8]}"
        imp = f"{NAMESPACES['docker']}{name}{hashlib.sha256(self.path.encode()).hexdigest()[:8]}"
        yield from ((f, "a", "fno:Function"), (f, "a", "do:Dockerfile"), (f, "a", "prov:Entity"), (f, "rdfs:label", Lit(f"{name}Dockerfile")))
        yield from ((imp, "a", "fnoi:Dockerfile"), (imp, "fnoi:file", f"file://{self.path}"), (f + "Mapping", "a", "fno:Mapping"), (f + "Mapping", "fno:function", f), (f + "Mapping", "fno:implementation", imp))
        comp = f + "Composition"
        yield from ((comp, "a", "fno:Composition"), (comp, "fnoc:represents", f))
        counts: dict[str, int] = {}
        before = None

        def edge(target: str, term: str, n: str, literal=None, source=None, key=None):
            node, b = f"_:m{name}{n}", f"_:t{name}{n}"
            yield from ((comp, "fnoc:composedOf", node), (node, "fnoc:mapTo", b), (b, "fnoc:constituentFunction", target), (b, "fnoc:functionParameter", do + term))
            if source:
                a = f"_:f{name}{n}"
                yield from ((node, "fnoc:mapFrom", a), (a, "fnoc:constituentFunction", source), (a, "fnoc:functionOutput", do + "ImageOutput"))
            else:
                yield (node, "fnoc:mapFromTerm", Lit(literal))
            if key is not None:
                yield from ((b, "fnoc:mappingStrategy", "fnoc:toList"), (b, "fnoc:key", Lit(key)))

        for n, inst, value in self.steps:
            low = inst.lower()
            counts[low] = counts.get(low, 0) + 1
            call = f"{ex}{low}_{counts[low]}"
            yield (call, "fnoc:applies", do + low)
            if before is None:
                yield (comp, "fnoc:start", call)
            else:
                yield (before, "fnoc:next", call)
                yield from edge(call, f"{low}InputImage", f"{n}i", source=before)
            for k, (term, literal, key) in enumerate(arguments(inst, value)):
                yield from edge(call, term, f"{n}a{k}", literal, key=key)
            before = call
        if before:
            yield from edge(f, "ImageOutput", "out", source=before)

    def rows(self) -> list[tuple]:
        from loomflow.functions.terms import expand
        from loomflow.operators.graph import literal_of

        out = set()
        for s, p, o in self.triples():
            kind = literal_of(o.value) if isinstance(o, Lit) else (expand(o), "bnode" if o.startswith("_:") else "uri", None)
            out.add((expand(s), expand(p), *kind))
        return sorted(out, key=str)

    def graph(self, spark: SparkSession) -> Graph:
        return Graph.of(spark, self.rows())


def arguments(inst: str, value: str) -> list[tuple[str, str, int | None]]:
    """(parameter, value, place in its list) of an instruction."""
    low = inst.lower()
    if inst in ("ENTRYPOINT", "CMD"):
        try:
            given = [str(x) for x in json.loads(value)]
        except ValueError:
            given = [value]
        if inst == "ENTRYPOINT":
            return [("entrypointCommand", given[0], None)] + [("entrypointParams", x, n) for n, x in enumerate(given[1:])] if given else []
        return [("cmdParams", x, n) for n, x in enumerate(given)]
    if inst in ("COPY", "ADD"):
        parts = [x for x in re.split(r"\s+", value) if not x.startswith("--")]
        return [(f"{low}Source", x, n if len(parts) > 2 else None) for n, x in enumerate(parts[:-1])] + [(f"{low}Target", parts[-1], None)] if len(parts) > 1 else []
    return [(f"{low}Value", value, None)]


def describe_dockerfile(text: str, path: str) -> DescribedFile:
    return DescribedFile(path, parse(text))


def image_rows(images: DataFrame) -> Graph:
    """Metadata of images (id, tag, created, size) as triples."""
    s = F.concat(F.lit(NAMESPACES["docker"]), F.substring(F.sha2("id", 256), 1, 8))
    return Graph(triples(images, s, ("a", F.lit(NAMESPACES["do"] + "Image"), "uri"), ("dcterms:identifier", F.col("id"), "literal"), ("do:tag", F.col("tag"), "literal"), ("dcterms:created", F.col("created"), "literal"), ("do:size", F.col("size"), "literal", "xsd:integer")))
