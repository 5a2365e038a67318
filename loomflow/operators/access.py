"""Questions about functions, calls and compositions, for all subjects at once.

Each accessor is a pattern of triples; a question about one term is the same
table with a filter, which Spark pushes down to the scans. Where an answer must
be unique, ambiguous subjects give no row or, where that is an error, fail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions.terms import NAMESPACES, expand, file_path, local_name
from loomflow.operators.graph import Graph, Group, closure, owners, plain
from loomflow.operators.reach import index, reached, told

CONTROL = ("next", "iterate", "true", "false")
# Kinds of implementations.
PYTHON_KINDS = ("fnoi:PythonClass", "fnoi:PythonMethod", "fnoi:PythonFunction", "fnoi:PythonFile")
ANY = NAMESPACES["python"] + "Any41485baa"


def unique(df: DataFrame, key: str, value: str, error: str | None = None) -> DataFrame:
    """(key, value) of the keys with one distinct value; others fail with the error, or give no row."""
    out = df.groupBy(*owners(df, key)).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    if error:
        return out.select(key, F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(error + ": "), F.col(key)))).alias(value))
    return plain(out.where("_n = 1").drop("_n"))


def ordinal(index: Column) -> Column:
    """n of rdf:_n, null for other predicates."""
    prefix = NAMESPACES["rdf"] + "_"
    return F.when(F.startswith(index, F.lit(prefix)), F.substring(index, len(prefix) + 1, 9).try_cast("int"))


class FlowGraph(Graph):
    # terms

    def types(self) -> DataFrame:
        return self.match([("?term", "a", "?type")])

    def of_type(self, *types: str) -> DataFrame:
        """Terms of any of the types."""
        return self.match(Group([("?term", "a", "?type")], values={"?type": types}), "?term")

    def labels(self) -> DataFrame:
        """(term, label) by rdfs:label or the older fno:name."""
        return self.match([("?term", ("rdfs:label", "fno:name"), "?label")])

    def predicates(self) -> DataFrame:
        """(term, predicate) of parameters and outputs."""
        return self.match(Group([("?term", "a", "?type"), ("?term", "fno:predicate", "?predicate")], values={"?type": ("fno:Parameter", "fno:Output")}), "?term", "?predicate")

    # functions and their terminals

    def functions(self) -> DataFrame:
        return self.match([("?f", "a", "fno:Function")])

    def functions_named(self, name: str) -> DataFrame:
        return self.functions().where(local_name(F.col("f")) == name)

    def _members(self, predicate: str) -> DataFrame:
        found = self.match([("?f", "a", "fno:Function"), ("?f", predicate, "?list"), ("?list", "?index", "?term"), ("?term", "fno:predicate", "?predicate")])
        return found.select("f", ordinal(F.col("index")).alias("ord"), "term", "predicate").where("ord is not null")

    def _of_self(self, rows: DataFrame, name: str, own: bool) -> DataFrame:
        is_self = local_name(F.col("predicate")) == name
        return rows.where(is_self if own else ~is_self)

    def parameters(self, by: str = "ordinal") -> DataFrame:
        """(f, n, parameter, predicate), n from 0 by place in the list or, by="uri", by name; without self."""
        rows = self._of_self(self._members("fno:expects"), "self", False).withColumnRenamed("term", "parameter")
        from pyspark.sql import Window

        order = Window.partitionBy("f").orderBy("ord" if by == "ordinal" else "parameter")
        return rows.select("f", (F.row_number().over(order) - 1).alias("n"), "parameter", "predicate")

    def self_parameters(self) -> DataFrame:
        return self._of_self(self._members("fno:expects"), "self", True).select("f", F.col("term").alias("parameter"))

    def outputs(self) -> DataFrame:
        """(f, output, predicate) without the output of the receiver."""
        return self._of_self(self._members("fno:returns"), "self_output", False).select("f", F.col("term").alias("output"), "predicate")

    def self_outputs(self) -> DataFrame:
        return self._of_self(self._members("fno:returns"), "self_output", True).select("f", F.col("term").alias("output"))

    def terminal_types(self, kind: str) -> DataFrame:
        """(term, type) of fno:Parameter or fno:Output, Any where none is given."""
        found = self.match(Group([("?term", "a", kind)], optional=[Group([("?term", "fno:type", "?type")])]), "?term", "?type")
        return found.select("term", F.coalesce("type", F.lit(ANY)).alias("type"))

    # calls and control

    def applied(self, terms: DataFrame) -> DataFrame:
        """(term, f): the function that a call applies, else the term itself."""
        one = unique(self.match([("?term", "fnoc:applies", "?f")], owned=True), "term", "f")
        return terms.join(one, "term", "left").select("term", F.coalesce("f", "term").alias("f"))

    def order(self) -> DataFrame:
        """(call, next, iterate, true, false); two successors of one kind are an error."""
        rows = self.triples.where(F.col("p").isin([expand(f"fnoc:{k}") for k in CONTROL]))
        of = [F.col("s_of").alias("_of_call")] if "s_of" in rows.columns else []
        rows = rows.select(*of, F.col("s").alias("call"), local_name(F.col("p")).alias("kind"), F.col("o").alias("to"))
        cells = rows.groupBy(*owners(rows, "call")).pivot("kind", list(CONTROL)).agg(F.collect_set("to"))
        some = lambda c: F.when(F.size(c) > 1, F.raise_error(F.concat(F.lit("ambiguous order of "), F.col("call")))).otherwise(F.get(c, F.lit(0)))
        return cells.select("call", *[some(F.col(k)).alias(k) for k in CONTROL])

    # compositions

    def compositions(self) -> DataFrame:
        return self.match([("?composition", "a", "fno:Composition"), ("?composition", "fnoc:represents", "?f")])

    def composed(self) -> "FlowGraph":
        """The triples around compositions that are made of edges."""
        some = self.match([("?s", "fnoc:composedOf", "?edge")], "?s", owned=True).withColumnRenamed("_of_s", "s_of")
        return FlowGraph(self.triples.join(some, some.columns, "left_semi").select(*self.triples.columns), self.wide)

    def starts(self) -> DataFrame:
        """(composition, start); a composition without one start is an error."""
        found = self.match(Group([("?composition", "a", "fno:Composition")], optional=[Group([("?composition", "fnoc:start", "?start")])]), owned=True)
        return unique(found, "composition", "start", "no single start")

    def flow(self) -> DataFrame:
        """(composition, source, target, priority) of the data mappings."""
        return self.match(
            Group(
                [("?composition", "fnoc:composedOf", "?edge"), ("?edge", ("fnoc:mapFrom", "fnoc:mapFromTerm"), "?source"), ("?edge", ("fnoc:mapTo", "fnoc:mapToVariable"), "?target")],
                optional=[Group([("?edge", "fnoc:priority", "?priority")])],
            ),
            "?composition", "?source", "?target", "?priority",
        )

    def endpoints(self) -> DataFrame:
        """(endpoint, call, terminal) of the ends that are terminals of calls."""
        return self.match([("?endpoint", "fnoc:constituentFunction", "?call"), ("?endpoint", ("fnoc:functionParameter", "fnoc:functionOutput"), "?terminal")])

    def terms_mapped(self) -> DataFrame:
        """(edge, value) of the edges that start at a literal."""
        return self.match([("?edge", "fnoc:mapFromTerm", "?value")])

    def strategies(self) -> DataFrame:
        """(endpoint, strategy, key); two strategies of one end are an error."""
        found = self.match(Group([("?endpoint", "fnoc:mappingStrategy", "?strategy")], optional=[Group([("?endpoint", ("fnoc:key", "fnoc:index", "fnoc:property"), "?key")])]), owned=True)
        return found.groupBy(*owners(found, "endpoint")).agg(F.min("strategy").alias("strategy"), F.min("key").alias("key"), F.count("*").alias("_n")).select(
            "endpoint", F.when(F.col("_n") == 1, F.col("strategy")).otherwise(F.raise_error(F.lit("more than one strategy"))).alias("strategy"), "key"
        )

    def used_functions(self, rows: DataFrame | None = None, owned: bool = False) -> DataFrame:
        """(composition, call): sources, targets and starts; with the other columns of distinct rows (call, ...), if given; owned: with the number of the composition, where the graph has it.

        Rows join before sources, targets and starts come together: their union is
        dealt by one number at most.
        """
        call = ("?end", "fnoc:constituentFunction", "?call")
        ways = [[("?composition", "fnoc:composedOf", "?edge"), ("?edge", p, "?end"), call] for p in ("fnoc:mapFrom", "fnoc:mapTo")]
        parts = []
        for way in (*ways, [("?composition", "fnoc:start", "?call")]):
            part = self.match(way, "?composition", "?call", distinct=False, owned=True)
            if rows is not None:
                by = [c for c in owners(part, "call") if c in rows.columns]
                part = part.join(rows, by)
            parts.append(part.select(*owners(part, "composition"), "call", *([] if rows is None else [c for c in plain(rows).columns if c != "call"])))
        used = reduce(DataFrame.union, parts).distinct()
        return used if owned else plain(used)

    def depends(self, owned: bool = False) -> DataFrame:
        """(composition, call, on): calls whose values a call takes; owned as in match()."""
        return self.match(
            [
                ("?composition", "fnoc:composedOf", "?edge"), ("?edge", "fnoc:mapTo", "?to"), ("?to", "fnoc:constituentFunction", "?call"),
                ("?edge", "fnoc:mapFrom", "?from"), ("?from", "fnoc:constituentFunction", "?on"),
            ],
            "?composition", "?call", "?on", owned=owned,
        )

    def reach(self) -> tuple[DataFrame, DataFrame]:
        """The reachability index of what calls depend on: from a call to those that take its values, at any distance."""
        return index(self.depends().select(F.col("on").alias("a"), F.col("call").alias("b")))

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) of calls with `reached`; pairs tell the number of a, _of_a, if the graph tells numbers."""
        edges = self.depends(owned=True)
        if "_of_on" not in edges.columns:
            return reached(pairs.select("a", "b").distinct(), *self.reach())
        return told(pairs, edges.select(F.col("_of_on").alias("_of_a"), F.col("_of_call").alias("_of_b"), F.col("on").alias("a"), F.col("call").alias("b")))

    def depends_closure(self) -> DataFrame:
        """(composition, call, on, steps): also through other calls."""
        return closure(self.depends(owned=True), "call", "on", ("composition",))

    # implementations and mappings

    def implemented(self) -> DataFrame:
        """(f, mapping, implementation)."""
        return self.match([("?mapping", "a", "fno:Mapping"), ("?mapping", "fno:function", "?f"), ("?mapping", "fno:implementation", "?implementation")], "?f", "?mapping", "?implementation")

    def by_file(self) -> DataFrame:
        """(file, f, mapping, implementation)."""
        return self.match([("?mapping", "a", "fno:Mapping"), ("?mapping", "fno:function", "?f"), ("?mapping", "fno:implementation", "?implementation"), ("?implementation", "fnoi:file", "?file")], "?file", "?f", "?mapping", "?implementation")

    def metadata(self) -> DataFrame:
        """(implementation, metadata): predicates to their sorted objects."""
        own = self.triples.join(self.of_type("fnoi:Implementation"), F.col("s") == F.col("term"), "left_semi")
        lists = own.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
        return lists.groupBy(F.col("s").alias("implementation")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os")))).alias("metadata"))

    def files(self) -> DataFrame:
        """(term, file) as a path; two files are an error."""
        return unique(self.match([("?term", "fnoi:file", "?file")]), "term", "file", "more than one file").select("term", file_path(F.col("file")).alias("file"))

    def python_objects(self) -> DataFrame:
        """(implementation, kind, name, module, package, file, method_of)."""
        more = (("fnoi:module", "?module"), ("fnoi:package", "?package"), ("fnoi:file", "?file"), ("fnoi:methodOf", "?method_of"))
        return self.match(
            Group([("?implementation", "a", "?kind"), ("?implementation", "doap:name", "?name")], optional=[Group([("?implementation", p, v)]) for p, v in more], values={"?kind": PYTHON_KINDS}),
            "?implementation", "?kind", "?name", "?module", "?package", "?file", "?method_of",
        )

    def represents_python(self) -> DataFrame:
        """Compositions of functions with a Python implementation."""
        found = self.match(Group([("?composition", "fnoc:represents", "?f"), ("?mapping", "fno:function", "?f"), ("?mapping", "fno:implementation", "?implementation"), ("?implementation", "a", "?kind")], values={"?kind": PYTHON_KINDS}), "?composition")
        return found

    # parameter mappings

    def _mapped(self, kind: str, predicate: str | None, name: str) -> DataFrame:
        value = [("?node", predicate, f"?{name}")] if predicate else []
        return self.match(
            [("?mapping", "a", "fno:Mapping"), ("?mapping", "fno:function", "?f"), ("?mapping", "fno:parameterMapping", "?node"), ("?node", "a", f"fnom:{kind}"), ("?node", "fnom:functionParameter", "?parameter"), *value],
            "?f", "?parameter", *([f"?{name}"] if predicate else []),
        )

    def positions(self) -> DataFrame:
        """(f, parameter, position)."""
        found = self._mapped("PositionParameterMapping", "fnom:implementationParameterPosition", "position")
        return found.withColumn("position", F.col("position").try_cast("int"))

    def parameter_at(self) -> DataFrame:
        """(f, position, parameter) of the positions with one parameter."""
        found = self.positions().groupBy("f", "position").agg(F.min("parameter").alias("parameter"), F.count_distinct("parameter").alias("_n"))
        return found.where("_n = 1").drop("_n")

    def positional(self) -> DataFrame:
        """(f, parameters) in the order of their positions, without self."""
        selves = self.self_parameters().select("parameter")
        rows = self.positions().join(selves, "parameter", "left_anti")
        return rows.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "parameter"))), lambda x: x["parameter"]).alias("parameters"))

    def keywords(self) -> DataFrame:
        """(f, parameter, property)."""
        return self._mapped("PropertyParameterMapping", "fnom:implementationProperty", "property")

    def defaults(self) -> DataFrame:
        """(f, parameter, value); two defaults of a parameter are an error."""
        found = self._mapped("DefaultParameterMapping", "fnom:defaultValue", "value")
        return found.groupBy("f", "parameter").agg(F.min("value").alias("value"), F.count("*").alias("_n")).select("f", "parameter", F.when(F.col("_n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("more than one default"))).alias("value"))

    def var_positional(self) -> DataFrame:
        return unique(self._mapped("VarPositionalParameterMapping", None, ""), "f", "parameter")

    def var_keyword(self) -> DataFrame:
        return unique(self._mapped("VarPropertyParameterMapping", None, ""), "f", "parameter")

    def parameter_mappings(self) -> DataFrame:
        """(f, parameter, position, property), the last two where there are any."""
        pairs = self.parameters().select("f", "parameter")
        return pairs.join(self.positions(), ["f", "parameter"], "left").join(self.keywords(), ["f", "parameter"], "left")

    # descriptions

    def description(self) -> DataFrame:
        """(f, s, p, o, o_kind, o_dt): every triple that describes a function, its terminals, mappings and implementation."""
        own = self.match([("?f", "a", "fno:Function")]).select("f", F.col("f").alias("s"))
        lists = [self.match([("?f", "a", "fno:Function"), ("?f", p, "?s")]) for p in ("fno:expects", "fno:returns")]
        terminals = [self._members(p).select("f", F.col("term").alias("s")) for p in ("fno:expects", "fno:returns")]
        maps = self.implemented()
        nodes = self.match([("?mapping", "fno:function", "?f"), ("?mapping", ("fno:parameterMapping", "fno:returnMapping", "fno:methodMapping"), "?s")], "?f", "?s")
        calls = self.match([("?s", "fnoc:applies", "?f")], "?f", "?s")
        subjects = [own, *lists, *terminals, maps.select("f", F.col("mapping").alias("s")), maps.select("f", F.col("implementation").alias("s")), nodes, calls]
        every = reduce(DataFrame.unionByName, [x.select("f", "s") for x in subjects]).distinct()
        return every.join(self.triples, "s").select("f", "s", "p", "o", "o_kind", "o_dt").distinct()
