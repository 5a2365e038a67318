"""The functions that descriptions refer to without describing them: control flow and container instructions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from loomflow.operators.graph import Graph, Lit

# Name, label, (parameter, predicate) in order, (output, predicate).
CONTROL_FLOW = (
    ("Is", "is", (("ObjectParameter1", "object1"), ("ObjectParameter2", "object2")), (("BoolOutput", "bool"),)),
    ("IsNot", "isNot", (("ObjectParameter1", "object1"), ("ObjectParameter2", "object2")), (("BoolOutput", "bool"),)),
    ("for", "for", (("IterParameter", "iter"),), (("TargetOutput", "target"),)),
    ("if", "if", (("TestParameter", "test"),), ()),
    ("ifexpr", "ifexpr", (("TestParameter", "test"), ("IfTrueParameter", "trueValue"), ("IfFalseParameter", "falseValue")), (("IfExprOutput", "ifExprResult"),)),
    ("slice", "slice", (("LowerIndexParameter", "lower"), ("UpperIndexParameter", "upper"), ("StepParameter", "step")), (("SliceOutput", "sliceResult"),)),
    ("list", "list", (("Elements", "elements"),), (("ListOutput", "listResult"),)),
    ("tuple", "tuple", (("Elements", "elements"),), (("TupleOutput", "tupleResult"),)),
    ("dict", "dict", (("Pairs", "pairs"),), (("DictOutput", "dictResult"),)),
    ("attribute", "attr", (("ValueParameter", "value"), ("AttributeParameter", "attr")), (("AttributeOutput", "attrResult"), ("AttributeSelfOutput", "self_output"))),
    ("joinstr", "joinstr", (("Delimiter", "self"), ("Strings", "strings")), (("JoinStringOutput", "joinstrResult"),)),
    ("format", "format", (("ValueParameter", "value"), ("ConversionParameter", "conversion"), ("SpecParameter", "spec")), (("FormatOutput", "formatResult"),)),
)
# Name and own parameters of each container function; all but build take and give an image.
CONTAINER = (
    ("build", ("dockerfileInputParam",)), ("from", ()), ("entrypoint", ("entrypointInputCommand", "entrypointInputParamList")), ("user", ()), ("add", ("add_src", "add_dest")), ("label", ("labelKey", "labelVal")),
    ("workdir", ("workdirInput",)), ("arg", ()), ("cmd", ("cmdInputParamList",)), ("run", ("runInputCommand",)), ("env", ("envKey", "envValue")), ("port", ("portValue",)), ("volume", ()), ("copy", ("copySrc", "copyDest")),
    ("maintainer", ()), ("expose", ()),
)


def _function(prefix: str, name: str, label: str, params: tuple, outs: tuple) -> Iterator[tuple]:
    f = f"{prefix}:{name}"
    yield from ((f, "a", "fno:Function"), (f, "rdfs:label", Lit(label)))
    for kind, predicate, terms in (("Parameter", "fno:expects", params), ("Output", "fno:returns", outs)):
        if terms:
            node = f"_:{prefix}{name}{kind}"
            yield from ((f, predicate, node), (node, "a", "rdf:Seq"))
            for n, (term, name_) in enumerate(terms, 1):
                yield from ((node, f"rdf:_{n}", f"{prefix}:{term}"), (f"{prefix}:{term}", "a", f"fno:{kind}"), (f"{prefix}:{term}", "fno:predicate", f"{prefix}:{name_}"))


def rows() -> list[tuple]:
    out = [r for f in CONTROL_FLOW for r in _function("cf", *f)]
    image = (("imageOutputParam", "imageOutput"),)
    for name, own in CONTAINER:
        given = () if name in ("build", "from") else (("imageInputParam", "imageInput"),)
        out += _function("do", name, name, given + tuple((p, p) for p in own), image)
        if name != "build":
            out.append((f"do:{name}", "a", "do:Instruction"))
    return out


def library(spark: SparkSession) -> Graph:
    """The graph of all of them; as small as the tables above."""
    return Graph.of(spark, rows())


def has(uri: str) -> bool:
    from loomflow.functions.terms import expand

    return expand(uri) in {expand(s) for s, p, o in rows() if o == "fno:Function"}
