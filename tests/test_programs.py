"""Described programs and compiled functions against Python itself."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomflow.functions.pysem import Unsupported
from loomflow.functions.terms import mint
from loomflow.operators.access import FlowGraph
from loomflow.operators.graph import Lit
from loomflow.plans import compile as plan
from loomflow.sources import containers, describe, readers, turtle

SOURCES = {
    "simple_sum": "def simple_sum(a: int, b: int):\n    return a + b\n",
    "triple_sum": "def simple_sum(a: int, b: int):\n    return a + b\ndef triple_sum(a: int, b: int, c: int):\n    return simple_sum(a, simple_sum(b, c))\n",
    "divide": "def divide(n: int, d: int):\n    if d > 0:\n        return n / d\n    else:\n        return 'none'\n",
    "n_sum": "def n_sum(n: int):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n",
    "binarycount": "def binarycount(bits):\n    count = 0\n    for i, bit in enumerate(bits):\n        if bit == 1:\n            count = count + 2**i\n    return count\n",
    "faculty": "def faculty(n: int):\n    if n <= 1:\n        return 1\n    return n * faculty(n - 1)\n",
}
#: calls, data edges, loop-carried edges, compositions
SHAPES = {"simple_sum": (1, 3, 0, 1), "triple_sum": (3, 8, 0, 2), "divide": (3, 7, 0, 1), "n_sum": (4, 7, 1, 1), "binarycount": (7, 12, 1, 1), "faculty": (5, 10, 0, 1)}


@pytest.mark.parametrize("name", SOURCES)
def test_shape_of_described_programs(name):
    d = describe.describe(SOURCES[name], names=[name])
    flow = [e for c in d.compositions.values() for e in c["flow"]]
    assert (len(d.calls), len(flow), sum(p is not None for *_, p in flow), len(d.compositions)) == SHAPES[name]


def test_uris_carry_the_digest_of_module_package_and_file():
    assert mint("iter", "builtins").endswith("#itere513fb1f")
    assert mint("op_add", "_operator").endswith("#op_add3c3209e3")


PROGRAMS = [
    ("def f(a, b, n):\n    return a // b + a % b - (a - b) * n\n", "abn"),
    ("def f(a, b, n):\n    xs = [a, b, n, a + b]\n    return sum(xs[1:]) + xs[-1] * max(xs) - len(xs[::-1])\n", "abn"),
    ("def f(a, b, n):\n    best = a\n    for x in [b, n, a * b]:\n        if x > best:\n            best = x\n        elif x == best:\n            best += 1\n    return best\n", "abn"),
    ("def f(a, b, n):\n    if a > b and not n < 0:\n        return a\n    if a == b or n > 3:\n        return b * 2\n    return n - 1\n", "abn"),
    ("def f(a, b, n):\n    d = {}\n    for i in range(n % 7):\n        d[i % 3] = i * a\n    return sum([v for v in d.values()]) + b\n", "abn"),
    ("def f(a, b, n):\n    t = 0.5\n    for i in range(abs(n) % 5):\n        t = t * 2 + i\n    return int(t) + a\n", "abn"),
    ("def f(a, b, n):\n    s = ''\n    for c in 'abc':\n        s += c * (n % 3)\n    return s.upper() + f'{a}:{b}'\n", "abn"),
    ("def f(a, b, n):\n    return [x * y for x in range(n % 4) for y in [a, b] if x != 1]\n", "abn"),
]


@pytest.mark.parametrize("source", [p for p, _ in PROGRAMS])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(-50, 50), st.integers(-9, 9).filter(bool), st.integers(-20, 20)), min_size=1, max_size=12))
def test_compiled_equals_python(spark, source, rows):
    space: dict = {}
    exec(source, space)
    df = spark.createDataFrame(rows, "a bigint, b bigint, n bigint")
    got = df.select("a", "b", "n", plan.column(df, source, "a", "b", "n").alias("out")).collect()
    assert [r["out"] for r in got] == [space["f"](*r) for r in rows]


def test_what_has_no_column_runs_as_python(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 9)], "n bigint")
    with pytest.raises(Unsupported):
        plan.column(df, SOURCES["faculty"], "n")
    out = plan.run(df, SOURCES["faculty"], "n", into="out", returns="bigint").collect()
    assert [r["out"] for r in out] == [1, 2, 6, 24, 120, 720, 5040, 40320]


def test_compiled_functions_stay_in_codegen(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"))
    text = df.select(plan.column(df, SOURCES["simple_sum"], "a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text


def test_binding_errors():
    fn = plan.parse("def f(a, b=1, *, c):\n    return a\n")["f"]
    for args, names in (([1, 2, 3], {"c": 1}), ([], {"c": 1}), ([1], {}), ([1], {"c": 1, "z": 2}), ([1], {"a": 1, "c": 1})):
        with pytest.raises(TypeError):
            plan.bind(fn, args, names, lambda d: d)


def test_main_bodies_and_trees_are_described(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "run.py").write_text("import argparse\n" + SOURCES["n_sum"] + "if __name__ == '__main__':\n    p = argparse.ArgumentParser()\n    p.add_argument('--n', type=int)\n    args = p.parse_args()\n    print(n_sum(args.n))\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "Dockerfile").write_text("FROM x\nCMD [\"a\"]\n")
    rows = describe.describe_tree(spark, str(tmp_path))
    assert [r["file"].rpartition("/")[2] for r in rows.where("p = 'error'").collect()] == ["bad.py"]
    graph = FlowGraph(describe.graph_of(rows).triples)
    assert {r["f"].rpartition("#")[2] for r in graph.compositions().collect()} >= {"n_sum", "_"}
    assert graph.ask([("?m", "fnom:mappingMethod", Lit("argparse")), ("?m", "fno:parameterMapping", "?p"), ("?p", "a", "fnom:ArgumentMapping"), ("?p", "fnom:implementationProperty", Lit("--n"))])
    assert len(readers.files(spark, str(tmp_path)).collect()) == 3


def test_defaults_and_required_parameters(spark):
    g = FlowGraph(describe.describe("def f(a, b=2, *rest, c, d=None, **more):\n    return a\n", "m").graph(spark).triples)
    last = lambda x: x.rpartition("Parameter")[2]
    assert [(last(r["parameter"]), r["value"]) for r in g.defaults().orderBy("parameter").collect()] == [("1", "2"), ("4", "None")]
    assert [last(r["parameter"]) for r in g.var_positional().union(g.var_keyword()).collect()] == ["2", "5"]
    required = g.match([("?p", "fno:required", Lit(True))])
    assert sorted(last(r["p"]) for r in required.collect()) == ["0", "3"]


def test_queries_on_a_described_graph(spark):
    g = FlowGraph(describe.describe(SOURCES["divide"], "m", "/src/m.py").graph(spark).triples)
    assert [(r["n"], r["predicate"].rpartition("#")[2]) for r in g.parameters().where(F.endswith("f", F.lit("#divide"))).orderBy("n").collect()] == [(0, "n"), (1, "d")]
    order = {r["call"].rpartition("#")[2]: r for r in g.order().collect()}
    assert order["if_1"]["true"].endswith("op_truediv_1") and order["if_1"]["false"] is None
    assert g.starts().first()["start"].endswith("op_gt_1")
    assert g.exists("ex:divide") and not g.exists("ex:nothing")


def test_ambiguity_is_an_error(spark):
    from loomflow.operators.graph import Graph

    g = FlowGraph(Graph.of(spark, [("ex:a", "fnoc:next", "ex:b"), ("ex:a", "fnoc:next", "ex:c")]).triples)
    with pytest.raises(Exception, match="ambiguous"):
        g.order().collect()


def test_turtle_texts():
    text = '@prefix ex: <http://e#> . # c\nex:a a ex:T ; ex:p [ ex:q "x\\n\\"y" ], 3, 2.5, true ; ex:l ( 1 <http://u> ) .\n_:n ex:d """long "text" """^^ex:t .'
    rows = turtle.parse(text)
    assert ("http://e#a", "http://e#p", "3", "literal", turtle.XSD + "integer") in rows
    assert ("_:b1", "http://e#q", 'x\n"y', "literal", None) in rows
    assert ("_:n", "http://e#d", 'long "text" ', "literal", "http://e#t") in rows
    assert sum(p.endswith("first") for _, p, *_ in rows) == 2


def test_build_files_both_ways(spark):
    text = "# syntax\nFROM a AS b\nrun x \\\n  # inner\n  y\nENTRYPOINT python\nCMD [\"z\"]\n"
    one = [(i, v) for _, i, v in containers.parse(text)]
    df = spark.createDataFrame([("f", text)], "path string, text string")
    two = [(r["inst"], r["value"]) for r in containers.instructions(df).orderBy("ord").collect()]
    assert one[0] == two[0] == ("FROM", "a AS b") and one[-2:] == two[-2:]


def test_csv_and_arrow(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1)
    readers.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "k int, v string", ["x", "y"], header=True, rows=1)
    assert back.columns == ["x", "y"] and back.count() == 1
    readers.write_arrow(df, str(tmp_path / "t.arrow"))
    assert sorted(map(tuple, readers.read_arrow(spark, str(tmp_path / "t.arrow"), "k int, v string").collect())) == [(1, "a"), (2, "b")]


GRAPH_PROGRAMS = [
    ("simple_sum", SOURCES["simple_sum"], lambda a, b, n: (a, b), "a b"),
    ("triple_sum", SOURCES["triple_sum"], lambda a, b, n: (a, b, n), "a b n"),
    ("n_sum", SOURCES["n_sum"], lambda a, b, n: (n,), "n"),
    ("f", "def f(a, b, n):\n    c = a * b\n    if c > n:\n        return c - n\n    return c // b + n\n", lambda a, b, n: (a, b, n), "a b n"),
    ("f", "def f(a, b, n):\n    best = a\n    for x in [b, n, a * b]:\n        if x > best:\n            best = x + 0\n    return best\n", lambda a, b, n: (a, b, n), "a b n"),
    ("f", "def f(a, n):\n    kept = []\n    for i in range(n % 6):\n        if i % 2 == 0:\n            kept.append(i * a)\n    return sum(kept) + len(kept)\n", lambda a, b, n: (a, n), "a n"),
    ("f", "def f(a, n):\n    total = 0\n    for i in range(n % 5):\n        for j in range(i):\n            total += j * a\n    return total\n", lambda a, b, n: (a, n), "a n"),
    ("f", "def f(a, b):\n    return f'{a}-{b}' + str(a if a > b else b)\n", lambda a, b, n: (a, b), "a b"),
]


@pytest.mark.parametrize(("name", "source", "pick", "columns"), GRAPH_PROGRAMS)
def test_graphs_run_as_their_programs(spark, name, source, pick, columns):
    from loomflow.plans import graphplan

    space: dict = {}
    exec(source, space)
    rows = [(a, b, n) for a in (-3, 0, 4, 7) for b in (-2, 1, 5) for n in (-1, 0, 3, 11)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, n bigint")
    graph = describe.describe(source, names=[name]).graph(spark)
    got = df.select("a", "b", "n", graphplan.column(df, graph, name, *columns.split()).alias("out")).collect()
    assert [r["out"] for r in got] == [space[name](*pick(*r)) for r in rows]


def test_a_graph_read_from_turtle_runs(spark, tmp_path):
    from loomflow.plans import graphplan

    turtle.write(describe.describe(SOURCES["binarycount"], names=["binarycount"]).graph(spark), str(tmp_path / "g"))
    df = spark.createDataFrame([([1, 0, 1],), ([],), ([1, 1, 1, 1],)], "bits array<bigint>")
    got = df.select(graphplan.column(df, turtle.read(spark, str(tmp_path / "g")), "binarycount", "bits").alias("out")).collect()
    assert [r["out"] for r in got] == [5, 0, 15]


def test_objects_are_resolved_by_file_module_and_class(tmp_path):
    import math

    import pytest

    from loomflow.plans import resolve

    (tmp_path / "own.py").write_text("class A:\n    @staticmethod\n    def twice(x):\n        return 2 * x\n\n\ndef once(x):\n    return x\n")
    assert resolve.python_object("gcd", "math") is math.gcd
    assert resolve.python_object("once", None, f"file://{tmp_path}/own.py")(3) == 3
    assert resolve.python_object("twice", "own", f"{tmp_path}/own.py", "A")(3) == 6
    assert resolve.python_object("join", "os.path")("a", "b") == "a/b"
    for bad in (("nothing", "math"), ("x", "no.such.module"), ("f", None, "/no/file.py")):
        with pytest.raises(resolve.Unresolved):
            resolve.python_object(*bad)


def test_callables_without_signature_need_a_count():
    import math

    import pytest

    from loomflow.sources import describe

    assert len(describe.describe_callable(math.hypot, 2).functions["hypot"][1]) == 2
    with pytest.raises(ValueError):
        describe.describe_callable(max)
