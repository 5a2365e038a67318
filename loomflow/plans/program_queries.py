"""Queries of compiled functions over tables, with SQL that spells out Python's meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.plans import compile as plan
from loomflow.plans import graphplan, machine
from loomflow.session import table
from loomflow.sources import describe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns that the programs below take: a and b of both signs, b never zero; n from 0 to 9; x and y floats; s text; bits and xs lists.
_INPUT = """
SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_partkey % 15 - 7 AS a, (CASE WHEN l_suppkey % 9 - 4 = 0 THEN 5 ELSE l_suppkey % 9 - 4 END) AS b,
l_partkey AS p, l_suppkey AS q, l_extendedprice AS x, l_discount + 0.5 AS y, l_returnflag AS s, l_linestatus AS t, l_quantity > 25 AS big, l_tax > 0.04 AS taxed
FROM lineitem"""


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that programs take, of every line."""
    li = table(spark, sf_dir, "lineitem")
    b = F.col("l_suppkey") % 9 - 4
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_partkey") % 15 - 7).alias("a"), F.when(b == 0, F.lit(5)).otherwise(b).cast("long").alias("b"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q"), F.col("l_extendedprice").alias("x"), (F.col("l_discount") + 0.5).alias("y"), F.col("l_returnflag").alias("s"), F.col("l_linestatus").alias("t"),
        (F.col("l_quantity") > 25).alias("big"), (F.col("l_tax") > 0.04).alias("taxed"),
    )


def _row(name: str, source: str, sql: str, *args: str, function: str | None = None, missing: int | None = None) -> None:
    """A program over each line, its value in out; missing stands for None."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _input(spark, sf_dir)
        out = plan.column(rows, source, *args, name=function)
        return rows.select("k", "n", (out if missing is None else F.coalesce(out, F.lit(missing))).alias("out"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH i AS ({_INPUT}) SELECT k, n, {sql} AS out FROM i"


def _fn(expression: str, *names: str) -> str:
    return f"def f({', '.join(names)}):\n    return {expression}\n"


for _name, _expr, _sql, _args in (
    ("x01_add", "a + b", "a + b", "a b"), ("x01_add_text", "s + t", "s || t", "s t"), ("x02_sub", "a - b", "a - b", "a b"), ("x03_mul", "a * b", "a * b", "a b"), ("x03_mul_text", "s * n", "repeat(s, CAST(n AS INT))", "s n"),
    ("x04_truediv", "a / b", "CAST(a AS DOUBLE) / b", "a b"), ("x05_floordiv", "a // b", "CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT)", "a b"), ("x06_mod", "a % b", "((a % b) + b) % b", "a b"),
    ("x07_pow", "a ** 2 + n ** 3", "a * a + n * n * n", "a n"), ("x08_shift", "(p << 3) + (a >> 1)", "p * 8 + CAST(floor(a / 2.0) AS BIGINT)", "p a"), ("x09_bits", "(p | q) + (p ^ q) * 2 + (p & q) * 3", "(p | q) + xor(p, q) * 2 + (p & q) * 3", "p q"),
    ("x10_matmul", "[a, b, n] @ [n, a, b]", "a * n + b * a + n * b", "a b n"), ("x11_unary", "-a + +b + ~p", "-a + b + (-p - 1)", "a b p"), ("x11_not", "not a", "a = 0", "a"),
    ("x12_bool", "big and taxed or a > 0", "(big AND taxed) OR a > 0", "big taxed a"), ("x13_compare", "(a < b) == (a <= n) and a != b", "((a < b) = (a <= n)) AND a <> b", "a b n"), ("x13_none", "a == None", "false", "a"),
    ("x14_in", "a in [b, 0, 3]", "a IN (b, 0, 3)", "a b"), ("x14_not_in_text", "'A' not in s", "s NOT LIKE '%A%'", "s"), ("x15_chain", "b < a < n", "b < a AND a < n", "a b n"), ("x16_is", "(a is None) or (b is not None)", "true", "a b"),
    ("x17_ifexpr", "a if a > b else b", "greatest(a, b)", "a b"), ("x18_constant", "42", "CAST(42 AS BIGINT)", ""), ("x21_list", "len([a, b, n]) + [a, b, n][-1]", "3 + n", "a b n"), ("x22_dict", "{'u': a, 'v': b, 'u': n}['u']", "n", "a b n"),
    ("x23_slice", "[a, b, n, p, q][1:-1][::-1][0]", "p", "a b n p q"), ("x23_slice_text", "(s + t + s + t)[1:3]", "t || s", "s t"), ("x24_getitem", "[a, b, n][n % 3]", "CASE n % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE n END", "a b n"),
    ("x25_joinstr", "f'{s}-{n}:{t}'", "s || '-' || n || ':' || t", "s n t"), ("x26_format", "f'{n:03d}/{y:.2f}'", "printf('%03d', n) || '/' || printf('%.2f', y)", "n y"),
    ("x27_comprehension", "sum([i * a for i in range(n) if i % 2 == 0])", "a * (CASE WHEN n <= 0 THEN 0 ELSE ((n + 1) // 2) * ((n + 1) // 2 - 1) END)", "a n"),
    ("x27_nested", "len([i + j for i in range(n) for j in range(i)])", "n * (n - 1) // 2", "n"), ("x27_dict", "{i % 3: i for i in range(n)}[0]", "((n - 1) // 3) * 3", "n"),
    ("x28_builtins", "abs(a) + max(a, b) + min([a, b, n]) + int('7') + len(s)", "abs(a) + greatest(a, b) + least(a, b, n) + 7 + length(s)", "a b n s"), ("sc13_round", "round(x)", "CAST(round_even(x, 0) AS BIGINT)", "x"),
    ("s05_sorted_text", "''.join(sorted('hello' + s))", "array_to_string(list_sort(string_split('hello' || s, '')), '')", "s"),
):
    _row(_name, _fn(_expr, *_args.split()), _sql, *_args.split())

_row("x19_names", "def g(a):\n    c = a\n    a = c + 1\n    return a * c\n", "(a + 1) * a", "a")
_row("x24_setitem", "def g(a, b):\n    xs = [a, b, 0]\n    xs[2] = xs[0] + xs[1]\n    d = {'k': 1}\n    d['k'] = xs[-1]\n    return d['k']\n", "a + b", "a", "b")
_row("x28_keywords", "def h(a, b=10, *, c=1):\n    return a * b + c\ndef g(a, b):\n    return h(a) + h(b=b, a=a, c=2)\n", "a * 10 + 1 + a * b + 2", "a", "b", function="g")
_row("x29_methods", "def g(s, n):\n    xs = []\n    xs.append(n)\n    xs.append(n + 1)\n    xs.reverse()\n    return s.lower() + str(xs[0])\n", "lower(s) || (n + 1)", "s", "n")
_row("x30_augassign", "def g(a, b):\n    t = a\n    t += b\n    t *= 2\n    return t\n", "(a + b) * 2", "a", "b")
_row("x31_unpack", "def g(a, b):\n    x, (y, z) = a, (b, a + b)\n    return x * 100 + y * 10 + z\n", "a * 100 + b * 10 + a + b", "a", "b")

_row("f01_sequence", "def g(a, b):\n    c = a + b\n    d = c * c\n    return d - a\n", "(a + b) * (a + b) - a", "a", "b")
_row("f02_divide", "def divide(n, d):\n    if d > 0:\n        return n / d\n    else:\n        return 'none'\n", "CASE WHEN b > 0 THEN CAST(CAST(a AS DOUBLE) / b AS VARCHAR) ELSE 'none' END", "a", "b")
_row("f02_binarycount2", "def g(big, taxed):\n    out = 0\n    if big:\n        if taxed:\n            out = 3\n        else:\n            out = 2\n    else:\n        if taxed:\n            out = 1\n    return out\n", "CAST(CASE WHEN big THEN 2 ELSE 0 END + CASE WHEN taxed THEN 1 ELSE 0 END AS BIGINT)", "big", "taxed")
_row("f03_n_sum", "def n_sum(n):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n", "n * (n - 1) // 2", "n")
_row("f03_sum_array", "def g(a, b, n):\n    total = 0\n    for e in [a, b, n]:\n        total += int(e)\n    return total\n", "a + b + n", "a", "b", "n")
_row("f03_binarycount", "def g(a, b, n):\n    count = 0\n    for i, bit in enumerate([a % 2, b % 2, n % 2]):\n        if bit == 1:\n            count = count + 2**i\n    return count\n", "(abs(a) % 2) + 2 * (abs(b) % 2) + 4 * (n % 2)", "a", "b", "n")
_row("f03_filter_list", "def g(a, b, n):\n    kept = []\n    for x in [a, b, n]:\n        if x >= 0:\n            kept.append(x)\n    return len(kept)\n", "CAST((a >= 0)::INT + (b >= 0)::INT + (n >= 0)::INT AS BIGINT)", "a", "b", "n")
_row("f03_nested_loops", "def g(n):\n    total = 0\n    for i in range(n):\n        row = 0\n        for j in range(i):\n            row += j\n        total += row\n    return total\n", "CAST(n * (n - 1) * (n - 2) / 6 AS BIGINT)", "n")
_row("f06_loop_carried", "def g(n):\n    a, b = 0, 1\n    for i in range(n):\n        a, b = b, a + b\n    return a\n", "CAST(list_extract([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55], n + 1) AS BIGINT)", "n")
_row("f07_early_return", "def g(a):\n    if a < 0:\n        return None\n    if a == 0:\n        return 0\n    return a * 2\n", "CASE WHEN a < 0 THEN -999 ELSE a * 2 END", "a", missing=-999)
_row("f09_inlining", "def add(a, b):\n    return a + b\ndef g(a, b, n):\n    return add(a, add(b, n))\n", "a + b + n", "a", "b", "n", function="g")
_row("f15_arguments", "def h(a, *rest, **named):\n    return a + len(rest) + named['z']\ndef g(a, b, n):\n    return h(a, b, n, z=b)\n", "a + 2 + b", "a", "b", "n", function="g")

TRIPLE_SUM = "def simple_sum(a: int, b: int):\n    return a + b\ndef triple_sum(a: int, b: int, c: int):\n    return simple_sum(a, simple_sum(b, c))\n"


def triple_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two described functions, one inlined into the other, over every line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", plan.column(li, TRIPLE_SUM, "l_linenumber", "l_orderkey", "l_suppkey").alias("out"))


QUERIES["f10_triple_sum"] = triple_sum
ORACLE_SQL["f10_triple_sum"] = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) + (l_orderkey + l_suppkey) AS out FROM lineitem"

_FACULTY = "def faculty(n):\n    if n <= 1:\n        return 1\n    return n * faculty(n - 1)\n"


def _faculty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion has no column; run() makes a table of states of it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"))
    return plan.run(li, _FACULTY, "n", into="out", returns="bigint", states=True)


QUERIES["p01_faculty"] = _faculty
ORACLE_SQL["p01_faculty"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(factorial(CAST(l_linenumber AS INT)) AS BIGINT) AS out FROM lineitem"


def _machine(name: str, source: str, sql: str, *args: str) -> None:
    """A program of loops that end by what they meet, or of recursion, over every line, as a table of states."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return machine.run(_input(spark, sf_dir), source, *args, into="out").select("k", "n", "out")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH i AS ({_INPUT}) SELECT k, n, {sql} AS out FROM i"


_machine("f03_while_gcd", "def gcd(p, q):\n    while q != 0:\n        p, q = q, p % q\n    return p\n", "CAST(gcd(p, q) AS BIGINT)", "p", "q")
_machine("f03_break", "def first(a, b, n):\n    for i in range(100):\n        if i * i > n + a * a:\n            break\n        if i == 3:\n            continue\n        b += i\n    else:\n        return -1\n    return b * 1000 + i\n",
    "(b + list_sum(list_filter(range(0, 100), lambda i: i <> 3 AND i * i <= n + a * a))) * 1000 + list_min(list_filter(range(0, 100), lambda i: i * i > n + a * a))", "a", "b", "n")
_machine("f07_return_in_loop", "def root(p):\n    for i in range(p + 2):\n        if i * i >= p:\n            return i\n    return None\n", "CAST(ceil(sqrt(p)) AS BIGINT)", "p")
_machine("p01_fibonacci", "def fib(n):\n    return n if n < 2 else fib(n - 1) + fib(n - 2)\n", "CAST(list_extract([0, 1, 1, 2, 3, 5, 8, 13, 21], n + 1) AS BIGINT)", "n")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop over a list column: the lines of each order."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    source = "def g(parts):\n    even = 0\n    top = 0\n    for p in parts:\n        if p % 2 == 0:\n            even += 1\n        if p > top:\n            top = p\n    return even * 1000000 + top\n"
    return li.select("l_orderkey", plan.column(li, source, "parts").alias("out"))


QUERIES["f03_list_column"] = _lists
ORACLE_SQL["f03_list_column"] = "SELECT l_orderkey, CAST(count(*) FILTER (l_partkey % 2 = 0) * 1000000 + max(l_partkey) AS BIGINT) AS out FROM lineitem GROUP BY 1"


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct column as an object with attributes."""
    rows = _input(spark, sf_dir).select("k", "n", F.struct("a", F.struct("b", "s").alias("inner")).alias("row"))
    return rows.select("k", "n", plan.column(rows, "def g(row):\n    return row.a * row.inner.b + len(row.inner.s)\n", "row").alias("out"))


QUERIES["x20_attribute"] = _attributes
ORACLE_SQL["x20_attribute"] = f"WITH i AS ({_INPUT}) SELECT k, n, a * b + length(s) AS out FROM i"


def _graph(name: str, source: str, args: str, sql: str, function: str) -> None:
    """A described graph, compiled from its calls and edges, over every line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _input(spark, sf_dir)
        graph = describe.describe(source, names=[function]).graph(spark)
        return rows.select("k", "n", graphplan.column(rows, graph, function, *args.split()).alias("out"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH i AS ({_INPUT}) SELECT k, n, {sql} AS out FROM i"


_graph("f10_graph_triple_sum", TRIPLE_SUM, "a b n", "a + b + n", "triple_sum")
_graph("f11_graph_reuse", "def f(a, b):\n    c = a + b\n    return c * c - a\n", "a b", "(a + b) * (a + b) - a", "f")
_graph("f12_graph_n_sum", "def n_sum(n):\n    total = 0\n    for i in range(n):\n        total += i\n    return total\n", "n", "n * (n - 1) // 2", "n_sum")
_graph("f13_graph_strategies", "def f(a, b, n):\n    return [a, b, n][1] + len([a, b])\n", "a b n", "b + 2", "f")
_graph("f14_graph_branch", "def f(a, b):\n    if a > b:\n        return a - b\n    return b * 2\n", "a b", "CASE WHEN a > b THEN a - b ELSE b * 2 END", "f")
_graph("f14_graph_loop_branch", "def f(a, b, n):\n    best = a\n    for x in [b, n]:\n        if x > best:\n            best = x + 0\n    return best\n", "a b n", "greatest(a, b, n)", "f")
_graph("f18_graph_nested", "def f(a, n):\n    total = 0\n    for i in range(n):\n        for j in range(i):\n            total += j * a\n    return total\n", "a n", "CAST(a * (n * (n - 1) * (n - 2) / 6) AS BIGINT)", "f")
