import math

import pytest

from loomflow.functions.pysem import Unsupported
from loomflow.plans import compile as plan
from loomflow.plans import machine

PROGRAMS = {
    "collatz": "def f(a, b):\n    steps = 0\n    n = abs(a) + 1\n    while n > 1:\n        if n % 2 == 0:\n            n = n // 2\n        else:\n            n = 3 * n + 1\n        steps += 1\n    return steps\n",
    "nested": "def f(a, b):\n    out = []\n    for i in range(abs(a)):\n        j = 0\n        while True:\n            j += 1\n            if j > b:\n                break\n            if j == 2:\n                continue\n            out.append(i * j)\n        if len(out) > 6:\n            return len(out)\n    else:\n        out.append(7)\n    return sum(out)\n",
    "faculty": "def f(a, b):\n    if a <= 1:\n        return 1\n    return a * f(a - 1, b)\n",
    "ackermann": "def f(m, n):\n    m = abs(m) % 3\n    n = abs(n) % 3\n    return g(m, n)\ndef g(m, n):\n    if m == 0:\n        return n + 1\n    if n == 0:\n        return g(m - 1, 1)\n    return g(m - 1, g(m, n - 1))\n",
    "mutual": "def even(n):\n    if n == 0:\n        return True\n    return odd(n=n - 1)\ndef odd(n, k=1):\n    if n == 0:\n        return False\n    return even(n - k)\ndef f(a, b):\n    return even(abs(a))\n",
    "none": "def f(a, b):\n    while a > 0:\n        a -= 1\n        if a == b:\n            return a\n",
    "text": "def f(a, b):\n    s = ''\n    while len(s) < abs(a):\n        s += str(b)\n    return s\n",
    "float": "def f(a, b):\n    x = 0\n    while x < a:\n        x = x + b / 2 + 0.5 if b > 0 else x + 1\n    return x\n",
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_states_do_as_python_does(spark, monkeypatch, name):
    monkeypatch.setattr(machine, "FIRST_STEPS", 8)
    source, space = PROGRAMS[name], {}
    exec(source, space)
    rows = [(a, b) for a in (-3, 0, 1, 2, 5, 6) for b in (0, 1, 3)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(3)
    out = machine.run(df, source, "a", "b", into="out", name="f")
    assert {(r["a"], r["b"]): r["out"] for r in out.collect()} == {r: space["f"](*r) for r in rows}
    assert "Python" not in out._jdf.queryExecution().toString()
    assert machine.run(df.limit(0), source, "a", "b", into="out", name="f").collect() == []


def test_endless_programs_and_what_blocks_cannot_say(spark, monkeypatch):
    df = spark.createDataFrame([(1,)], "a bigint")
    monkeypatch.setattr(machine, "MOST_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        machine.run(df, "def f(a):\n    while True:\n        a += 1\n", "a", into="out")
    with pytest.raises(Unsupported):
        machine.run(df, "def f(a):\n    return a > 0 and f(a - 1)\n", "a", into="out")
    # run() goes on to Python for those
    assert plan.run(df, "def f(a):\n    return a > 0 and f(a - 1)\n", "a", into="out", returns="boolean", states=True).first()["out"] is False
    out = plan.run(df, PROGRAMS["faculty"].replace(", b", ""), "a", into="out", returns="bigint", states=True)
    assert out.first()["out"] == 1 and "Python" not in out._jdf.queryExecution().toString()


WAITING = {
    "root": "def f(a, b):\n    for i in range(a + 2):\n        if i * i >= a:\n            return i\n    return None\n",
    "break": "def f(a, b):\n    for i in range(b, a):\n        if b - i * 3 < -a:\n            break\n    else:\n        i = -5\n    return i\n",
    "two": "def f(a, b):\n    for i in range(1, a):\n        if i * i * i > a and i + b >= 7:\n            return i\n        if 2 * i >= a - b:\n            return -i\n    return b\n",
    # goes on after the test first holds
    "some": "def f(a, b):\n    n = 0\n    for i in range(a):\n        if i >= a - 5:\n            n += i\n    for j in range(a):\n        if j * b > 4 and j + 3 >= a:\n            return n * 10 + j\n    return n\n",
    # factors below zero, products that fall, tests that end: stepped number by number
    "below": "def f(a, b):\n    for i in range(-3, 6):\n        if i * i >= a - 2:\n            return i\n    return 99\n",
    "falls": "def f(a, b):\n    for i in range(6):\n        if i * -b >= -a or i == 4:\n            return i\n    return 99\n",
    "bools": "def f(a, b):\n    big = a > 2\n    for i in range(4):\n        if i * i >= a + big:\n            return i\n    return 99\n",
}


@pytest.mark.parametrize("name", WAITING)
def test_loops_that_wait_do_as_python_does(spark, name):
    space = {}
    exec(WAITING[name], space)
    rows = [(a, b) for a in (-3, 0, 1, 2, 5, 9, 10, 200) for b in (-2, 0, 1, 3)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    want = {r: space["f"](*r) if name != "break" or r[0] > r[1] else -5 for r in rows}
    assert {(r["a"], r["b"]): r["out"] for r in machine.run(df, WAITING[name], "a", "b", into="out").collect()} == want


def test_loops_that_wait_take_few_steps(spark, monkeypatch):
    """As many as there are halvings, up to numbers whose squares do not fit."""
    monkeypatch.setattr(machine, "MOST_ROUNDS", 1)
    tops = (0, 1, 15, 16, 17, 10**12, 10**16 + 1, 2**62)
    df = spark.createDataFrame([(a, 0) for a in tops], "a bigint, b bigint")
    got = {r["a"]: r["out"] for r in machine.run(df, WAITING["root"], "a", "b", into="out").collect()}
    assert got == {a: math.isqrt(a - 1) + 1 if a else 0 for a in tops}


def test_what_does_not_fit_fails_where_the_loop_comes_to_it(spark, monkeypatch):
    monkeypatch.setattr(machine, "MOST_ROUNDS", 1)
    source = "def f(a):\n    for i in range(3000000000, 4000000000):\n        if i * i - a >= 9000000000000000009:\n            return i\n"
    df = spark.createDataFrame([(9,), (10**18,)], "a bigint")
    assert machine.run(df.where("a = 9"), source, "a", into="out").first()["out"] == 3 * 10**9 + 1
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        machine.run(df, source, "a", into="out").collect()


def test_results_of_many_arguments_are_not_broadcast(spark, monkeypatch):
    df = spark.range(50).selectExpr("id AS a", "id AS b")
    plan_of = lambda: machine.run(df, WAITING["root"], "a", "b", into="out")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan_of()
    monkeypatch.setattr(machine, "MOST_TOLD", 49)
    assert "Broadcast" not in plan_of()
