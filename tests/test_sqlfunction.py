import pytest

from loomflow.functions.pysem import Unsupported
from loomflow.plans import catalog, sqlfunction


def test_functions_are_inlined(spark):
    name = sqlfunction.create(spark, "def f(a, b):\n    if a > b:\n        return a - b\n    return b * 2 + a // 3\n", "f", {"a": "bigint", "b": "int"}, "branch")
    out = spark.sql(f"SELECT {name}(id, 3) AS x FROM range(8)")
    assert [r["x"] for r in out.collect()] == [a - 3 if a > 3 else 6 + a // 3 for a in range(8)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "branch" not in plan and "Python" not in plan
    sqlfunction.create(spark, "def f(s, t):\n    return s.upper() + t[0:2]\n", "f", {"s": "string", "t": "string"}, "branch")
    assert spark.sql("SELECT branch('ab', 'xyz') AS x").first()["x"] == "ABxy"


def test_what_sql_cannot_say(spark):
    with pytest.raises(Unsupported):
        sqlfunction.create(spark, "def f(n):\n    t = 0\n    for i in range(n):\n        t += i * t\n    return t\n", "f", {"n": "bigint"})
    with pytest.raises(Unsupported):
        sqlfunction.create(spark, "def f(n):\n    return n\n", "f", {"n": "bigint"}, "f; DROP TABLE x")


def test_no_python_in_the_query(spark, sf_dir):
    for name in ("p03_sql_function", "p03_own_backend", "p01_faculty", "f03_while_gcd"):
        assert "Python" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
