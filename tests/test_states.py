"""States that rows share."""

from loomflow.plans import machine


def test_rows_of_equal_arguments_share_a_state(spark, monkeypatch):
    states = []
    run = machine._run
    monkeypatch.setattr(machine, "_run", lambda df, *a, **k: states.append(df.count()) or run(df, *a, **k))
    source = "def root(p):\n    for i in range(p + 2):\n        if i * i >= p:\n            return i\n    return None\n"
    rows = spark.range(300).selectExpr("id AS k", "CASE WHEN id % 4 < 3 THEN (id % 4) * (id % 4) * 100 END AS p", "id AS _a0")
    got = machine.run(rows.where("p is not null"), source, "p", into="out").collect()
    assert states == [3]
    assert sorted((r["k"], r["_a0"], r["out"]) for r in got) == [(k, k, k % 4 * 10) for k in range(300) if k % 4 < 3]


def test_doubles_that_count_as_equal_are_told_apart(spark):
    source = "def g(x):\n    while x > 5:\n        x = x - 1\n    return str(x)\n"
    rows = spark.sql("SELECT * FROM VALUES (1, 0.0D), (2, double('-0.0')) v(k, x)")
    assert {r["k"]: r["out"] for r in machine.run(rows, source, "x", into="out").collect()} == {1: "0.0", 2: "-0.0"}
