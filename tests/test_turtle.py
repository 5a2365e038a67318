import random

import pytest

from loomflow.operators.graph import Graph
from loomflow.sources import turtle


def text(seed=1, n=60):
    """Statements of every form, over several lines, with marks inside texts."""
    rng = random.Random(seed)
    out = ["@prefix e: <http://e#> .", "# a comment. with marks ; \" and \"\"\"", "@prefix f: <http://f#one.two> ."]
    for k in range(n):
        s = f"e:s{k}"
        out.append(
            rng.choice(
                [
                    f"{s} e:p e:o{k} .",
                    f"{s} e:p {k} , {k}.5 ;\n    f:q \"a. \\\" b # c\" ;\n\n  # in between .\n    f:r true .",
                    f'{s} e:long """first .\nsecond "quoted" . @prefix e: <http://no#> .\n\n{k}""" , """one line {k}""" .',
                    f"{s} e:list ( e:a \"b.\" [ e:p {k} ] )\n.",
                    f"[ e:p \"x\"@en ] e:q _:named{k % 5} . _:named{k % 5} e:back {s} .",
                    f'{s} e:two """\n@prefix f: <http://wrong#> .\n""" . {s} e:more e:z.',
                ]
            )
        )
        if k == n // 2:
            out.append("@prefix f: <http://f#later> .")
    return "\n".join(out) + "\n# the end"


def shape(rows):
    """Triples without the names of blank nodes: how often each stands there, with what is known of a blank node."""
    about: dict = {}
    for s, p, o, *_ in rows:
        if s.startswith("_:"):
            about.setdefault(s, []).append((p, "" if o.startswith("_:") else o))
    name = lambda x: str(sorted(about.get(x, []))) if x.startswith("_:") else x
    return sorted((name(s), p, name(o), kind, str(dt)) for s, p, o, kind, dt in rows)


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_ranges_give_the_same_triples(spark, tmp_path, size):
    for k in range(2):
        (tmp_path / f"g{k}.ttl").write_text(text(k))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        got = [tuple(r) for r in turtle.read(spark, str(tmp_path)).triples.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    want = list(dict.fromkeys(r for k in range(2) for r in turtle.parse(text(k), f"n{k}")))
    assert shape(got) == shape(want)
    assert any("http://f#later" in p for _, p, *_ in got) and any(p == "http://f#one.twoq" for _, p, *_ in got)
    # named blank nodes are one in a file, and another in another file
    assert len({o for _, p, o, *_ in got if o.startswith("_:") and "named" in o}) == len({o for k in range(2) for _, _, o, *_ in turtle.parse(text(k), f"n{k}") if "named" in o})


def test_round_trip_and_errors(spark, tmp_path):
    g = Graph.of(spark, [("ex:a", "ex:p", "ex:b"), ("ex:a", "ex:q", "_:x")])
    turtle.write(g, str(tmp_path / "g"))
    assert len(turtle.read(spark, str(tmp_path / "g")).triples.collect()) == 2
    (tmp_path / "bad.ttl").write_text("<a> <b> <c> . <d> <e>")
    with pytest.raises(Exception, match="expected"):
        turtle.read(spark, str(tmp_path / "bad.ttl")).triples.collect()
    (tmp_path / "none.ttl").write_text("")
    assert turtle.read(spark, str(tmp_path / "none.ttl")).triples.collect() == []
