import random
import re

import pytest
from pyspark.sql import functions as F

from loomflow.operators import frames, series
from loomflow.plans import catalog


@pytest.fixture(params=[3, 7, 1 << 16])
def small(request, monkeypatch):
    monkeypatch.setattr(series, "SEGMENT", request.param)
    return request.param


def rows(spark, n=150, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["b", None]
    data = [(rng.choice(keys), rng.randint(0, 3 * n), k, rng.uniform(-5, 5) if rng.random() > 0.1 else None) for k in range(n)]
    return data, spark.createDataFrame(data, "key string, t int, id int, x double").repartition(5)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_places(spark):
    data, df = rows(spark)
    want = {r[2]: k for s in by_key(data).values() for k, r in enumerate(s)}
    assert {r["id"]: r["_i"] for r in series.numbered(df, ["key"], ["t", "id"]).collect()} == want
    want = {r[2]: k for k, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    assert {r["id"]: r["_i"] for r in series.numbered(df, [], ["t", "id"]).collect()} == want
    assert series.numbered(df.limit(0), ["key"], ["t"]).collect() == []


def test_sessions(spark, small):
    data, df = rows(spark)
    want = []
    for key, s in by_key(data).items():
        for r in s:
            if want and want[-1][0] == key and r[1] < want[-1][2] + 4:
                want[-1][2:] = [r[1], want[-1][3] + 1]
            else:
                want.append([key, r[1], r[1], 1])
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = frames.chunks(df, ["key"], "ts", "4 seconds").select("key", F.unix_seconds("start"), F.unix_seconds("end"), "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert frames.chunks(df.limit(0), ["key"], "ts", "4 seconds").collect() == []


def test_one_session_over_all_segments(spark, small):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("ts"))
    assert [(r["n"],) for r in frames.chunks(df, [], "ts", "2 seconds").collect()] == [(100,)]


def test_filter(spark, small):
    data, df = rows(spark)
    for b, a in (frames.butterworth(2, None, 4.0, 32.0), frames.butterworth(2, 2.0, 8.0, 32.0), ([0.5, 0.25], [1.0])):
        want = {}
        for s in by_key(data).values():
            n = max(len(a), len(b)) - 1
            x, y = [0.0] * (n + 1), [0.0] * (n + 1)
            for r in s:
                if r[3] is None:
                    want[r[2]] = None
                    continue
                x = [r[3], *x[:-1]]
                y = [0.0, *y[:-1]]
                y[0] = sum(p * q for p, q in zip(b, x)) - sum(p * q for p, q in zip(a[1:], y[1:]))
                want[r[2]] = y[0]
        got = {r["id"]: r["low"] for r in series.filtered(df, ["key"], ["t", "id"], "x", "low", b, a).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] if want[k] is None else abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gaussian_and_count_windows(spark, small):
    data, df = rows(spark)
    one = {r["id"]: r["s"] for r in frames.gaussian(df, ["key"], ["t", "id"], "x", "s", 1.5).collect()}
    series.SEGMENT, kept = 1 << 20, series.SEGMENT
    try:
        assert one == {r["id"]: r["s"] for r in frames.gaussian(df, ["key"], ["t", "id"], "x", "s", 1.5).collect()}
    finally:
        series.SEGMENT = kept
    got = {(r["key"], r["start"]): r["values"] for r in frames.count_windows(df, ["key"], ["t", "id"], "id", 10, 4).collect()}
    assert got == {(k, i): [r[2] for r in s[i : i + 10]] for k, s in by_key(data).items() for i in range(0, len(s) - 9, 4)}


@pytest.mark.parametrize("name", ["w03_count_windows", "w05_chunks", "w08_gaussian", "w08_lowpass", "t03_stream_sessions"])
def test_no_window_by_the_hot_key_alone(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    for spec in re.findall(r"windowspecdefinition\(([^)]*?)(?: ASC| DESC|, specifiedwindow)", plan):
        assert "_seg" in spec or "event_type" not in spec
    # nor are a key's rows in one task for another reason
    assert not re.search(r"hashpartitioning\(event_type#\d+(?:, \d+)?\)", plan) or name == "t03_stream_sessions"
