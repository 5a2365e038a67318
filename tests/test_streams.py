import math

from pyspark.sql import functions as F

from loomflow.operators import frames
from loomflow.streaming import windows


def test_intervals_carry_state_between_batches(spark, tmp_path):
    rows = [(u, i, s) for u in (1, 2) for i, s in enumerate("aabbbacc")]
    schema = "user bigint, ts timestamp, state string"
    df = spark.createDataFrame(rows, "user bigint, i int, state string").select("user", F.timestamp_seconds("i").alias("ts"), "state", "i")
    for n in range(4):
        df.where(F.floor(F.col("i") / 2) == n).drop("i").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.source(spark, str(tmp_path / "in"), schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = windows.to_end(windows.state_intervals(stream, "user", "ts", "state"), str(tmp_path / "ck"))
    got = sorted((r["key"], r["state"], r["n"]) for r in out.collect())
    assert got == sorted((u, s, n) for u in (1, 2) for s, n in (("a", 2), ("b", 3), ("a", 1)))


def test_batches_are_handed_on(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    windows.each_batch(windows.source(spark, str(tmp_path / "in"), "id bigint"), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck"))
    assert seen == [(0, 5), (1, 5), (2, 5)]


def test_late_rows_are_dropped(spark, tmp_path):
    for secs in ([0, 10], [7200, 7210], [7300], [5, 9000]):
        spark.createDataFrame([(s,) for s in secs], "s int").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.source(spark, str(tmp_path / "in"), "ts timestamp")
    out = windows.to_table(windows.time_windows(stream, [], "ts", "1 hour", None, "1 minute", n=F.count("*")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sum(r["n"] for r in out.where(F.col("start") == F.timestamp_seconds(F.lit(0))).collect()) == 2


def test_filter_coefficients():
    """The low-pass has gain 1 at rest and a half in power at its edge."""
    b, a = frames.butterworth(4, None, 5.0, 50.0)
    assert abs(sum(b) / sum(a) - 1) < 1e-9
    z = complex(math.cos(2 * math.pi * 0.1), -math.sin(2 * math.pi * 0.1))
    h = sum(c * z**k for k, c in enumerate(b)) / sum(c * z**k for k, c in enumerate(a))
    assert abs(abs(h) ** 2 - 0.5) < 1e-9
    b, a = frames.butterworth(2, 4.0, 8.0, 64.0)
    assert abs(sum(b)) < 1e-9
