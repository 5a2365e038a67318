import pyarrow as pa
import pytest

from loomflow.sources import arrow
from loomflow.streaming import windows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def file(folder, name, batches):
    schema = pa.schema([("k", pa.int32()), ("v", pa.string()), ("w", pa.float64())])
    with pa.OSFile(str(folder / name), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for ks in batches:
            writer.write_batch(pa.record_batch([pa.array(ks, pa.int32()), pa.array([None if k % 5 == 0 else f"v{k}" for k in ks]), pa.array([k / 2 for k in ks])], schema=schema))


def test_a_task_for_each_batch(spark, folder):
    file(folder, "a.arrow", [[1, 2], [3], []])
    file(folder, "b.arrow", [[5]])
    (folder / "_temporary.arrow").write_bytes(b"not read")
    df = arrow.read(spark, str(folder))
    assert df.dtypes == [("k", "int"), ("v", "string"), ("w", "double")]
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "v1", 0.5), (2, "v2", 1.0), (3, "v3", 1.5), (5, None, 2.5)]
    # other columns, in another order, of another type, and one that is not there
    other = arrow.read(spark, f"file://{folder}/a.arrow", "w double, k bigint, x string")
    assert sorted(map(tuple, other.collect())) == [(0.5, 1, None), (1.0, 2, None), (1.5, 3, None)]


def test_written_by_tasks(spark, folder):
    df = spark.range(100, numPartitions=5).selectExpr("id", "cast(id as string) as name", "array(id) as list", "timestamp_seconds(id) as at")
    path = str(folder / "out")
    arrow.write(df, path)
    assert len([f for f in (folder / "out").iterdir() if f.name.endswith(".arrow")]) == 5
    arrow.write(df.where("id < 0"), path)
    key = lambda r: r["id"]
    assert sorted(arrow.read(spark, path).collect(), key=key) == sorted(df.collect(), key=key)
    arrow.write(df.limit(3), path, "overwrite")
    assert arrow.read(spark, path).count() == 3


def test_stream_goes_on_from_a_batch(spark, folder, tmp_path):
    file(folder, "1.arrow", [[1], [2]])
    run = lambda: windows.to_table(arrow.stream(spark, str(folder), "k int, v string"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["k"] for r in run().collect()) == [1, 2]
    file(folder, "2.arrow", [[3, 4]])
    file(folder, "3.arrow", [[6], [7], [8]])
    assert sorted(r["k"] for r in run().collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert sorted(r["k"] for r in run().collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_no_files(spark, folder):
    assert arrow.read(spark, str(folder), "k int").collect() == []
    with pytest.raises(Exception, match="FileNotFound|in"):
        arrow.read(spark, str(folder / "nothing")).collect()
