import os

from pyspark.sql import functions as F

from loomflow.sources import store
from loomflow.sources.flowtables import calls_graph, functions_graph, stored


def rows(graph):
    return sorted(map(tuple, graph.distinct().select("s", "p", "o", "o_kind", "o_dt").collect()), key=str)


def alike(spark, folder, make):
    """The store has what the tables give now, and nothing twice."""
    got = stored(spark, folder, make)
    assert rows(got) == rows(make(spark, folder))
    assert got.triples.count() == len(rows(got))
    return got


def test_overwritten_tables(spark, sf_dir, tmp_path):
    folder = str(tmp_path)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    for n in (10, 200):
        part.where(F.col("p_partkey") <= n).write.mode("overwrite").parquet(f"{folder}/part.parquet")
        labels = alike(spark, folder, functions_graph).triples.where(F.endswith("p", F.lit("#label")) & F.rlike("s", F.lit("part[0-9]+$")))
        assert labels.count() == part.where(F.col("p_partkey") <= n).count() >= 10
    store.drop_stores(spark)


def test_files_that_come_change_and_go(spark, sf_dir, tmp_path, monkeypatch):
    folder = str(tmp_path)
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    orders.where("o_orderkey <= 60").coalesce(1).write.parquet(f"{folder}/orders.parquet")

    def add(df):
        before = set(os.listdir(f"{folder}/lineitem.parquet")) if os.path.isdir(f"{folder}/lineitem.parquet") else set()
        df.coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
        return [f"{folder}/lineitem.parquet/{f}" for f in set(os.listdir(f"{folder}/lineitem.parquet")) - before if f.startswith("part-")]

    some = lines.where("l_orderkey <= 40")
    add(some.where("l_linenumber <= 2"))
    alike(spark, folder, calls_graph)
    known = store._STORES[(spark.sparkContext.applicationId, "calls_graph", folder)]
    # lines of orders that are there already: their calls are made anew
    later = add(some.where("l_linenumber > 2 and l_orderkey <= 20"))
    alike(spark, folder, calls_graph)
    assert [len(s) for s in known.segments] == [2, 1]
    more = add(lines.where("l_orderkey between 50 and 60"))
    alike(spark, folder, calls_graph)
    for file in later:
        os.remove(file)
    alike(spark, folder, calls_graph)
    # nothing changed: nothing is written
    n = known.n
    alike(spark, folder, calls_graph)
    assert known.n == n
    # one file goes and another comes at once; then the segments are written anew
    monkeypatch.setattr(store, "MOST_SEGMENTS", 4)
    for file in more:
        os.remove(file)
    add(lines.where("l_orderkey between 55 and 70"))
    alike(spark, folder, calls_graph)
    assert [len(s) for s in known.segments] == [1, 1]
    store.drop_stores(spark)
    assert not store._STORES


def test_implementations_stay_while_a_part_has_them(spark, tmp_path):
    folder = str(tmp_path)
    row = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    one = spark.createDataFrame([(1, "a", "Brand#1", 3, 1.0), (2, "b", "Brand#2", 4, 1.0)], row).coalesce(1)
    two = spark.createDataFrame([(3, "c", "Brand#2", 5, 1.0), (4, "d", "Brand#3", 6, 1.0)], row).coalesce(1)
    one.write.parquet(f"{folder}/part.parquet")
    first = [f for f in os.listdir(f"{folder}/part.parquet") if f.startswith("part-")]
    alike(spark, folder, functions_graph)
    two.write.mode("append").parquet(f"{folder}/part.parquet")
    alike(spark, folder, functions_graph)
    for f in first:
        os.remove(f"{folder}/part.parquet/{f}")
    got = alike(spark, folder, functions_graph)
    named = got.triples.where(F.endswith("p", F.lit("#name"))).select("o").collect()
    assert sorted(r["o"] for r in named) == ["Brand_2", "Brand_3"]
    store.drop_stores(spark)
