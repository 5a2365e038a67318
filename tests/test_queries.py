"""Every registered query of the engine against its SQL on DuckDB."""

import math

import duckdb
import pytest

from loomflow.plans import catalog, system_queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def plain(v):
    """A value that sorts and compares alike from either engine."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(system_queries.FIXED))
def test_rows_of_described_programs(spark, duck, sf_dir, name):
    make, sql = system_queries.FIXED[name]
    matches(make(spark, sf_dir), duck.execute(sql))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    matches(catalog.QUERIES[name](spark, sf_dir), duck.execute(catalog.ORACLE_SQL[name]))


def matches(df, result):
    got = df.collect()
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_every_query_reads_a_table(spark, tmp_path):
    """With tables missing every query fails, as it builds its plan or runs it."""
    for name, query in sorted(catalog.QUERIES.items()):
        with pytest.raises(Exception):
            query(spark, str(tmp_path / "nothing")).collect()
