import random
from collections import Counter
from fractions import Fraction

import pytest

from loomflow.llm import mixing

DOCS = "doc_id bigint, source string, part string, rank int"


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choices(["a", "b", "c", None, "-"], [60, 20, 10, 6, 4])[0], "clash", 1) for k in range(900)]
    return spark.createDataFrame(rows + [(None, "a", "", 0), (5, "b", "", 0), (5, "b", "", 0)], DOCS).repartition(3)


def worst_lag(weights, slots):
    """The largest distance of any source from its weight, in blocks, at any of so many slots."""
    whole, total = mixing.shares(weights)
    done, worst, last = [0] * len(whole), 0, -1
    for slot, s, block in mixing.exact_schedule([10**9] * len(whole), weights):
        assert slot == last + 1 and block == done[s]
        last = slot
        done[s] += 1
        worst = max(worst, *(abs(Fraction(n) - Fraction((slot + 1) * w, total)) for n, w in zip(done, whole, strict=True)))
        if slot + 1 == slots:
            return worst


@pytest.mark.parametrize("weights", [[1, 2], [1, 1000], [900**0.5, 400**0.5, 100**0.5, 50**0.5], [0.5] + [0.025] * 20, [0.1, 0.2, 0.7]])
def test_lag_against_the_weights_stays_under_one_block(weights):
    assert worst_lag(weights, 50_000 if len(weights) < 9 else 5000) < 1


@pytest.mark.parametrize("block_rows", [1, 4])
def test_positions_follow_the_weights(spark, block_rows):
    weights = {"a": 0.5, "b": 0.25, "c": 0.125, None: 0.1, "-": 0.025}
    rows = mixing.mix(table(spark), weights, block_rows=block_rows).collect()
    assert sorted(r["position"] for r in rows) == list(range(903))
    counts: Counter = Counter()
    for n, r in enumerate(sorted((r for r in rows if r["balanced"]), key=lambda r: r["position"]), 1):
        counts[r["source"]] += 1
        if n % block_rows == 0:
            assert all(abs(counts[s] / block_rows - n / block_rows * w) < 1 for s, w in weights.items())
    assert sum(counts.values()) > 100
    assert [r["slot"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["slot"] for r in rows)
    assert all(n <= block_rows for n in Counter((r["source"], r["block"]) for r in rows).values())


def test_square_roots_are_the_weights_unless_told(spark):
    sizes = {"a": 900, "b": 400, "c": 100, "d": 50}
    rows = [(k, s) for s, n in sizes.items() for k in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), block_rows=1).where("balanced").orderBy("position").collect()
    total = sum(n**0.5 for n in sizes.values())
    counts: Counter = Counter()
    for n, r in enumerate(got, 1):
        counts[r["source"]] += 1
        assert all(abs(counts[s] - n * sizes[s] ** 0.5 / total) < 1 + 1e-3 for s in sizes)
    assert len(got) > 300


def test_blocks_grow_where_the_schedule_would():
    assert [mixing.rows_of_a_block(n, 16, 100) for n in (0, 1600, 1601, 3200, 3201, 10**6)] == [16, 16, 32, 32, 64, 16384]


def test_ordered_keeps_rows_and_columns(spark):
    df = table(spark)
    out = mixing.ordered(df, "place")
    assert out.columns == [*df.columns, "place"]
    assert sorted(r["place"] for r in out.collect()) == list(range(903))
    assert out.drop("place").exceptAll(df).count() == 0


def test_refusals_and_empty_table(spark):
    with pytest.raises(ValueError):
        mixing.mix(table(spark), {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.shares([1.0, 0.0])
    assert mixing.mix(table(spark).limit(0)).collect() == []


def test_matches_sql(spark, sf_dir):
    import duckdb

    want = duckdb.sql(mixing.ORACLE_SQL.replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).fetchall()
    got = mixing.op10_mixing(spark, sf_dir).select("doc_id", "source", "block", "slot", "position").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_schedule_follows_the_true_weights():
    rng = random.Random(4)
    for k in (2, 20, 25, 60):
        weights = [rng.random() ** 3 + 1e-3 for _ in range(k)]
        blocks = [int(6000 * w / sum(weights)) + 1 for w in weights]
        done, last = [0] * k, -1
        for slot, s, block in mixing.exact_schedule(blocks, weights):
            if any(n == full for n, full in zip(done, blocks, strict=True)):
                break
            assert slot == last + 1 and block == done[s]
            last = slot
            done[s] += 1
            assert all(abs(n - (slot + 1) * w / sum(weights)) < 1 + 1e-9 for n, w in zip(done, weights, strict=True))
        assert last > 900


def test_mixed_shares_follow_the_true_weights(spark):
    # one source of a half among 20, of which a cycle of 100 slots gives 41
    weights = {"big": 0.5} | {f"s{k}": 0.5 / 19 for k in range(19)}
    rows = [(k, "big") for k in range(800)] + [(1000 + k, f"s{k % 19}") for k in range(19 * 45)]
    rows = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_rows=2).collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    balanced = sorted((r for r in rows if r["balanced"]), key=lambda r: r["position"])
    counts: Counter = Counter()
    for n, r in enumerate(balanced, 1):
        counts[r["source"]] += 1
        if n % 2 == 0:
            assert all(abs(counts[s] / 2 - n / 2 * w) < 1 + 1e-9 for s, w in weights.items())
    assert len(balanced) > 1000
