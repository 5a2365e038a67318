import math
import zlib
from collections import Counter

import xxhash

from loomflow.llm import shards

DOCS = "doc_id bigint, text string, shard string, part int"


def table(spark, n=800):
    rows = [(k, f"text {k % 50}", "clash", 1) for k in range(n)]
    return spark.createDataFrame(rows + [(None, "a", "", 0), (None, None, "", 0), (3, "text 3", "", 0), (3, "text 3", "", 0)], DOCS)


def rows_of(spark, **extra):
    return shards.assign(table(spark), shards.tree(16), shards.tree(17)).collect()


def test_sizes_checksums_and_slots(spark):
    rows = rows_of(spark)
    assert len(rows) == 804
    for r in rows:
        if r["doc_id"] is not None:
            text = f"text {r['doc_id'] % 50}".encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = rows_of(spark)
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 20 <= len(moved) <= 80
    assert len({(r["shard"], r["grown_shard"]) for r in rows if r["doc_id"] == 3}) == 1


def test_descent_matches_brute_force(spark):
    def draw(key, name, weight):
        # the two values are hashed in turn, the first hash being the seed of the second
        h = xxhash.xxh64(name.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    tree = [shards.Shard(0, 0, 0, 2.0), shards.Shard(0, 0, 1), shards.Shard(0, 1, 2), shards.Shard(1, 0, 3, 0.5), shards.Shard(2, 0, 4, 0.0)]
    got = {r["doc_id"]: r["shard"] for r in shards.assign(table(spark), tree).collect() if r["doc_id"] is not None}
    for key, shard in got.items():
        region = min(({0: 4.0, 1: 0.5}).items(), key=lambda x: draw(str(key), f"/{x[0]}", x[1]))[0]
        rack = min(({0: {0: 3.0, 1: 1.0}, 1: {0: 0.5}})[region].items(), key=lambda x: draw(str(key), f"/{region}/{x[0]}", x[1]))[0]
        below = {(0, 0): {0: 2.0, 1: 1.0}, (0, 1): {2: 1.0}, (1, 0): {3: 0.5}}[region, rack]
        assert shard == min(below.items(), key=lambda x: draw(str(key), f"/{region}/{rack}/{x[0]}", x[1]))[0]
    assert Counter(got.values())[0] > Counter(got.values())[3] > 0


def test_weight_changes_stay_in_their_subtrees(spark):
    before, after = shards.tree(16), [shards.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in shards.tree(16)]
    one, two = ({r["doc_id"]: r["shard"] for r in shards.assign(table(spark), t).collect()} for t in (before, after))
    assert all(two[k] // 4 == 1 for k in one if one[k] != two[k])


def test_empty_table(spark):
    assert shards.assign(table(spark).limit(0), shards.tree(16), shards.tree(17)).collect() == []
