import random

import numpy as np

from loomflow.llm import simhash
from tests.llm import brute

DOCS = "doc_id bigint, text string, fp string"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 300))) for _ in range(12)]
    rows = [(None if k == 3 else "" if k == 4 else " \n" if k == 5 else "One Two" if k == 6 else "one two") for k in range(3, 8)]
    for _ in range(150):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append(" ".join(text))
    rows += [rows[-1], rows[10].upper(), "x" * 100_000]
    return list(enumerate(rows))


def test_groups_match_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], DOCS).repartition(5)
    found = simhash.groups(df).collect()
    got = {(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found}
    assert got == brute.simhash_groups(docs)
    assert len({c for *_, c in got}) < len(got)


def test_index_finds_every_pair():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for _ in range(600):
        x = int(rng.choice(centre))
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(k)
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    got = set()
    for spans in simhash._choices(simhash.BLOCKS, 2):
        for a, b in simhash.GrayIndex(simhash._led(fps, spans), sum(bits for _, bits in spans[:4])).pairs(2):
            got |= {(max(p), min(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want


def test_gray_rank_orders_the_code():
    code = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(code ^ (code >> np.uint64(1))) == code).all()


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d", ""), (1, "a b c d", ""), (None, "a b c d", ""), (None, "q r s t u", ""), (7, "q r s t u v", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect()]
    assert sorted(got, key=str)[:2] == [(1, 1), (1, 1)] and (None, 1) in got
    assert simhash.groups(df.limit(0)).collect() == []
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 1
    # rows without an id stay where their group has no other: none is dropped for the lack of an id
    assert kept.count() == 3
    alone = spark.createDataFrame([(None, "a b c d", ""), (None, "q r s t u", ""), (None, "q r s t u", "")], DOCS)
    assert sorted(r["text"] for r in simhash.keep_one(alone).collect()) == ["a b c d", "q r s t u"]
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_keep_one_keeps_the_smallest_id(spark):
    docs = corpus(2)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == {c for *_, c in brute.simhash_groups(docs)}
