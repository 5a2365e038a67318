import random

import numpy as np
import pytest

import corpus_pipeline
from loomflow.llm import shingles
from loomflow.llm.simhash import GrayIndex
from tests.llm import brute

DOCS = "doc_id bigint, text string, node string, hash int"


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=rng.randint(60, 300)) for _ in range(10)]
    rows = [None, "", " \n", "one two", "One  Two", "one two three"]
    for _ in range(160):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, len(text) // 25)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append(" ".join(text))
    return list(enumerate(rows + [rows[-1], rows[20].upper()]))


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(docs):
    grams = {d: brute_shingles(t) for d, t in docs}
    ids = sorted(grams)

    def linked(a, b):
        return 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])

    return brute.components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if linked(a, b)])


@pytest.mark.parametrize("group", [8, 1 << 16])
def test_stage_matches_brute_force_similarity(spark, sf_dir, monkeypatch, group):
    monkeypatch.setattr(shingles, "GROUP", group)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, df, sf_dir)
    assert kept.columns == df.columns
    want = set(brute_groups(docs).values())
    assert {r["doc_id"] for r in kept.collect()} == want and 10 < len(want) < len(docs)


def test_stage_finds_near_copies_of_the_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in rows.where("length(text) < 3000").limit(600).collect()]
    kept = shingles.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(brute_groups(docs).values())


@pytest.mark.parametrize("crowd", [2, 256])
def test_stage_loses_nothing_that_bands_and_bits_miss(spark, monkeypatch, crowd):
    """With bands of which no two texts share one, and with no bit that may differ, the groups are the same."""
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "CROWD_PART", 16)
    monkeypatch.setattr(shingles, "SAMPLE", 3)
    docs = corpus(seed=7)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = set(brute_groups(docs).values())

    def kept():
        return {r["doc_id"] for r in shingles.keep_one(df).collect()}

    if crowd > 2:
        missing = shingles.members(df, bits=0)
        assert missing.select("component").distinct().count() == len(want)
    monkeypatch.setattr(shingles, "bands", lambda grams: grams[:1] + grams.sum())
    assert kept() == want and 10 < len(want) < len(docs)


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, rng.integers(0, len(both) // 6 + 2), dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, x])) for x in own)
        if shingles.similar(a, b, 0.8):
            for frequent in (np.zeros(0, np.uint64), np.sort(both[::2]), np.unique(np.concatenate([own[0], both[::3]]))):
                firsts = [shingles.first_shingles(x, frequent, 0.8) for x in (a, b)]
                assert len(np.intersect1d(*firsts)) > 0


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (None, "q r", "", 0), (3, "q r s", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r["text"] for r in shingles.keep_one(df).collect())) == ["a b c d e f", "q r", "q r s"]
    assert shingles.keep_one(df.limit(0)).collect() == []


def test_index_leaves_out_pairs_of_one_set():
    rng = random.Random(5)
    n = 500
    fps = np.array([rng.getrandbits(6) << 58 | rng.getrandbits(8) for _ in range(n)], np.uint64)
    keys = np.array([rng.randrange(4) - 2 for _ in range(n)])
    sets = np.array([rng.randrange(6) for _ in range(n)])
    got = [(min(p), max(p)) for a, b in GrayIndex(fps, keys=keys, sets=sets).pairs(3) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if keys[i] == keys[j] and sets[i] != sets[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(6)
    for n in (0, 1, 30, 3000):
        for overlap in (0.0, 0.5, 1.0):
            both = rng.integers(0, 1 << 63, int(n * overlap), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            maps = [shingles.bitmap(x).view(np.uint64)[None] for x in (a, b)]
            most = int(shingles.most_shared(*maps, np.array([len(a)]), np.array([len(b)]))[0])
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b)) and (n != 30 or most <= len(both) + 3)
