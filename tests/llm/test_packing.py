import random
import zlib

import numpy as np
import pytest

from loomflow.llm import packing

DOCS = "doc_id bigint, text string, pid int, part string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def corpus():
    rng = random.Random(1)
    words = ["alpha", "Größe", "l'été", "日本", "x1", "don't", "...", "\t", "<|endoftext|>", "🙂"]
    docs = [None, "", "   \n\n ", "a" * 9000, " ".join(rng.choices(words, k=6000))]
    docs += [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(80)]
    return list(enumerate(docs))


def test_ids_are_those_of_the_tokenizers_library(tokenizer):
    for _, text in corpus():
        ids = packing.token_ids(text or "", packing.vocabulary_path())
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    assert packing.token_ids("a <|endoftext|> b", packing.vocabulary_path()).tolist() == [64, 220, 50256, 275, 0]


def test_packs_every_token_once(spark, tokenizer):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0, "clash", 0) for d, t in docs] + [(None, "x", 0, "", 0), (7, docs[7][1], 0, "", 0)], DOCS).repartition(3)
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in [*docs, (None, "x")]}
    for carry in ("ids", "ids_crc32"):
        rows = packing.pack(df, carry=carry, partition_rows=20).collect()
        at: dict = {}
        for r in rows:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert (r["ids_crc32"] == zlib.crc32(part.tobytes())) if carry == "ids_crc32" else r["ids"] == part.tolist()
            at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert r["part_bound"] <= r["part_bins"]
        assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(ids[7])
        for places in at.values():
            places.sort()
            assert [p for p, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
            assert sum(n for _, n in places) <= 2048
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert len(long) > 2 and all(n == 2048 for *_, n in long[1:])
    assert packing.pack(df.limit(0)).collect() == []


def brute_bins(items, capacity):
    best = [len(items)]

    def place(k, free):
        if len(free) >= best[0]:
            return
        if k == len(items):
            best[0] = len(free)
            return
        for i, f in enumerate(free):
            if f >= items[k] and f not in free[:i]:
                place(k + 1, [*free[:i], f - items[k], *free[i + 1 :]])
        place(k + 1, [*free, capacity - items[k]])

    place(0, [])
    return best[0]


def test_bounds_hold_and_bins_fit():
    rng = random.Random(3)
    met = 0
    for _ in range(300):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        least = brute_bins(items, 20)
        bins = packing.best_fit_decreasing(np.array(items), 20)
        bound = packing.lower_bound(np.array(items), 20)
        assert bound <= least <= bins.max() + 1
        assert all(sum(x for x, b in zip(items, bins, strict=True) if b == k) <= 20 for k in range(bins.max() + 1))
        met += bound == least
    assert met > 250


def test_exchanges_never_add_sequences(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, "a b " * rng.randint(150, 480), 0, "", 0) for k in range(400)], DOCS)
    count = [packing.pack(df, carry="ids_crc32", partition_rows=25, exchanges=n).select("sequence_id").distinct().count() for n in (0, 3)]
    assert count[1] <= count[0]
