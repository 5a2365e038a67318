"""Texts of a million characters and more, whole, against plain versions."""

import hashlib
import random
import zlib

import pytest

import xxhash

from loomflow.llm import collocations, lines, media, mixing, packing, shards, shingles, simhash, substrings, suffixes, toxicity
from tests.llm import brute
from tests.llm.test_collocations import plain as plain_phrases

DOCS = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = [f"word{k}" for k in range(5000)]
    passage = rng.choices(words, k=300)
    long = rng.choices(words, k=150_000)
    long[100_000:100_300] = passage
    long[140_000:140_300] = passage
    return [" ".join(long), " ".join(rng.choices(words, k=40) + passage), "\n".join(" ".join(long[k : k + 9]) for k in range(0, 9000, 9)), "x" * 1_500_000, "x" * 1_499_999 + "y", ""]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], DOCS)


def test_substrings(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substrings.dedup(docs).collect()}
    assert got == brute.substrings(list(enumerate(texts)))
    assert got[1][1] >= 300


def test_lines(docs, texts):
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs, exact_chars=1).collect()}
    # the one-letter difference of two lines of 1.5 million letters is a link
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: texts[3], 4: "", 5: ""}


def test_toxicity(spark, docs):
    rows = [(100 + k, "vile words here" if k % 2 else "kind words here") for k in range(60)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    more = more.union(spark.createDataFrame([(9, "kind " * 300_000 + "vile")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(more, labels).collect()}
    # the last word of a long text counts
    assert len(got) == 67 and got[101] > got[9] > got[100]


def test_sharding(docs, texts):
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shards.assign(docs, shards.tree(4)).collect()}
    assert got == {k: (len(t) + 1, zlib.crc32(t.encode())) for k, t in enumerate(texts)}


def test_near_copies_mixing_and_packing(docs, texts):
    kept = shingles.keep_one(docs)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(6))
    placed = mixing.ordered(kept, "place")
    packed = packing.pack(placed, position_col="place").select("doc_id", "piece", "ids").collect()
    for k in (0, 2, 5):
        ids = [i for r in sorted(packed, key=lambda r: r["piece"]) if r["doc_id"] == k for i in r["ids"]]
        assert ids == packing.token_ids(texts[k], packing.vocabulary_path()).tolist()
    assert all(len(r["ids"]) <= packing.CAPACITY for r in packed)


def test_media(docs, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in media.digest(media.store(docs)).collect()}
    assert got == {k: (len(t.encode()), hashlib.sha256(media.pad(t.encode())).hexdigest()) for k, t in enumerate(texts)}


def test_simhash(docs, texts):
    got = {(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.groups(docs).select("doc_id", "fp", "component_id").collect()}
    assert got == brute.simhash_groups(list(enumerate(texts)))


def test_suffix_arrays(docs, texts):
    window, seen = suffixes.WINDOW, {}
    every = [t.encode() for t in texts]
    # windows by 128-bit hashes; runs of one letter apart, which would take every window of three million
    for b in every[:3]:
        for k in range(len(b) - window + 1):
            h = xxhash.xxh3_128_intdigest(b[k : k + window])
            seen[h] = seen.get(h, 0) + 1
    want = {3: b"", 4: b"y", 5: b""}
    for n, b in enumerate(every[:3]):
        last, kept = -1, bytearray()
        for k in range(len(b)):
            if k + window <= len(b) and seen[xxhash.xxh3_128_intdigest(b[k : k + window])] > 1:
                last = k + window
            if k >= last:
                kept.append(b[k])
        want[n] = bytes(kept)
    got = {r["doc_id"]: r["kept"] for r in suffixes.dedup(docs).collect()}
    assert {k: hashlib.sha256(v).hexdigest() for k, v in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    assert len(want[0]) < len(every[0]) - 2000


def test_collocations(docs, texts):
    got = sorted(tuple(r) for r in collocations.collocations(docs, lang_col="source", least=3).collect())
    assert got == plain_phrases([(t, "a") for t in texts], 3)
    assert len(got) > 1
