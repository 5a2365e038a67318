import hashlib
import random

import pytest

from loomflow.llm import substrings
from tests.llm import brute

DOCS = "doc_id bigint, text string, key string, spans int"


def corpus(seed=1, copies=40):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(500)]
    some = lambda n: rng.choices(words, k=n)
    passages = [some(rng.choice([19, 20, 21, 60])) for _ in range(6)]
    docs = [None, "", " \t\n", "short one", " ".join(["same"] * 70), " ".join(some(5) * 12)]
    for _ in range(copies):
        text = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += p[rng.randint(0, 4) :] + some(rng.randint(0, 30))
        docs.append("\x0b \x1c".join([" ".join(text), "end"]))
    docs += docs[8:20] + [docs[10] + " more"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("size", [3, 40, 2000])
def test_matches_brute_force(spark, monkeypatch, size):
    # small shards also have anchors dealt out by single windows
    monkeypatch.setattr(substrings, "SHARD_REFERENCES", size)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substrings.dedup(df).collect()}
    want = brute.substrings(docs)
    assert got == want
    assert sum(n > 0 for _, n, _ in want.values()) > 15


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_REFERENCES", 3)
    docs = corpus(4, 25)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df).collect()}
    assert got == {d: n for d, (_, n, _) in brute.substrings(docs).items()}


def test_automata_decide_what_is_removed(spark, monkeypatch):
    class Blind(substrings.Automaton):
        def windows(self, words, window):
            return iter(())

    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in corpus()], DOCS)

    def blind(references, places, window):
        # in the worker, every line but the automaton's stays
        real, substrings.Automaton = substrings.Automaton, Blind
        try:
            return substrings.match_shard(references, places, window)
        finally:
            substrings.Automaton = real

    for size in (3, 2000):
        monkeypatch.setattr(substrings, "SHARD_REFERENCES", size)
        monkeypatch.setattr(substrings, "match_shard", blind)
        assert {r["n_removed"] for r in substrings.dedup(df).collect()} == {0}


def test_first_places_of_windows():
    rng = random.Random(7)
    for window in (2, 5):
        sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(15)]
        first: dict = {}
        known = substrings.Automaton()
        for k, s in enumerate(sequences):
            known.add(s, k << 16)
            for i in range(len(s) - window + 1):
                first.setdefault(tuple(s[i : i + window]), (k << 16) + i)
        for s in sequences:
            assert list(known.windows(s, window)) == [(i, first[tuple(s[i : i + window])]) for i in range(len(s) - window + 1)]


def test_automaton_has_the_matching_statistics():
    rng = random.Random(2)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    known = substrings.Automaton()
    for k, s in enumerate(sequences):
        before = {tuple(x[i:j]) for x in sequences[:k] for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([n for n in range(1, t + 1) if tuple(s[t - n : t]) in before], default=0) for t in range(1, len(s) + 1)]
        assert list(known.matching(s)) == want
        known.add(s)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"v{k}" for k in range(25))
    df = spark.createDataFrame([(2, text, "", 0), (2, text, "", 0), (None, text, "", 0), (5, text, "", 0)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.dedup(df).collect())
    assert got == [("2", 0), ("2", 0), ("5", 25), ("None", 25)]
    assert substrings.dedup(df.limit(0)).collect() == []
