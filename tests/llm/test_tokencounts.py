import math
import random

from loomflow.llm import tokencounts

DOCS = "doc_id bigint, text string, id string, n_tokens int"


def brute_count(word, pieces, byte_score):
    best = [(0.0, 0)] + [None] * len(word)
    for t in range(1, len(word) + 1):
        wide = len(word[t - 1].encode())
        s, n = best[t - 1]
        best[t] = (s + wide * byte_score, n + wide)
        for i in range(t):
            if word[i:t] in pieces:
                s, n = best[i]
                new = (s + pieces[word[i:t]], n + 1)
                if new[0] > best[t][0] or (new[0] == best[t][0] and new[1] < best[t][1]):
                    best[t] = new
    return best[-1][1]


def test_trie_matches_brute_force():
    rng = random.Random(4)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -math.log(k + 2) for k in range(40)}
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(400)}
    got = tokencounts.count_all(words, tokencounts.piece_trie(pieces), -5.0)
    assert got == {w: brute_count(w, pieces, -5.0) for w in words}


def test_counts_of_documents(spark):
    pieces, byte_score = tokencounts.scores(tokencounts.vocabulary_path())
    texts = [None, "", " \n", "Hello hello world", "naïve 日本語 text\ntext", "x" * 3000, "Hello hello world"]
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in enumerate(texts)] + [(None, "one", "", 0)], DOCS)
    want = {(k, len((t or "").split()), sum(brute_count("▁" + w, pieces, byte_score) for w in (t or "").split())) for k, t in [*enumerate(texts), (None, "one")]}
    assert {tuple(r) for r in tokencounts.count(df).collect()} == want
    assert tokencounts.count(df.limit(0)).collect() == []


def longest(path):
    """Scores that favour long pieces."""
    pieces, _ = tokencounts.scores(path)
    return {p: -1.0 for p in pieces}, -3.0


def test_scores_can_be_given(spark):
    pieces, byte_score = longest(tokencounts.vocabulary_path())
    df = spark.createDataFrame([(1, "Hello hello worldwide", "", 0)], DOCS)
    (row,) = tokencounts.count(df, score=longest).collect()
    assert row["n_tokens"] == sum(brute_count("▁" + w, pieces, byte_score) for w in "Hello hello worldwide".split())
    own, low = tokencounts.unigram_scores(tokencounts.vocabulary_path())
    assert len(own) > 30_000 and low <= max(own.values())
