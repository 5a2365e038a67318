import hashlib
import random

import numpy as np
import pytest

from loomflow.llm import suffixes

DOCS = "doc_id bigint, text string, key string, first int"


def plain(docs, window=200):
    seen: dict = {}
    texts = [(d, (t or "").encode()) for d, t in docs]
    for _, b in texts:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for d, b in texts:
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, copies=50):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(300)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passages = [some(n) for n in (20, 35, 39, 60, 120)]
    docs = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "c" * 900, "xyz" * 150, "a" * 260 + "b", "q" + "a" * 230, "zyxwvutsrqponmlkjihgfedcba" * 9]
    for _ in range(copies):
        text = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] + some(rng.randint(0, 20))
        docs.append(text)
    docs += docs[12:25] + [docs[20] + " more", docs[21][1:]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def got(df):
    rows = suffixes.dedup(df).collect()
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows], key=str)


@pytest.mark.parametrize("crowd", [2, 4096])
def test_matches_brute_force(spark, monkeypatch, crowd):
    # also with keys dealt to several shards, twice
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SHARD_REGIONS", 40 if crowd == 2 else 8192)
    monkeypatch.setattr(suffixes, "BLOCK", 700 if crowd == 2 else 1 << 20)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(4)
    want = plain(docs)
    assert got(df) == want
    assert sum(n > 0 for _, _, n, *_ in want) > 30


def test_suffix_arrays_decide_what_is_removed(spark, monkeypatch):
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in corpus(3, 20)], DOCS)
    told = suffixes._told

    def blind(rows, window):
        # in the worker, every line but the comparison of neighbours stays
        real = suffixes.common_prefixes
        suffixes.common_prefixes = lambda data, order, most: np.zeros(len(order), int)
        try:
            return told(rows, window)
        finally:
            suffixes.common_prefixes = real

    monkeypatch.setattr(suffixes, "_told", blind)
    assert {r["n_removed"] for r in suffixes.dedup(df).collect()} == {0}


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh", bytes(range(256))])
def test_windows_are_sorted(letters):
    rng = random.Random(len(letters))
    for window in (9, 16, 40):
        texts = [bytes(rng.choice(letters) for _ in range(window + rng.randint(0, 60))) for _ in range(30)]
        texts += [texts[0], texts[3][2:] if len(texts[3]) > window + 2 else texts[3], b"\0" * (window + 3), b"\xff" * (window + 5)]
        counts = np.array([rng.randint(1, len(t) - window + 1) for t in texts])
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        joined = b"\0".join(texts) + bytes(window + 16)
        data = np.frombuffer(joined, np.uint8)
        order = suffixes.suffix_array(data, starts, starts + sizes, counts, window)
        found = [joined[p : p + window] for p in order.tolist()]
        every = [t[k : k + window] for t, c in zip(texts, counts.tolist()) for k in range(c)]
        assert sorted(every) == sorted(found)
        # equal windows are neighbours, and all but runs of one byte are in order
        kinds = [w for i, w in enumerate(found) if i == 0 or w != found[i - 1]]
        assert kinds == sorted(set(every))
        lcp = suffixes.common_prefixes(data, order, window).tolist()
        for a, b, n in zip(found, found[1:], lcp[1:], strict=False):
            assert n == next((k for k in range(window) if a[k] != b[k]), window)


def test_regions_tile_the_windows():
    rng = random.Random(5)
    for n in (199, 200, 201, 1000, 5000):
        text = bytes(rng.choice(b"abcd") for _ in range(n))
        _, first, count = suffixes.regions(text)
        assert [w for f, c in zip(first.tolist(), count.tolist()) for w in range(f, f + c)] == list(range(max(0, n - 199)))
    # equal windows have equal anchors
    a, b = (dict(zip((w for f, c in zip(f.tolist(), c.tolist()) for w in range(f, f + c)), np.repeat(k, c).tolist(), strict=True)) for k, f, c in (suffixes.regions(text), suffixes.regions(text[37:])))
    assert all(a[w + 37] == k for w, k in b.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(f"v{k}," for k in range(80))
    df = spark.createDataFrame([(2, text, "", 0), (2, text, "", 0), (None, "x" + text, "", 0), (5, text[3:190], "", 0), (None, None, "", 0)], DOCS)
    rows = [(r["doc_id"], r["n_removed"], r["n_spans"], r["kept"]) for r in suffixes.dedup(df).collect()]
    assert sorted(rows, key=str) == sorted([(2, len(text), 1, b""), (2, len(text), 1, b""), (None, len(text), 1, b"x"), (5, 0, 0, text[3:190].encode()), (None, 0, 0, b"")], key=str)
    assert suffixes.dedup(df.limit(0)).collect() == []


def test_pieces_tile_a_run_and_follow_from_the_windows():
    rng = random.Random(8)
    common = bytes(rng.choice(b"abcdef") for _ in range(500))
    for window, edges in ((200, (50, 12, 3, 1)), (40, (10, 2, 1))):
        for edge in edges:
            of: dict = {}
            for text in (common, common[3:], b"xy" + common[:450] + b"tail", b"a" * 260, common[100 : 100 + window]):
                keys, first, count = (x.tolist() for x in suffixes.pieces(text, window, edge))
                assert [w for f, c in zip(first, count, strict=True) for w in range(f, f + c)] == list(range(len(text) - window + 1))
                for k, f, c in zip(keys, first, count, strict=True):
                    for w in range(f, f + c):
                        assert of.setdefault(text[w : w + window], k) == k
            if edge == 1:
                # whole windows
                assert len(set(of.values())) == len(of)


def test_distinct_windows_of_a_crowd_go_on_as_few_rows(spark, monkeypatch):
    # near copies of one text, in pairs: some hundred windows of each pair are in no other, and went on as a row each
    monkeypatch.setattr(suffixes, "CROWD", 8)
    monkeypatch.setattr(suffixes, "SHARD_REGIONS", 20)
    rng = random.Random(4)
    words = "".join(f"w{k} " for k in range(150))
    docs = []
    for k in range(20):
        at = rng.randint(0, len(words) - 20)
        docs += [(2 * k + i, words[:at] + f"<{k}>" + words[at + 5 :]) for i in range(2)]
    settled, went = suffixes._settled, []

    def watch(rows, *rest):
        went.append(rows.selectExpr("count(*)", "sum(count)").first())
        return settled(rows, *rest)

    monkeypatch.setattr(suffixes, "_settled", watch)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(4)
    assert got(df) == plain(docs)
    rows, windows = went[1]
    assert windows > 1000 and rows * 5 < windows


@pytest.mark.parametrize("together", [2, 24, 10**9])
def test_common_prefixes_of_places_in_a_row(monkeypatch, together):
    # in runs that are compared at once and one by one
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    joined = text + b"\0" + text[5:300] + b"#" + text[301:] + b"\0" + b"a" * 90 + text[40:200]
    places = [p for p in range(len(joined) - 40) if b"\0" not in joined[p : p + 40]]
    order = np.array(sorted(places, key=lambda p: (joined[p : p + 40], p)))
    data = np.frombuffer(joined + bytes(56), np.uint8)
    lcp = suffixes.common_prefixes(data, order, 40).tolist()
    assert lcp[0] == 0 and sum(n == 40 for n in lcp) > 300
    for a, b, n in zip(order.tolist(), order[1:].tolist(), lcp[1:], strict=False):
        assert n == next((k for k in range(40) if joined[a + k] != joined[b + k]), 40)
