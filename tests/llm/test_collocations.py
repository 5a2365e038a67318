import random
import re

import duckdb
import pytest

from loomflow.llm import collocations

DOCS = "text string, lang string, phrase string, n int"


def plain(docs, least=100, top=2000):
    counts: dict = {}
    for text, lang in docs:
        f = counts.setdefault(lang or "und", {})
        low = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    p = tuple(words[i : i + k])
                    f[p] = f.get(p, 0) + 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= a}
        rows = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, lo, hi) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, lo, hi, n, -s))
    return sorted(out)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "cé", "D", "e\x01", "e\x00x", "e", "f g", "\x1c", "日本"] + [f"w{k}" for k in range(30)]
    phrases = [rng.choices(words, k=k) for k in (2, 3, 4, 5, 6, 9)]
    docs = [(None, "x"), ("", None), (" \t.,;", "y"), ("a a a a a a a a a a", None), ("a\tb  cé", "x")]
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 12)):
            text += rng.choice(phrases) if rng.random() < 0.5 else rng.choices(words, weights=[5] * 5 + [1] * 35, k=rng.randint(1, 4))
            if rng.random() < 0.4:
                text[-1] += rng.choice(".,;:!?\n\x0b\x0c\r")
        docs.append((" ".join(text), rng.choice(["x", "x", "y", None])))
    return docs + docs[:20]


def got(df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize("block", [300, 1 << 23])
def test_matches_brute_force(spark, monkeypatch, block):
    # many small tries, or one for each language
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    docs = corpus()
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS).repartition(4)
    want = plain(docs, 4, 60)
    assert got(df, least=4, top=60) == want
    assert {r[0] for r in want} == {"x", "y", "und"} and max(r[1] for r in want) == 60
    assert got(df, least=1, top=10**6) == plain(docs, 1, 10**6)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    docs = corpus(4)
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS)
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    assert got(df, least=3) == plain(docs, 3)


def test_products_beyond_64_bits(spark):
    rows = [("p", "a b", 10**14, 10**17, [3 * 10**14], [10**14 + 1]), ("p", "a b c", 7, 10**15, [7, 8], [8, 7])]
    df = spark.createDataFrame(rows, "lang string, phrase string, a bigint, n bigint, lefts array<bigint>, rights array<bigint>")
    assert {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations._scored(df).collect()} == {"a b": (3 * 10**14, 10**14 + 1, 333333), "a b c": (7, 8, 1000 * 7 * 10**15 // 56)}


def test_empty_table_and_default_limits(spark):
    df = spark.createDataFrame([("one two " * 100, "z", "", 0)] * 2, DOCS)
    assert got(df.limit(0)) == []
    assert got(df) == plain([("one two " * 100, "z")] * 2)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    result = con.execute(collocations.ORACLE_SQL)
    columns = [c[0] for c in result.description]
    got = collocations.op12_collocations(spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(result.fetchall())
