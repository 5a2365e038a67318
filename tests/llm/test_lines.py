import random

import pytest

from loomflow.llm import lines
from tests.llm import brute

DOCS = "doc_id bigint, text string, of string, lines int"


def test_edit_distance_matches_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("abé") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        for most in (1, 2, 3, 4):
            assert lines.edits(a, b, most) == min(brute.edit_distance(a, b), most + 1), (a, b, most)


def test_segments_and_probes_meet():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(24, 40)))
        b = list(a)
        for _ in range(2):
            p = rng.randrange(len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        own = {(len(short), k, short[p : p + n]) for k, (p, n) in enumerate(lines.segments(len(short), 3))}
        assert own & {(m, k, long[p : p + n]) for m, k, p, n in lines.probes(len(long), 2)}


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 60))) for _ in range(30)]
    docs = [None, "", "\n\n", "short\nshort", base[0], base[0] + "\r"]
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                p = rng.randrange(len(line))
                line[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            text.append("".join(line))
        docs.append("\n".join(text))
    docs.append("\n".join(["z" * 40] * 3 + ["tail"]))
    return list(enumerate(docs))


def brute_dedup(docs, threshold=2, least=24, exact=None):
    """Kept texts: lines of the least length without any that is within the threshold of an earlier one; with exact, shorter ones without equal ones."""
    seen, short, out = [], set(), {}
    for d, t in docs:
        kept = []
        for line in (t or "").split("\n"):
            if len(line) >= least:
                gone = any(abs(len(line) - len(x)) <= threshold and brute.edit_distance(line, x) <= threshold for x in seen)
                seen.append(line)
                if gone:
                    continue
            elif exact is not None and len(line) >= exact and line.strip():
                if line in short:
                    continue
                short.add(line)
            kept.append(line)
        out[d] = (len((t or "").split("\n")), "\n".join(kept))
    return out


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["text"]) for r in lines.dedup(df).collect()}
    assert got == brute_dedup(docs)


def test_keeps_columns_and_takes_nulls(spark):
    long = "l" * 30
    rows = [(1, f"{long}\na", "", 0), (1, f"{long}\na", "", 0), (2, f"{long}x\nb", None, None), (None, f"{long}\nc", "", 0), (3, None, "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, f"{long}\na"), (1, f"{long}\na"), (2, "b"), (None, "c"), (3, None)], key=str)
    assert lines.dedup(df.limit(0)).collect() == []


def test_neighbourhoods_are_exact():
    rng = random.Random(11)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        b = "".join(b)
        one, two = dict(lines.neighbourhood(a)), dict(lines.neighbourhood(b))
        shared = any(not (one[k] and two[k]) for k in one.keys() & two.keys())
        assert shared == (brute.edit_distance(a, b) <= 2), (a, b)


@pytest.mark.parametrize("short", [0, 6, 32])
def test_crowded_keys_match_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(lines, "CROWDED_PAIRS", 3)
    monkeypatch.setattr(lines, "CROWDED_ROWS", 12)
    monkeypatch.setattr(lines, "SHORT", short)
    monkeypatch.setattr(lines, "BLOCK", 7)
    rng = random.Random(12)
    docs = corpus(13) + [(1000 + k, f"order number {rng.randint(0, 300)} of the shop went out on day {rng.randint(0, 99)}") for k in range(120)]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["text"]) for r in lines.dedup(df).collect()}
    assert got == brute_dedup(docs)


def test_many_lines_of_one_template(spark):
    rng = random.Random(14)
    numbers = [f"{rng.randrange(10**7):07d}" for _ in range(20_000)]
    df = spark.createDataFrame([(k, f"please quote the reference {n} in all letters", "", 0) for k, n in enumerate(numbers)], DOCS).repartition(8)
    gone = {r["doc_id"] for r in lines.dedup(df).where("n_removed = 1").collect()}
    for k in rng.sample(range(20_000), 40):
        near = any(lines.edits(n, numbers[k], 2) <= 2 for n in numbers[:k])
        assert (k in gone) == near
    assert 1000 < len(gone) < 19_000


def test_lines_with_the_same_letters_keep_their_names_apart(spark):
    x = "fox over the dog near the bank lazy brown jumps quick"
    y = "the lazy brown fox the bank dog over quick jumps near"
    df = spark.createDataFrame([(0, x + "\n" + y, "", 0), (1, y + "!", "", 0)], DOCS)
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == {0: x + "\n" + y, 1: ""}


def test_equal_names_lose_no_link(spark, monkeypatch):
    # names of two bits: all decisions are left to marks and texts
    monkeypatch.setattr(lines, "NAME_BITS", 2)
    docs = corpus(15)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["text"]) for r in lines.dedup(df).collect()}
    assert got == brute_dedup(docs)


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        lines.dedup(spark.createDataFrame([], DOCS), threshold=9)


def test_short_repeats_go_too(spark, tmp_path):
    from corpus_pipeline import drop_repeated_lines

    rows = [(1, "All rights reserved.\nOk\n\n  \nSee it", None, 0), (2, "Ok\n\n  \nOk!\nAll rights reserved.", None, 0), (3, "Ok", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    want = {1: "All rights reserved.\nOk\n\n  \nSee it", 2: "\n  \nOk!", 3: ""}
    assert {r["doc_id"]: r["text"] for r in drop_repeated_lines(spark, df, "").collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in lines.op6_lines(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 2, 3: 1}
