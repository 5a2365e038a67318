"""Every stage against a plain version, on what the stage before it kept."""

import corpus_pipeline
from tokenizers import Tokenizer

from loomflow.llm import mixing, packing, toxicity
from tests.llm.test_lines import brute_dedup
from tests.llm.test_shingles import brute_groups


def check_packed(mixed, packed):
    """Tokens of every document, whole and in the mixed order."""
    library = Tokenizer.from_file(packing.vocabulary_path())
    order = {(r["doc_id"], r["text"]): r["at"] for r in corpus_pipeline.in_written_order(mixed, "at").collect()}
    want = {at: (d, [*library.encode(t, add_special_tokens=False).ids, 0]) for (d, t), at in order.items()}
    place = {d: at for at, (d, _) in want.items()}
    rows = packed.collect()
    held: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(held.setdefault(r["doc_id"], [])) and r["length"] == len(r["ids"])
        held[r["doc_id"]] += r["ids"]
    assert held == dict(want.values())
    for number in {r["sequence_id"] for r in rows}:
        inside = sorted((r["offset"], r["length"], r["doc_id"], r["piece"]) for r in rows if r["sequence_id"] == number)
        assert [x[0] for x in inside] == [sum(x[1] for x in inside[:k]) for k in range(len(inside))]
        assert sum(x[1] for x in inside) <= packing.CAPACITY
        # a sequence is numbered by the place in the mix, and the piece, of what it begins with
        assert min((place[d] << packing._PIECE_BITS) + piece for *_, d, piece in inside) == number


def stage_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        tables.append(docs)
    return tables


def test_stages_match_plain_versions(spark, sf_dir, tmp_path):
    docs, clean, lined, single, mixed, packed = stage_tables(spark, sf_dir, tmp_path)
    columns = docs.columns
    assert all(t.columns == columns for t in (clean, lined, single, mixed))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert toxic and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    want = brute_dedup(sorted((r["doc_id"], r["text"]) for r in clean.collect()), exact=1)
    got = {r["doc_id"]: r for r in lined.collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: t for d, (_, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    groups = brute_groups([(d, r["text"]) for d, r in got.items()])
    assert {r["doc_id"] for r in single.collect()} == set(groups.values())
    assert mixed.exceptAll(single).count() == 0 and mixed.count() == single.count()
    check_packed(mixed, packed)


def test_nulls_empty_tables_and_extra_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `__score` int, label string, lines int"
    rows = [(1, None, None, None, None, 1, "x", 0), (None, "a b", "en", None, 3, 1, "x", 0), (2, "", "en", "s", 0, 1, None, 0), (2, "", "en", "s", 0, 1, None, 0), (4, "w " * 5000, "en", "s", 10000, 1, "x", 0)]
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(1, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for n, data in enumerate((rows, [])):
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/{n}/documents.parquet")
        docs = spark.read.parquet(f"{sf}/{n}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == [f.split("`")[1] if "`" in f else f.split()[0] for f in schema.split(", ")]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert bool(out) == bool(data)


def test_packed_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    import random
    from functools import partial

    monkeypatch.setattr(packing, "pack", partial(packing.pack, partition_rows=64))
    rng = random.Random(6)
    # a is a fifth of the mix until it runs out; then b is alone
    rows = [(k, "w " * rng.randint(100, 900), "en", "a" if k % 17 == 0 else "b", 0) for k in range(1700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(7)
    source = {k: s for k, _, _, s, _ in rows}
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    place = {r["doc_id"]: r["at"] for r in corpus_pipeline.in_written_order(mixed, "at").collect()}
    want = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
    assert place == want
    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    order = [r["doc_id"] for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"]))]
    for k in range(0, 500, 125):
        assert 0.1 < sum(source[d] == "a" for d in order[k : k + 125]) / 125 < 0.3
    assert sum(source[d] == "a" for d in order[-850:]) == 0
    assert sorted(order) == list(range(1700))
