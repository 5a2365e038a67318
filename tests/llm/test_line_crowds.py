"""Line dedup in proportion to the lines."""

from loomflow.llm import lines


def test_pairs_do_not_follow_the_square_of_a_group(spark, tmp_path, monkeypatch):
    """Lines of one template, all within two edits: their pairs are not made."""
    pairs = []
    made = lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a: pairs.append(made(*a).where("not crowded").distinct().count()) or made(*a))
    texts = [(k, f"one line of a template that many documents hold, number {chr(0x4E00 + k)}") for k in range(600)]
    got = lines.dedup(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got if not r["n_removed"]) == [0]
    assert pairs[0] < 600 * 8
