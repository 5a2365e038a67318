"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from loomflow.llm import collocations, embeddings, lines, media, mixing, packing, shards, simhash, substrings, suffixes, tokencounts, toxicity, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_media": media.op2_media,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substrings": substrings.op4_substrings,
    "op5_simhash": simhash.op5_simhash,
    "op6_lines": lines.op6_lines,
    "op7_tokencounts": tokencounts.op7_tokencounts,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_sharding": shards.op9_sharding,
    "op10_mixing": mixing.op10_mixing,
    "op11_suffixes": suffixes.op11_suffixes,
    "op12_collocations": collocations.op12_collocations,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {"op10_mixing": mixing.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
