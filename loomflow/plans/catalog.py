"""Registered queries of the flow-graph engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomflow.plans import build_queries, frame_queries, graph_queries, program_queries, system_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (build_queries, graph_queries, program_queries, frame_queries, system_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_queries.triple_sum(spark, sf_dir)
