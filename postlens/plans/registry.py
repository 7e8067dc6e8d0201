"""Registered queries: name -> callable, and name -> SQL over the same tables. Names begin with the inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlens.operators import aggregates
from postlens.plans import q_aggregates, q_matching, q_pipelines, q_retrieval, q_skills, q_streams, q_tables, q_text
from postlens.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (q_text, q_tables, q_aggregates, q_skills, q_matching, q_retrieval, q_streams, q_pipelines):
    for _name, (_run, _sql) in _module.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"{_name} is registered twice")
        QUERIES[_name] = _run
        if _sql:
            ORACLE_SQL[_name] = fixtures.with_sql(_sql)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten skills of each country."""
    skills, jobs = fixtures.posting_skills(spark, sf_dir), fixtures.postings(spark, sf_dir)
    return aggregates.top_per_group(aggregates.skill_by_region(skills, jobs), ["country"], ["n desc", "skill"], 10)
