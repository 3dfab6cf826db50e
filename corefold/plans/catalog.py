"""All queries of the core package."""

from __future__ import annotations

from corefold.plans import core_queries, corpus_queries, pair_queries, text_queries

QUERIES = core_queries.QUERIES | text_queries.QUERIES | pair_queries.QUERIES | corpus_queries.QUERIES
SQL = core_queries.SQL | text_queries.SQL | pair_queries.SQL | corpus_queries.SQL


def flagship(spark, d):
    return core_queries.p4_names(spark, d)
