"""All queries of this subpackage."""

from __future__ import annotations

from corefold.llm import queries

QUERIES = dict(queries.QUERIES)
SQL = dict(queries.SQL)
