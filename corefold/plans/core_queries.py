"""Queries of the core package with their SQL counterparts."""

from __future__ import annotations

from corefold.operators import skew
from corefold.runtime import table


def p4_names(spark, d):
    return skew.name_results(table(spark, d, "mention_pairs"), table(spark, d, "mentions"), table(spark, d, "conll_docs"))


def p4_found(spark, d):
    return skew.heavy_names(p4_names(spark, d))


_P4_SQL = """
WITH doc AS (SELECT conll_doc_id, min(name) AS doc_name FROM conll_docs GROUP BY 1),
p AS (SELECT DISTINCT pair_row, conll_doc_id, name, pairs_labels FROM mention_pairs),
m AS (SELECT DISTINCT mention_id, conll_doc_id, name, mentions_pairs_length FROM mentions),
pn AS (SELECT coalesce(p.name, doc_name) AS name, count(*) AS pairs, sum(CASE WHEN pairs_labels = 1 THEN 1 ELSE 0 END) AS matches
       FROM p LEFT JOIN doc USING (conll_doc_id) GROUP BY 1),
mn AS (SELECT coalesce(m.name, doc_name) AS name, count(*) AS mentions, sum(mentions_pairs_length) AS pairs_length
       FROM m LEFT JOIN doc USING (conll_doc_id) GROUP BY 1),
r AS (SELECT coalesce(pn.name, mn.name) AS name, coalesce(pairs, 0)::BIGINT AS pairs, coalesce(matches, 0)::BIGINT AS matches,
             coalesce(mentions, 0)::BIGINT AS mentions, coalesce(pairs_length, 0)::BIGINT AS pairs_length
      FROM pn FULL JOIN mn ON pn.name IS NOT DISTINCT FROM mn.name)
"""

QUERIES = {"p4_found": p4_found, "p4_names": p4_names}
SQL = {
    "p4_names": _P4_SQL + "SELECT * FROM r",
    "p4_found": _P4_SQL + "SELECT name FROM r WHERE name IS NOT NULL AND pairs * 20 >= (SELECT sum(pairs) FROM r)",
}
