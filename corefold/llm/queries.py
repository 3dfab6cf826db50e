"""Queries of this subpackage with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefold.functions.lexical import PLAIN_FORMS, STRAY_CHARACTERS
from corefold.llm import groups, mixing, overlap, packing, pieces, spans
from corefold.llm.tokens import with_token_counts
from corefold.runtime import stash, table


def p1_found(spark, d):
    links = groups.mention_links(table(spark, d, "mention_pairs"), table(spark, d, "mentions"), table(spark, d, "feature_docs"), table(spark, d, "conll_docs"))
    return groups.connected_groups(links).select("group_id", F.col("member").alias("mention_id"))


def _limit(spark, d, name):
    """A value of the four-row table size_limits."""
    return table(spark, d, "size_limits").where(F.col("limit_name") == name).first()["limit_value"]


def p7_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"), _limit(spark, d, "shared_span_chars"))


def p7_shares(spark, d):
    return spans.shared_shares(table(spark, d, "documents"), _limit(spark, d, "shared_span_chars"))


def _splits(spark, d):
    """(id, split, source) of every document, once; case and blanks of the split are ignored."""
    docs = table(spark, d, "conll_docs").select(F.col("conll_doc_id").alias("id"), F.lower(F.regexp_replace("split", r"\s", "")).alias("split"), "source")
    return docs.distinct()


def _plain_token(token):
    """``clean_token`` and lower case, for one token."""
    kept = token if token in STRAY_CHARACTERS else PLAIN_FORMS.get(token, token).translate(_NO_STRAYS)
    return (kept or ",").lower()


_NO_STRAYS = str.maketrans("", "", STRAY_CHARACTERS)


def _p3(spark, d, n, **thresholds):
    """Overlaps and classes of evaluation documents in training documents, on runs of n cleaned tokens."""
    tokens = F.flatten(F.filter("conll_tokens", lambda u: u.isNotNull()))
    features = table(spark, d, "feature_docs").select(F.col("conll_doc_id").alias("id"), tokens.alias("tokens"))
    side = F.when(F.col("split") == "train", "train").when(F.col("split").isin("dev", "test"), "eval")
    sides = _splits(spark, d).select("id", side.alias("side"))
    return overlap.find_overlaps(features, sides, n, clean=_plain_token, **thresholds)


def p3_found(spark, d):
    pairs = overlap.expand_pairs(*_p3(spark, d, 3, similarity=0.5))
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p3_report(spark, d):
    return overlap.overlap_report(*_p3(spark, d, 3, similarity=0.5), _splits(spark, d).where(F.col("split").isin("dev", "test")))


def p3_contained(spark, d):
    """Evaluation documents of which four fifths of the five-token runs stand in one training document, by classes of equal documents."""
    return _p3(spark, d, 5, containment=0.8)[0]


def p2_pieces(spark, d):
    limit, overlap_tokens = _limit(spark, d, "piece_tokens"), _limit(spark, d, "piece_overlap_tokens")
    return pieces.cut_documents(table(spark, d, "feature_docs"), limit, overlap_tokens)


def p2_found(spark, d):
    return p2_pieces(spark, d).where("piece > 0").select("conll_doc_id").distinct()


TEXT_LIMIT, TEXT_OVERLAP = 2000, 200  # characters


def p2_text_pieces(spark, d):
    """Texts cut by section, paragraph, sentence, word and character."""
    return pieces.cut_texts(table(spark, d, "documents"), TEXT_LIMIT, TEXT_OVERLAP)


def p5_containers(spark, d):
    sizes = with_token_counts(table(spark, d, "documents").select("doc_id", "text"))
    return packing.pack(sizes, _limit(spark, d, "container_tokens"), "doc_id")


def p5_fill(spark, d):
    return packing.fill_report(p5_containers(spark, d), _limit(spark, d, "container_tokens"))


CHAR_CAPACITY = 16_384


def p5_invariants(spark, d):
    """What must hold of any packing, for the texts sized in characters: all items whole, no container overfull, at most one in a hundred too many."""
    sizes = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_tokens"))
    packed = stash(packing.pack(sizes, CHAR_CAPACITY, "doc_id"), "packed")
    items = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.min("piece_start").alias("lo"), F.max("piece_end").alias("hi"),
        F.sum((F.col("piece_start") != F.col("piece") * CHAR_CAPACITY).cast("int")).alias("misplaced"),
    )
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n")) & (F.col("misplaced") == 0)
    of_items = items.agg(F.count(F.lit(1)).alias("items"), F.sum("pieces").alias("pieces"), F.sum("n").alias("total"), F.sum((~whole).cast("long")).alias("broken"))
    load = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    used = load.agg(F.count(F.lit(1)).alias("used"), (F.max("container_id") + 1).alias("numbered"), F.sum((F.col("load") > CHAR_CAPACITY).cast("long")).alias("overfull"))
    both = of_items.crossJoin(F.broadcast(used))  # one row each
    tight = F.col("used") <= F.ceil(F.col("total") / CHAR_CAPACITY) * 1.01 + 1
    return both.select("items", "pieces", "total", "broken", "overfull", (F.col("used") == F.col("numbered")).alias("dense"), tight.alias("tight"))


def _p6(spark, d, **options):
    targets = table(spark, d, "mix_targets")
    few = F.broadcast(targets.select("source").distinct())  # one row per target
    texts = table(spark, d, "documents").where(F.col("text").isNotNull()).join(few, "source", "left_semi")
    texts = texts.select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("f"), F.xxhash64(F.lit(1), "text").alias("g"), "text")
    return mixing.mix(with_token_counts(texts, out="size"), targets, **options)


def p6_mix(spark, d):
    return _p6(spark, d)[0].withColumnRenamed("id", "doc_id").withColumnRenamed("size", "n_tokens")


def p6_shares(spark, d):
    return _p6(spark, d)[1]


def p6_reachable(spark, d):
    """The shares at the largest size of the mix at which no source with texts falls short."""
    return _p6(spark, d, total=mixing.REACHABLE)[1]


def p6_invariants(spark, d):
    """What must hold of any mix, for the texts sized in characters, by source: the quota, no text used too often or for a source it is not of,
    no more than the quota and one text, and whether the source can fill its quota.
    """
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    rows = documents.where("text is not null").select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("f"), F.xxhash64(F.lit(1), "text").alias("g"), F.length("text").alias("size"))
    selection, report = mixing.mix(rows, targets)
    selection = stash(selection, "selection")
    held = selection.join(documents.select(F.col("doc_id").alias("id"), F.col("source").alias("own"), F.md5("text").alias("text")).distinct(), "id")
    caps = documents.join(targets.select("source", "max_repeats"), "source").groupBy(F.md5("text").alias("text")).agg(F.min("max_repeats").alias("cap"))
    per_text = held.groupBy("text").agg(F.sum("uses").alias("uses"), F.min("source").alias("source")).join(caps, "text")
    over = per_text.groupBy("source").agg(F.sum((F.col("uses") > F.col("cap")).cast("long")).alias("overused"))
    of = held.groupBy("source").agg(F.sum((F.col("source") != F.col("own")).cast("long")).alias("stray"), F.max("size").alias("longest"), F.sum(F.col("uses") * F.col("size")).alias("sum"))
    out = report.join(of, "source", "left").join(over, "source", "left").na.fill(0)
    right = (F.col("sum") == F.col("reached")) & (F.col("reached") <= F.col("quota") + F.col("longest"))
    return out.select("source", "quota", "stray", "overused", right.alias("within"), "short")


# Greedy cuts over base(id, n, b1, ..., b4): n units, and the boundaries of each level from coarse to fine.
_CUTS_SQL = """
cuts(id, piece, begin, stop, carried, level) AS (
  SELECT id, -1, 0, 0, 0, 9 FROM base UNION ALL
  SELECT id, piece + 1, stop - car, CASE WHEN reach >= n THEN n ELSE coalesce(c1, c2, c3, c4, reach) END, car,
    CASE WHEN reach >= n THEN 0 WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 WHEN c3 IS NOT NULL THEN 3 WHEN c4 IS NOT NULL THEN 4 ELSE 5 END
  FROM (SELECT *, list_max(list_filter(b1, lambda x: x <= reach AND x > least)) AS c1, list_max(list_filter(b2, lambda x: x <= reach AND x > least)) AS c2,
          list_max(list_filter(b3, lambda x: x <= reach AND x > least)) AS c3, list_max(list_filter(b4, lambda x: x <= reach AND x > least)) AS c4
        FROM (SELECT *, stop + size - car AS reach, greatest(stop, stop - car + over - 1) AS least
              FROM (SELECT base.*, piece, stop, CASE WHEN piece < 0 THEN 0 ELSE over END AS car FROM cuts JOIN base USING (id) WHERE level <> 0))))
"""
_P2_PIECES_SQL = f"""
WITH RECURSIVE lim AS (SELECT max(limit_value) FILTER (limit_name = 'piece_tokens') AS size, max(limit_value) FILTER (limit_name = 'piece_overlap_tokens') AS over FROM size_limits),
f AS (SELECT DISTINCT conll_doc_id AS id, conll_tokens AS u, flatten(conll_tokens) AS t, locations AS l FROM feature_docs),
g AS (SELECT *, len(t) AS n, list_transform(range(1, len(u) + 1), lambda i: coalesce(list_sum(list_transform(u[1 : i - 1], lambda x: len(x))), 0)) AS starts,
        list_aggregate(list_transform(t, lambda x: CASE WHEN x IN ({", ".join("'" + x.replace("'", "''") + "'" for x in pieces.SENTENCE_ENDS)}) THEN 'e'
          WHEN x IN ({", ".join("'" + x.replace("'", "''") + "'" for x in pieces.CLOSING_MARKS)}) THEN 'c' ELSE 'x' END), 'string_agg', '') AS kinds FROM f),
h AS (SELECT *, list_transform(l, lambda p: [starts[p.utterance + 1] + p.span_start, starts[p.utterance + 1] + p.span_end]) AS spans,
        string_split(regexp_replace(coalesce(kinds, ''), '(ec*)', '\\1|', 'g'), '|') AS parts FROM g),
s AS (SELECT *, list_filter(range(1, n), lambda p: len(list_filter(spans, lambda x: x[1] < p AND p < x[2])) = 0) AS free,
        list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1 : i], lambda x: len(x)))::INT) AS ends FROM h),
base AS (SELECT id, n, size, over, t, list_filter(starts, lambda p: p > 0 AND p < n) AS b1, list_intersect(ends, free) AS b2, free AS b3, []::BIGINT[] AS b4 FROM s, lim),
{_CUTS_SQL}
SELECT id AS conll_doc_id, piece, begin::INT AS token_start, stop::INT AS token_end, carried::INT AS overlap,
  CASE level WHEN 0 THEN 'end' WHEN 1 THEN 'utterance' WHEN 2 THEN 'sentence' WHEN 3 THEN 'token' ELSE 'inside a span' END AS cut, t[begin + 1 : stop] AS tokens
FROM cuts JOIN (SELECT id, t FROM base) USING (id) WHERE piece >= 0
"""


def _ends_of(pattern):
    """SQL for the ends of all matches in ``text``: marks are put behind them, and the lengths of the parts summed."""
    pattern = pattern.replace("'", "''").replace("\u00a0", "\\x{a0}").replace("\u3000", "\\x{3000}")
    parts = f"string_split(regexp_replace(text, '({pattern})', '\\1' || chr(31), 'g'), chr(31))"
    return f"list_transform(range(1, len({parts})), lambda i: list_sum(list_transform({parts}[1 : i], lambda x: length(x)))::INT)"


_P2_TEXT_SQL = f"""
WITH RECURSIVE f AS (SELECT DISTINCT doc_id AS id, coalesce(text, '') AS text, string_split(coalesce(text, ''), '') AS c FROM documents),
base AS (SELECT id, text, length(text) AS n, {TEXT_LIMIT} AS size, {TEXT_OVERLAP} AS over,
  {_ends_of(pieces.SECTION)} AS b1, {_ends_of(pieces.PARAGRAPH)} AS b2, {_ends_of(pieces.SENTENCE)} AS b3,
  list_filter(range(1, length(text)), lambda p: regexp_full_match(c[p], '[{pieces.BLANKS}]') AND NOT regexp_full_match(c[p + 1], '[{pieces.BLANKS}]')) AS b4 FROM f),
{_CUTS_SQL}
SELECT id AS doc_id, piece, begin::INT AS char_start, stop::INT AS char_end, carried::INT AS overlap,
  CASE level WHEN 0 THEN 'end' WHEN 1 THEN 'section' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'sentence' WHEN 4 THEN 'word' ELSE 'character' END AS cut,
  substring(text, begin::INT + 1, stop::INT - begin::INT) AS text
FROM cuts JOIN (SELECT id, text FROM base) USING (id) WHERE piece >= 0
"""

_P3_TOKENS = """
WITH plain AS (SELECT map(['/.', '/?', '-LRB-', '-RRB-', '-LCB-', '-RCB-', '-LSB-', '-RSB-'], ['.', '?', '(', ')', '{', '}', '[', ']']) AS m),
f AS (SELECT DISTINCT conll_doc_id AS id, flatten(conll_tokens) AS raw FROM feature_docs),
t AS (SELECT id, list_transform(raw, lambda x: lower(CASE WHEN x IN ('/', '%', '*') THEN x
        ELSE coalesce(nullif(translate(coalesce(m[x], x), '/%*', ''), ''), ',') END)) AS t FROM f, plain),
d AS (SELECT DISTINCT conll_doc_id AS id, lower(regexp_replace(split, '\\s', '', 'g')) AS split, source FROM conll_docs),
"""
_P3_SQL = _P3_TOKENS + """
i AS (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM t),
g AS (SELECT DISTINCT id, t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2] AS g FROM i),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
e AS (SELECT g.id, g.g FROM g JOIN d USING (id) WHERE split IN ('dev', 'test')),
r AS (SELECT g.id, g.g FROM g JOIN d USING (id) WHERE split = 'train'),
s AS (SELECT e.id AS a, r.id AS b, count(*) AS s FROM e JOIN r USING (g) GROUP BY 1, 2),
hit AS (SELECT a, b FROM s JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 2 * s >= x.n + y.n - s)
"""
_P3_CONTAINED_SQL = _P3_TOKENS + """
i AS (SELECT id, t, unnest(range(1, len(t) - 3)) AS i FROM t),
g AS (SELECT DISTINCT id, array_to_string(t[i : i + 4], chr(31)) AS g FROM i),
sets AS (SELECT id, list(g ORDER BY g) AS grams FROM g GROUP BY id),
classes AS (SELECT split = 'train' AS train, grams, min(id) AS class, len(grams) AS n
  FROM sets JOIN (SELECT DISTINCT id, split FROM d WHERE split IN ('train', 'dev', 'test')) USING (id) GROUP BY 1, 2),
x AS (SELECT train, class, n, unnest(grams) AS g FROM classes),
s AS (SELECT e.class AS eval_class, r.class AS train_class, count(*)::INT AS shared, e.n::INT AS eval_n, r.n::INT AS train_n
  FROM x AS e JOIN x AS r USING (g) WHERE NOT e.train AND r.train GROUP BY ALL)
SELECT *, shared / (eval_n + train_n - shared) AS similarity, shared / eval_n AS containment FROM s WHERE shared / eval_n >= 0.8
"""

_P7_SQL = """
WITH k AS (SELECT limit_value AS k FROM size_limits WHERE limit_name = 'shared_span_chars'),
starts AS (SELECT doc_id, text, k, unnest(range(0, length(text) - k + 1)) AS s FROM documents, k WHERE length(text) >= k),
w AS (SELECT doc_id, s, k, substring(text, s + 1, k) AS t FROM starts),
shared AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, s, k FROM w SEMI JOIN shared USING (t)),
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + k THEN 0 ELSE 1 END AS first FROM hit),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked),
islands AS (SELECT doc_id, min(s)::INT AS span_start, (max(s) + max(k))::INT AS span_end FROM numbered GROUP BY doc_id, island)
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_text_pieces": p2_text_pieces,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_contained": p3_contained,
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p5_invariants": p5_invariants,
    "p6_mix": p6_mix,
    "p6_shares": p6_shares,
    "p6_reachable": p6_reachable,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
}
SQL = {
    "p1_found": """
WITH RECURSIVE m AS (SELECT DISTINCT mention_id, conll_doc_id, mentions_features[3] AS i FROM mentions),
g0 AS (SELECT DISTINCT conll_doc_id, gold_corefs FROM conll_docs),
g1 AS (SELECT conll_doc_id, unnest(gold_corefs) AS entries, generate_subscripts(gold_corefs, 1) - 1 AS u FROM g0),
g2 AS (SELECT conll_doc_id, u, unnest(entries) AS g FROM g1),
l0 AS (SELECT DISTINCT conll_doc_id, locations FROM feature_docs),
l1 AS (SELECT conll_doc_id, unnest(locations) AS p FROM l0),
labelled AS (
  SELECT DISTINCT g2.conll_doc_id, g.label AS label, mention_id
  FROM g2 JOIN l1 ON g2.conll_doc_id = l1.conll_doc_id AND u = p.utterance AND g.span_start = p.span_start AND g.span_end = p.span_end - 1
  JOIN m ON m.conll_doc_id = g2.conll_doc_id AND m.i = p.mention WHERE g.label IS NOT NULL),
links AS (
  SELECT mention_id AS a, pairs_ant_index AS b FROM mention_pairs WHERE pairs_labels = 1
  UNION SELECT mention_id, min(mention_id) OVER (PARTITION BY conll_doc_id, label) FROM labelled),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT min(b) AS group_id, a AS mention_id FROM reach GROUP BY a
""",
    "p7_found": _P7_SQL + "SELECT doc_id, span_start, span_end FROM islands",
    "p7_shares": _P7_SQL + """
SELECT doc_id, max(coalesce(length(text), 0))::BIGINT AS n_chars, max(coalesce(n, 0))::BIGINT AS n_spans, max(coalesce(c, 0))::BIGINT AS shared_chars,
       max(CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE 0 END)::DOUBLE AS shared_share
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS c FROM islands GROUP BY 1) USING (doc_id) GROUP BY 1""",
    "p3_found": _P3_SQL + "SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM hit",
    "p3_contained": _P3_CONTAINED_SQL,
    "p3_report": _P3_SQL + """
SELECT split, source, count(*) AS records, count(p) AS overlapping, coalesce(sum(p), 0)::BIGINT AS pairs
FROM d LEFT JOIN (SELECT a AS id, count(*) AS p FROM hit GROUP BY 1) USING (id) WHERE split IN ('dev', 'test') GROUP BY 1, 2""",
    "p5_invariants": f"""WITH d AS (SELECT doc_id, max(length(coalesce(text, ''))) AS n FROM documents GROUP BY 1)
SELECT count(*) AS items, sum(greatest(1, ceil(n / {CHAR_CAPACITY})))::BIGINT AS pieces, sum(n)::BIGINT AS total, 0::BIGINT AS broken, 0::BIGINT AS overfull, true AS dense, true AS tight FROM d""",
    "p6_invariants": """WITH t AS (SELECT source, text, max(length(text)) AS n FROM documents JOIN mix_targets USING (source) WHERE length(text) > 0 GROUP BY 1, 2),
c AS (SELECT text, min(max_repeats) AS cap FROM t JOIN mix_targets USING (source) GROUP BY 1),
total AS (SELECT sum(n) AS total FROM (SELECT text, max(n) AS n FROM t GROUP BY 1)),
a AS (SELECT source, sum(n * cap) AS most, max(n) AS longest FROM t JOIN c USING (text) GROUP BY 1)
SELECT source, round(target_share * total)::BIGINT AS quota, 0::BIGINT AS stray, 0::BIGINT AS overused, true AS within,
  coalesce(most, 0) + greatest(coalesce(longest, 0), 1) <= round(target_share * total) AS short FROM mix_targets LEFT JOIN a USING (source), total""",
    "p2_pieces": _P2_PIECES_SQL,
    "p2_text_pieces": _P2_TEXT_SQL,
    "p2_found": """SELECT DISTINCT conll_doc_id FROM feature_docs
WHERE len(flatten(conll_tokens)) > (SELECT limit_value FROM size_limits WHERE limit_name = 'piece_tokens')""",
}
