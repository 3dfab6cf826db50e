"""Queries over texts and tokens: cleaning, annotation, mention extraction, corpora."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corefold.functions import lexical
from corefold.operators import annotate, candidates, embed, mentions
from corefold.runtime import table
from corefold.sources import conll


def features(spark, d):
    """feature_docs with each document once (repeated rows are exact copies)."""
    return table(spark, d, "feature_docs").dropDuplicates(["conll_doc_id"]).withColumnRenamed("conll_doc_id", "doc_id")


def docs(spark, d):
    return table(spark, d, "conll_docs").dropDuplicates(["conll_doc_id"]).withColumnRenamed("conll_doc_id", "doc_id")


def project_tokens(spark, d):
    """(doc_id, utt_idx, i, word): the corpus tokens by utterance."""
    utts = features(spark, d).select("doc_id", F.posexplode("conll_tokens").alias("utt_idx", "u"))
    return utts.select("doc_id", "utt_idx", F.posexplode("u").alias("i", "word"))


def project_gold(spark, d):
    """(doc_id, utt_idx, start, end, label) of the gold entries, ends exclusive."""
    utts = docs(spark, d).select("doc_id", F.posexplode("gold_corefs").alias("utt_idx", "u"))
    g = utts.select("doc_id", "utt_idx", F.explode("u").alias("g"))
    return g.select("doc_id", "utt_idx", F.col("g.span_start").alias("start"), (F.col("g.span_end") + 1).alias("end"), F.col("g.label").alias("label")).where("label is not null").distinct()


def project_places(spark, d):
    """(doc_id, utt_idx, start, end, m_idx) of the detected mentions."""
    p = features(spark, d).select("doc_id", F.explode("locations").alias("p"))
    return p.select("doc_id", F.col("p.utterance").alias("utt_idx"), F.col("p.span_start").alias("start"), F.col("p.span_end").alias("end"), F.col("p.mention").alias("m_idx"))


def clean_tokens(spark, d):
    t = project_tokens(spark, d).select(lexical.clean_token(F.col("word")).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def normalised_tokens(spark, d):
    t = project_tokens(spark, d).select(lexical.normalise_inference(F.col("word")).alias("inference"), lexical.normalise_training(F.col("word")).alias("training"))
    return t.groupBy("inference", "training").agg(F.count(F.lit(1)).alias("n"))


def utterance_texts(spark, d):
    utts = features(spark, d).select("doc_id", F.posexplode("conll_tokens").alias("utt_idx", "u"))
    return utts.select("doc_id", "utt_idx", F.md5(lexical.to_bytes(lexical.utterance_text(F.col("u")))).alias("text_md5"))


def genres(spark, d):
    return docs(spark, d).groupBy(lexical.genre(F.col("name")).alias("genre")).agg(F.count(F.lit(1)).alias("documents"))


def speaker_parts(spark, d):
    said = docs(spark, d).select("doc_id", F.explode("utts_speakers").alias("speaker")).where("speaker is not null and speaker <> '-'")
    parts = said.select(lexical.squeeze_name(F.col("speaker")).alias("squeezed"), F.explode(lexical.name_tokens(F.col("speaker"))).alias("part"))
    return parts.groupBy("squeezed", "part").agg(F.count(F.lit(1)).alias("n"))


def cache_names(spark, d):
    return docs(spark, d).select("doc_id", lexical.cache_name(F.col("name"), F.col("source")).alias("file"))


def annotated_tokens(spark, d):
    t = annotate.annotate(table(spark, d, "documents"))
    sums = [F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in ("sent_idx", "tok_idx", "head", "l_edge", "r_edge", "n_lefts", "ent_iob", "start_char", "end_char")]
    return t.groupBy("tag", "pos", "dep", "ent_type").agg(F.count(F.lit(1)).alias("n"), *sums)


def sentence_counts(spark, d):
    t = annotate.annotate(table(spark, d, "documents"))
    per = t.groupBy("doc_id", "sent_idx").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("doc_id", "sent_idx", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("tokens_before"))


def _spans(profile):
    return lambda spark, d: mentions.extract_spans(annotate.annotate(table(spark, d, "documents")), profile).select("doc_id", "start", "end")


def document_mentions(spark, d):
    """The mentions table of the documents. Their tokens are not written."""
    return mentions.detect_mentions(annotate.annotate(table(spark, d, "documents")))


def mention_attributes(spark, d):
    m = document_mentions(spark, d)
    return m.select("doc_id", "m_idx", "start", "end", "root", "sent_idx", "mention_type", "span_lower", F.array_join("content_words", " ").alias("content"), "nested", "ent_label")


def candidate_counts(spark, d):
    return candidates.count_pairs(document_mentions(spark, d), 50, 500)


def undetected_gold(spark, d):
    keys = ["doc_id", "utt_idx", "start", "end"]
    return project_gold(spark, d).join(project_places(spark, d).select(*keys).distinct(), keys, "left_anti")


def gold_labels(spark, d):
    keys = ["doc_id", "utt_idx", "start", "end"]
    labels = project_gold(spark, d).groupBy(*keys).agg(F.min("label").alias("gold_label"))
    return project_places(spark, d).join(labels, keys, "left").select("doc_id", "m_idx", "gold_label")


def unknown_words(spark, d):
    """Words of the documents that the corpus vocabulary lacks, with their number of documents."""
    t = annotate.annotate(table(spark, d, "documents")).select(F.col("lower").alias("word"), "doc_id")
    known = project_tokens(spark, d).select(F.lit("static").alias("kind"), F.lower("word").alias("word"))
    return embed.words_outside(t, known).groupBy("word").agg(F.countDistinct("doc_id").alias("documents"))


def bracket_round_trip(spark, d):
    """Gold spans written as bracket column and read back."""
    keep = project_tokens(spark, d).select(F.col("doc_id").alias("doc"), "utt_idx", F.col("i").alias("tok_idx"))
    sizes = keep.groupBy("doc", "utt_idx").agg(F.max("tok_idx").alias("last"))
    gold = project_gold(spark, d).withColumnRenamed("doc_id", "doc").join(sizes, ["doc", "utt_idx"]).where("end - 1 <= last and start >= 0 and end > start")
    order = F.row_number().over(Window.partitionBy("doc", "utt_idx").orderBy("start", F.col("end").desc(), "label"))
    spans = gold.select("doc", "utt_idx", "start", (F.col("end") - 1).alias("end"), F.col("label").alias("cluster"), order.alias("m_idx"))
    back = conll.parse_brackets(conll.coref_column(keep, spans))
    return back.groupBy("doc", "utt_idx", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends")).withColumnRenamed("doc", "doc_id")


def _sql_list(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_F = "f AS (SELECT DISTINCT conll_doc_id AS doc_id, conll_tokens, locations FROM feature_docs)"
_C = "c AS (SELECT DISTINCT conll_doc_id AS doc_id, name, source, utts_speakers, gold_corefs FROM conll_docs)"
_U = _F + ", u AS (SELECT doc_id, unnest(conll_tokens) AS u, generate_subscripts(conll_tokens, 1) - 1 AS utt_idx FROM f)"
_W = _U + ", w AS (SELECT doc_id, utt_idx, unnest(u) AS word, generate_subscripts(u, 1) - 1 AS i FROM u)"
GOLD = (
    _C
    + """, g1 AS (SELECT doc_id, unnest(gold_corefs) AS e, generate_subscripts(gold_corefs, 1) - 1 AS utt_idx FROM c),
g2 AS (SELECT doc_id, utt_idx, unnest(e) AS g FROM g1),
gold AS (SELECT DISTINCT doc_id, utt_idx, g.span_start AS "start", g.span_end + 1 AS "end", g.label AS label FROM g2 WHERE g.label IS NOT NULL)"""
)
PLACES = """p1 AS (SELECT doc_id, unnest(locations) AS p FROM f),
places AS (SELECT doc_id, p.utterance AS utt_idx, p.span_start AS "start", p.span_end AS "end", p.mention AS m_idx FROM p1)"""

_CLASSES = " ".join(f"WHEN lower IN {_sql_list(words)} THEN '{tag}'" for tag, words in annotate.WORD_CLASSES.items())
_POS = " ".join(f"WHEN '{tag}' THEN '{pos}'" for tag, pos in annotate.POS_OF_TAG.items())
_PATTERN = annotate.TOKEN_PATTERN.replace("'", "''")
TOKENS = f"""
t0 AS (SELECT doc_id, regexp_extract_all(text, '{_PATTERN}', 1) AS w, regexp_extract_all(text, '{_PATTERN}', 2) AS ws, length(regexp_extract(text, '^\\s*', 0)) AS lead FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t1 AS (SELECT doc_id, lead, unnest(w) AS text, unnest(ws) AS ws, generate_subscripts(w, 1) - 1 AS tok_idx FROM t0),
t2 AS (SELECT *, lower(text) AS lower, lead + coalesce(sum(length(text) + length(ws)) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char,
         coalesce(lag(text IN ('.', '!', '?') OR contains(ws, chr(10))) OVER d, false)::INT AS new FROM t1 WINDOW d AS (PARTITION BY doc_id ORDER BY tok_idx)),
t3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS sent_idx FROM t2),
t4 AS (SELECT *, CASE {_CLASSES} WHEN regexp_full_match(text, '\\p{{N}}+') THEN 'CD' WHEN NOT regexp_matches(text, '^[\\p{{L}}\\p{{N}}]') THEN 'SYM'
         WHEN regexp_matches(text, '^\\p{{Lu}}') AND tok_idx > 0 AND new = 0 THEN 'NNP' ELSE 'NN' END AS tag FROM t3),
t5 AS (SELECT *, tag IN ('DT', 'NN', 'NNP') AS inside, lag(tag) OVER s AS prev, min(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS first, max(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS root
       FROM t4 WINDOW s AS (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)),
t6 AS (SELECT *, (inside AND (tag = 'DT' OR coalesce(prev NOT IN ('DT', 'NN', 'NNP'), true)))::INT AS opens FROM t5),
t7 AS (SELECT *, CASE WHEN inside THEN sum(opens) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) END AS chunk FROM t6),
t8 AS (SELECT *, CASE WHEN inside THEN min(tok_idx) OVER k ELSE tok_idx END AS c_first, CASE WHEN inside THEN max(tok_idx) OVER k ELSE tok_idx END AS c_last,
         bool_or(opens = 1 AND coalesce(prev = 'IN', false)) OVER k AS c_in FROM t7 WINDOW k AS (PARTITION BY doc_id, sent_idx, chunk)),
t9 AS (SELECT *, CASE WHEN tok_idx = root THEN tok_idx WHEN tok_idx = c_last THEN root ELSE c_last END AS head,
         CASE WHEN inside THEN CASE WHEN tok_idx <> c_last THEN CASE WHEN tag = 'DT' THEN 'det' ELSE 'compound' END WHEN chunk = 1 THEN 'nsubj' WHEN c_in THEN 'pobj' ELSE 'dobj' END
              WHEN tok_idx = root AND tag IN ('.', ',', 'SYM') THEN 'ROOT' WHEN tag = 'PRP' THEN 'nsubj' WHEN tag = 'PRP$' THEN 'poss' WHEN tag = 'IN' THEN 'prep'
              WHEN tag = 'CC' THEN 'cc' WHEN tag = 'POS' THEN 'case' WHEN tag = 'CD' THEN 'nummod' ELSE 'punct' END AS dep FROM t8),
tok AS (SELECT doc_id, sent_idx, tok_idx, text, lower, ws, tag, CASE tag {_POS} END AS pos, dep, head,
          CASE WHEN tok_idx = root THEN first WHEN tok_idx = c_last THEN c_first ELSE tok_idx END AS l_edge, tok_idx AS r_edge,
          CASE WHEN tok_idx = root THEN sum((head = root AND tok_idx <> root)::INT) OVER (PARTITION BY doc_id, sent_idx) WHEN tok_idx = c_last THEN tok_idx - c_first ELSE 0 END AS n_lefts,
          CASE WHEN tag <> 'NNP' THEN 2 WHEN coalesce(prev = 'NNP', false) THEN 1 ELSE 3 END AS ent_iob, CASE WHEN tag = 'NNP' THEN 'PERSON' END AS ent_type,
          start_char, start_char + length(text) AS end_char FROM t9)
"""
_REMOVED = f"(pos IN {_sql_list(mentions.REMOVE_POS)} OR lower IN {_sql_list(mentions.REMOVE_WORDS)})"


def _spans_sql(profile: str) -> str:
    """The rules as they apply to the stand-in annotation, which has neither possessive nor marker candidates."""
    guarded = profile == "inference"
    if guarded:
        keep = f"tag IN {_sql_list(mentions.KEEP_TAGS)} AND NOT (dep IN {_sql_list(mentions.LEAVE_DEPS)} AND dep NOT IN {_sql_list(mentions.KEEP_DEPS)})"
    else:
        keep = f"((regexp_matches(tag, '^(N|PRP|DT|IN)') AND dep NOT IN {_sql_list(mentions.LEAVE_DEPS)}) OR dep IN {_sql_list(mentions.KEEP_DEPS)})"
    bound_last, bound_first = ("b.s_first", "b.s_last") if guarded else ("lo - 1", "e.prev_stay + 100000000")
    trimmed = f"""SELECT x.*, greatest(lo, least(coalesce(b.next_stay, 2000000000), last + 1, coalesce({bound_first}, 2000000000))) AS "start", last + 1 AS "end" FROM (
      SELECT x.*, least(hi, greatest(coalesce(e.prev_stay, -1), lo - 1, {bound_last})) AS last FROM %s AS x JOIN st AS e ON e.doc_id = x.doc_id AND e.tok_idx = hi JOIN st AS b ON b.doc_id = x.doc_id AND b.tok_idx = lo
    ) AS x JOIN st AS e ON e.doc_id = x.doc_id AND e.tok_idx = hi JOIN st AS b ON b.doc_id = x.doc_id AND b.tok_idx = lo"""
    plain = "" if guarded else (
        f""", np2 AS (SELECT n.doc_id, n.tok_idx, least(coalesce(q_min, n.tok_idx), n.tok_idx) AS lo, greatest(coalesce(q_max, n.tok_idx), n.tok_idx) AS hi FROM np AS n JOIN cand USING (doc_id, tok_idx)
      WHERE n."end" > n."start" AND EXISTS (SELECT 1 FROM tok AS z WHERE z.doc_id = n.doc_id AND z.tok_idx >= n."start" AND z.tok_idx < n."end" AND z.dep IN ('conj', 'prep'))),
    np3 AS ({trimmed % "np2"})"""
    )
    return f"""{TOKENS}, st AS (SELECT doc_id, tok_idx, max(CASE WHEN NOT {_REMOVED} THEN tok_idx END) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) AS prev_stay,
      min(CASE WHEN NOT {_REMOVED} THEN tok_idx END) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_stay,
      min(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS s_first, max(tok_idx) OVER (PARTITION BY doc_id, sent_idx) AS s_last FROM tok),
    ch AS (SELECT doc_id, head AS tok_idx, min(l_edge) AS c_min, max(r_edge) AS c_max, min(CASE WHEN dep NOT IN ('conj', 'prep') THEN l_edge END) AS q_min, max(CASE WHEN dep NOT IN ('conj', 'prep') THEN r_edge END) AS q_max
      FROM tok WHERE head <> tok_idx GROUP BY 1, 2),
    cand AS (SELECT tok.*, q_min, q_max, least(coalesce(c_min, tok_idx), tok_idx) AS lo, greatest(coalesce(c_max, tok_idx), tok_idx) AS hi FROM tok LEFT JOIN ch USING (doc_id, tok_idx)
      WHERE lower NOT IN {_sql_list(mentions.NO_COREF_WORDS)} AND {keep}),
    np AS ({trimmed % "(SELECT doc_id, tok_idx, lo, hi FROM cand WHERE tag NOT IN ('PRP', 'PRP$'))"}){plain},
    ent AS (SELECT doc_id, min(tok_idx) AS "start", max(tok_idx) + 1 AS "end", min(ent_type) AS label, min(sent_idx) AS sent_idx FROM (
      SELECT *, sum((ent_iob = 3)::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS e FROM tok) WHERE ent_type IS NOT NULL GROUP BY doc_id, e),
    spans AS (SELECT doc_id, tok_idx::INT AS "start", (tok_idx + 1)::INT AS "end" FROM cand WHERE tag IN ('PRP', 'PRP$')
      UNION SELECT doc_id, l_edge, r_edge + 1 FROM cand WHERE tag IN ('PRP', 'PRP$') AND n_lefts > 0
      UNION SELECT doc_id, "start", "end" FROM np WHERE "end" > "start" {'' if guarded else 'UNION SELECT doc_id, "start", "end" FROM np3 WHERE "end" > "start"'}
      UNION SELECT doc_id, "start", "end" FROM ent)"""


_DESCRIBED = """,
    sp AS (SELECT s.doc_id, s."start", s."end", min(start_char) AS start_char, min(CASE WHEN head < s."start" OR head >= s."end" OR head = tok_idx THEN tok_idx END) AS root, min(sent_idx) AS sent_idx,
      bool_or(tag IN ('CC', ',') AND ent_type IS NULL) AS is_list, lower(rtrim(string_agg(text || ws, '' ORDER BY tok_idx), ' ' || chr(10) || chr(13) || chr(9))) AS span_lower,
      list(lower ORDER BY tok_idx) FILTER (tag IN ('NN', 'NNS', 'NNP', 'NNPS')) AS words
      FROM spans AS s JOIN tok AS t ON t.doc_id = s.doc_id AND t.tok_idx >= s."start" AND t.tok_idx < s."end" GROUP BY 1, 2, 3),
    men AS (SELECT sp.*, r.tag AS root_tag, r.lower AS root_lower, row_number() OVER (PARTITION BY sp.doc_id ORDER BY root, "start", "end") - 1 AS m_idx,
      CASE WHEN is_list THEN 3 WHEN r.tag IN ('PRP', 'PRP$') THEN 0 WHEN r.ent_type IS NOT NULL OR r.tag IN ('NNP', 'NNPS') THEN 2 ELSE 1 END AS mention_type
      FROM sp JOIN tok AS r ON r.doc_id = sp.doc_id AND r.tok_idx = sp.root)"""
_MENTIONS = _spans_sql("inference") + _DESCRIBED


def mentions_sql(profile: str) -> str:
    """CTEs up to ``men``, the mentions of a table ``documents`` (doc_id, text), and ``ent``, the entities."""
    return _spans_sql(profile) + _DESCRIBED


QUERIES = {
    "clean_tokens": clean_tokens,
    "normalised_tokens": normalised_tokens,
    "utterance_texts": utterance_texts,
    "genres": genres,
    "speaker_parts": speaker_parts,
    "cache_names": cache_names,
    "annotated_tokens": annotated_tokens,
    "sentence_counts": sentence_counts,
    "spans_inference": _spans("inference"),
    "spans_training": _spans("training"),
    "mention_attributes": mention_attributes,
    "candidate_counts": candidate_counts,
    "undetected_gold": undetected_gold,
    "gold_labels": gold_labels,
    "unknown_words": unknown_words,
    "bracket_round_trip": bracket_round_trip,
}
SQL = {
    "clean_tokens": f"""WITH {_W}, plain AS (SELECT map(['/.', '/?', '-LRB-', '-RRB-', '-LCB-', '-RCB-', '-LSB-', '-RSB-'], ['.', '?', '(', ')', '{{', '}}', '[', ']']) AS m)
      SELECT CASE WHEN word IN ('/', '%', '*') THEN word ELSE coalesce(nullif(translate(coalesce(m[word], word, ''), '/%*', ''), ''), ',') END AS token, count(*) AS n FROM w, plain GROUP BY 1""",
    "normalised_tokens": f"""WITH {_W} SELECT CASE WHEN regexp_full_match(word, '\\d+') THEN '0' ELSE lower(word) END AS inference,
      coalesce(regexp_replace(lower(word), '\\d', '0', 'g'), '<missing>') AS training, count(*) AS n FROM w GROUP BY 1, 2""",
    "utterance_texts": f"WITH {_U} SELECT doc_id, utt_idx, md5(array_to_string(list_transform(u, lambda x: x || ' '), '')) AS text_md5 FROM u",
    "genres": f"WITH {_C} SELECT CASE left(name, 2) WHEN 'bc' THEN 0 WHEN 'bn' THEN 1 WHEN 'mz' THEN 2 WHEN 'nw' THEN 3 WHEN 'pt' THEN 4 WHEN 'tc' THEN 5 WHEN 'wb' THEN 6 END AS genre, count(*) AS documents FROM c GROUP BY 1",
    "speaker_parts": f"""WITH {_C}, s AS (SELECT unnest(utts_speakers) AS s FROM c), k AS (SELECT s FROM s WHERE s IS NOT NULL AND s <> '-'),
      x AS (SELECT regexp_replace(lower(s), '\\s+|_+', '', 'g') AS squeezed, unnest(regexp_split_to_array(lower(s), '\\s+|_+')) AS part FROM k) SELECT squeezed, part, count(*) AS n FROM x GROUP BY 1, 2""",
    "cache_names": f"WITH {_C} SELECT doc_id, concat_ws('.', sha256(name), sha256(source)) AS file FROM c",
    "annotated_tokens": f"""WITH {TOKENS} SELECT tag, pos, dep, ent_type, count(*) AS n, sum(sent_idx)::BIGINT AS sum_sent_idx, sum(tok_idx)::BIGINT AS sum_tok_idx, sum(head)::BIGINT AS sum_head, sum(l_edge)::BIGINT AS sum_l_edge,
      sum(r_edge)::BIGINT AS sum_r_edge, sum(n_lefts)::BIGINT AS sum_n_lefts, sum(ent_iob)::BIGINT AS sum_ent_iob, sum(start_char)::BIGINT AS sum_start_char, sum(end_char)::BIGINT AS sum_end_char FROM tok GROUP BY 1, 2, 3, 4""",
    "sentence_counts": f"""WITH {TOKENS}, n AS (SELECT doc_id, sent_idx, count(*) AS n FROM tok GROUP BY 1, 2)
      SELECT doc_id, sent_idx::INT AS sent_idx, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before FROM n""",
    "spans_inference": f'WITH {_spans_sql("inference")} SELECT doc_id, "start"::INT AS "start", "end"::INT AS "end" FROM spans',
    "spans_training": f'WITH {_spans_sql("training")} SELECT doc_id, "start"::INT AS "start", "end"::INT AS "end" FROM spans',
    "mention_attributes": f"""WITH {_MENTIONS} SELECT doc_id, m_idx::INT AS m_idx, "start"::INT AS "start", "end"::INT AS "end", root::INT AS root, sent_idx::INT AS sent_idx, mention_type, span_lower,
      coalesce(array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' '), '') AS content,
      EXISTS (SELECT 1 FROM men AS o WHERE o.doc_id = men.doc_id AND o.sent_idx = men.sent_idx AND o.m_idx <> men.m_idx AND o."start" <= men."start" AND o."end" >= men."end") AS nested,
      (SELECT min_by(label, e."start") FROM ent AS e WHERE e.doc_id = men.doc_id AND e."start" <= men."start" AND men."end" <= e."end") AS ent_label FROM men""",
    "candidate_counts": f"""WITH {_MENTIONS}, word AS (SELECT DISTINCT doc_id, m_idx, unnest(words) AS word FROM men),
      p AS (SELECT b.doc_id, b.m_idx AS men_idx, a.m_idx AS ant_idx FROM men AS b JOIN men AS a ON a.doc_id = b.doc_id AND a.m_idx < b.m_idx AND a.m_idx >= b.m_idx - 50
        UNION SELECT b.doc_id, b.m_idx, a.m_idx FROM word AS b JOIN word AS a ON a.doc_id = b.doc_id AND a.word = b.word AND a.m_idx < b.m_idx AND a.m_idx >= b.m_idx - 500)
      SELECT doc_id, men_idx::INT AS men_idx, count(*) AS n, min(ant_idx)::INT AS first, sum(ant_idx)::BIGINT AS total FROM p GROUP BY 1, 2""",
    "undetected_gold": f'WITH {_F}, {GOLD}, {PLACES} SELECT doc_id, utt_idx, "start", "end", label FROM gold ANTI JOIN places USING (doc_id, utt_idx, "start", "end")',
    "gold_labels": f"""WITH {_F}, {GOLD}, {PLACES}, l AS (SELECT doc_id, utt_idx, "start", "end", min(label) AS gold_label FROM gold GROUP BY 1, 2, 3, 4)
      SELECT doc_id, m_idx, gold_label FROM places LEFT JOIN l USING (doc_id, utt_idx, "start", "end")""",
    "unknown_words": f"WITH {_W}, {TOKENS} SELECT lower AS word, count(DISTINCT doc_id) AS documents FROM tok WHERE lower NOT IN (SELECT lower(word) FROM w WHERE word IS NOT NULL) GROUP BY 1",
    "bracket_round_trip": f"""WITH {_U}, {GOLD}, s AS (SELECT doc_id, utt_idx, len(u) AS n FROM u)
      SELECT doc_id, utt_idx, label, count(*) AS n, sum("start")::BIGINT AS starts, sum("end" - 1)::BIGINT AS ends FROM gold JOIN s USING (doc_id, utt_idx) WHERE "end" <= s.n AND "end" > "start" AND "start" >= 0 GROUP BY 1, 2, 3""",
}
