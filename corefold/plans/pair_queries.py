"""Queries over mentions and candidate pairs: features, links, clusters, resolution, training data, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corefold.functions import features as feat
from corefold.functions.lexical import MISSING_WORD, UNKNOWN_WORD
from corefold.operators import coref, dialogue, embed, metrics, pairs, scoring, training
from corefold.plans.text_queries import _C, _F, _U, _W, GOLD, PLACES, docs, features, project_gold, project_places, project_tokens
from corefold.runtime import stash, table
from corefold.sources.vectors import global_rows


def mention_rows(spark, d):
    """(mention_id, doc_id, m_idx, f, ...) with each mention once."""
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"]).withColumnRenamed("conll_doc_id", "doc_id")
    return m.withColumn("m_idx", F.get("mentions_features", F.lit(2)))


def pair_rows(spark, d):
    """(pair_row, doc_id, men_idx, ant_idx, f, label): each candidate pair once, with indices in the document."""
    p = table(spark, d, "mention_pairs").dropDuplicates(["pair_row"]).select("pair_row", F.col("conll_doc_id").alias("doc_id"), "mention_id", "pairs_ant_index", F.col("pairs_features").alias("f"), F.col("pairs_labels").alias("label"))
    base = mention_rows(spark, d).groupBy("doc_id").agg(F.min(F.col("mention_id") - F.col("m_idx")).alias("base"))
    return p.join(base, "doc_id").select("pair_row", "doc_id", "mention_id", (F.col("mention_id") - F.col("base")).cast("int").alias("men_idx"), (F.col("pairs_ant_index") - F.col("base")).cast("int").alias("ant_idx"), "f", "label")


def links(spark, d):
    """Best antecedents by the rule score; a mention's single score is 0."""
    scored = scoring.rule_scores(pair_rows(spark, d)).select("doc_id", "men_idx", "ant_idx", "score")
    single = mention_rows(spark, d).select("doc_id", "m_idx", F.lit(0.0).alias("score"))
    return coref.best_links(scored, single)


def members(spark, d):
    return coref.forest_roots(links(spark, d))


def mention_types(spark, d):
    return mention_rows(spark, d).select("doc_id", "m_idx", F.get("mentions_features", F.lit(0)).alias("mention_type"))


def found_clusters(spark, d):
    return coref.clusters(members(spark, d), mention_types(spark, d))


def located_mentions(spark, d):
    """(doc_id, m_idx, start, end, text): mentions as ranges of the document's tokens, clipped to their utterance."""
    sizes = features(spark, d).select("doc_id", F.posexplode(F.transform("conll_tokens", F.size)).alias("utt_idx", "n"))
    before = Window.partitionBy("doc_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    placed = project_places(spark, d).join(base, ["doc_id", "utt_idx"])
    m = placed.select("doc_id", "m_idx", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.least("end", "n")).alias("end")).where("end > start")
    words = features(spark, d).select("doc_id", F.flatten("conll_tokens").alias("w"))
    return m.join(words, "doc_id").select("doc_id", "m_idx", "start", "end", F.array_join(F.slice("w", F.col("start") + 1, F.col("end") - F.col("start")), " ").alias("text"))


def document_tokens(spark, d):
    """(doc_id, tok_idx, text, ws): the corpus tokens of a document in one sequence, each followed by a blank."""
    return features(spark, d).select("doc_id", F.posexplode(F.flatten("conll_tokens")).alias("tok_idx", "text")).withColumn("ws", F.lit(" "))


def pair_offsets(spark, d):
    m = mention_rows(spark, d).select("doc_id", "m_idx")
    return pairs.pair_offsets(pair_rows(spark, d), m)


def unbounded_pairs(spark, d):
    """Documents whose candidate pairs are not all N (N - 1) / 2 pairs of their mentions, by enumeration of all of them."""
    every = pairs.band_pairs(mention_rows(spark, d).select("doc_id", "m_idx"), None).groupBy("doc_id").agg(F.count(F.lit(1)).alias("enumerated"))
    given = pair_rows(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("p"))
    sizes = mention_rows(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.join(given, "doc_id", "left").join(every, "doc_id", "left").na.fill(0)
    return both.select("doc_id", "n", "p", "enumerated", (F.col("p") == F.col("n") * (F.col("n") - 1) / 2).alias("complete"))


def distance_bins(spark, d):
    p = pair_rows(spark, d).select(F.posexplode(F.slice("f", 7, 2)).alias("kind", "distance")).select("kind", feat.distance_bin(F.col("distance")).alias("bin"), feat.bin_value(F.col("distance")).alias("value"))
    return p.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _with_mentions(spark, d):
    m = mention_rows(spark, d).select("doc_id", "m_idx", "mentions_features")
    both = pairs.with_sides(pair_rows(spark, d), m)
    return both.select("f", F.col("a.mentions_features").alias("af"), F.col("m.mentions_features").alias("mf"))


def decoded_pairs(spark, d):
    """Sums of the 70 positions of the dense pair vectors."""
    v = _with_mentions(spark, d).select(feat.decode_pair(F.col("f"), F.col("af"), F.col("mf")).alias("v"))
    sums = v.agg(*[F.sum(F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(70)])
    return sums.select(F.posexplode(F.array(*[f"s{i}" for i in range(70)])).alias("position", "total")).select("position", F.round("total", 3).alias("total"))


def pair_labels(spark, d):
    """Labels made from gold labels, counted against the given ones."""
    labels = project_gold(spark, d).groupBy("doc_id", "utt_idx", "start", "end").agg(F.min("label").alias("gold_label"))
    m = project_places(spark, d).join(labels, ["doc_id", "utt_idx", "start", "end"], "left").select("doc_id", "m_idx", "gold_label")
    made = training.pair_labels(pair_rows(spark, d).withColumnRenamed("label", "given"), m)
    return made.groupBy("given", "label").agg(F.count(F.lit(1)).alias("n"))


def mention_labels(spark, d):
    labels = project_gold(spark, d).groupBy("doc_id", "utt_idx", "start", "end").agg(F.min("label").alias("gold_label"))
    m = project_places(spark, d).join(labels, ["doc_id", "utt_idx", "start", "end"], "left").select("doc_id", "m_idx", "gold_label")
    return training.mention_labels(m)


def best_links(spark, d):
    return links(spark, d)


def clusters(spark, d):
    return found_clusters(spark, d)


def representatives(spark, d):
    return coref.running_representative(coref.drop_singletons(members(spark, d)), mention_types(spark, d))


def chains(spark, d):
    """How many mentions each document's last mention reaches over links."""
    last = mention_rows(spark, d).groupBy("doc_id").agg(F.max("m_idx").alias("m_idx"))
    return coref.follow_chains(links(spark, d), last).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("m_idx").alias("first"))


def resolved_texts(spark, d):
    m = located_mentions(spark, d)
    out = coref.resolve(document_tokens(spark, d), found_clusters(spark, d), m)
    return out.select("doc_id", F.md5("resolved").alias("resolved_md5"))


def token_annotations(spark, d):
    a = coref.annotate_tokens(document_tokens(spark, d), found_clusters(spark, d), located_mentions(spark, d))
    return a.groupBy("doc_id").agg(F.sum(F.col("in_coref").cast("long")).alias("in_coref"), F.sum(F.size("clusters").cast("long")).alias("memberships"))


def span_annotations(spark, d):
    a = coref.annotate_spans(mention_rows(spark, d).select("doc_id", "m_idx"), found_clusters(spark, d))
    return a.groupBy("doc_id").agg(F.sum(F.col("is_coref").cast("long")).alias("coreferent"), F.count(F.lit(1)).alias("mentions"), F.max("cluster").alias("last_cluster"))


def score_maps(spark, d):
    scored = scoring.rule_scores(pair_rows(spark, d)).select("doc_id", "men_idx", "ant_idx", "score")
    single = mention_rows(spark, d).select("doc_id", "m_idx", F.lit(0.0).alias("score"))
    return coref.score_map(scored, single).select("doc_id", "m_idx", F.size("scores").alias("n"), F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def ranking_targets(spark, d):
    rows = pair_rows(spark, d).select("mention_id", F.col("ant_idx").alias("place"), "label")
    t = training.ranking_targets(rows)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.select("mention_id", text("labels").alias("labels"), F.round(F.aggregate("costs", F.lit(0.0), lambda a, x: a + x), 6).alias("cost"), text("true_ants").alias("true_ants"), text("false_ants").alias("false_ants"))


def length_batches(spark, d):
    return training.length_batches(mention_rows(spark, d), 20_000, length_col="mentions_pairs_length").groupBy("batch").agg(F.count(F.lit(1)).alias("mentions"), F.sum("length").alias("pairs"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


def padded_batches(spark, d):
    rows = pair_rows(spark, d).select("mention_id", F.col("ant_idx").alias("place"), "label")
    t = training.ranking_targets(rows).select("mention_id", "labels", "costs")
    b = training.length_batches(t.withColumn("n", F.size("labels") - 1), 20_000, length_col="n").select(F.col("id").alias("mention_id"), "batch")
    p = training.pad_batches(t.join(b, "mention_id"), ["labels", "costs"])
    return p.groupBy("batch").agg(F.count(F.lit(1)).alias("mentions"), F.max(F.size("labels")).alias("width"), F.min(F.size("labels")).alias("least"), F.sum(F.aggregate("mask", F.lit(0), lambda a, x: a + x)).alias("padding"))


def losses(spark, d):
    """The three losses of the rule score, scaled to a tenth, over the labelled pairs and the new-entity candidates."""
    scored = scoring.rule_scores(pair_rows(spark, d)).select("mention_id", (F.col("score") / 10).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))
    has = scored.groupBy("mention_id").agg(F.max("label").alias("has"))
    new = has.select("mention_id", F.lit(0.0).alias("score"), (1 - F.col("has")).alias("label"), F.when(F.col("has") == 1, training.COSTS["FN"]).otherwise(0.0).alias("cost"))
    pairs_ = scored.join(has, "mention_id").select("mention_id", "score", "label", F.when(F.col("has") == 1, training.COSTS["WL"] * (1 - F.col("label"))).otherwise(training.COSTS["FL"]).alias("cost"))
    rows = stash(pairs_.unionByName(new).withColumn("weight", F.lit(1.0)), "candidates")
    parts = [("all_pairs", training.all_pairs_loss), ("top_pairs", training.top_pairs_loss), ("ranking", training.ranking_loss)]
    out = [f(rows, 1000.0).select(F.lit(name).alias("name"), F.round("loss", 4).alias("loss")) for name, f in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def flat_rows(spark, d):
    m, _ = global_rows(mention_rows(spark, d).select("doc_id", "m_idx"), pair_rows(spark, d).select("doc_id", "men_idx", "ant_idx"))
    return m.select("doc_id", "m_idx", "flat_idx", "pairs_start")


def _sides(spark, d):
    """Gold clusters as key, clusters of best links as response; a mention is its utterance and range."""
    name = F.concat_ws(":", "utt_idx", "start", "end")
    key = project_gold(spark, d).select("doc_id", F.col("label").cast("long").alias("entity"), name.alias("mention"), F.lit(0).alias("seq"))
    places = project_places(spark, d).select("doc_id", "m_idx", name.alias("mention"))
    response = found_clusters(spark, d).join(places, ["doc_id", "m_idx"]).select("doc_id", F.col("cluster").cast("long").alias("entity"), "mention", F.col("m_idx").alias("seq"))
    return stash(key, "key"), stash(response, "response")


def coref_scores(spark, d):
    t = metrics.totals(metrics.document_counters(*_sides(spark, d), ceaf=False))
    return t.select("metric", *[F.round(c, 6).alias(c) for c in t.columns if c != "metric"])


def blanc_scores(spark, d):
    t = metrics.blanc_scores(metrics.blanc_counters(*_sides(spark, d)))
    return t.select("metric", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def ceaf_scores(spark, d):
    """All metrics with the optimal assignments, per metric, and the mean F1 of muc, bcub and ceafe."""
    t = metrics.totals(metrics.document_counters(*_sides(spark, d)))
    return t.crossJoin(F.broadcast(metrics.conll_average(t)))  # one row


def speaker_pairs(spark, d):
    """Consecutive utterances of a document by whether they have one speaker; missing speakers alternate."""
    u = docs(spark, d).select("doc_id", F.posexplode("utts_speakers").alias("place", "s")).select("doc_id", "place", F.when(F.col("s") != "-", F.col("s")).alias("speaker_id"), F.lit(None).cast("string").alias("last_speaker"))
    u = dialogue.default_speakers(u)
    order = Window.partitionBy("doc_id").orderBy("place")
    u = u.withColumn("before", F.lag("speaker_id").over(order)).where("before is not null")
    return u.groupBy("doc_id").agg(F.sum((F.col("speaker_id") == F.col("before")).cast("long")).alias("same"), F.count(F.lit(1)).alias("n"))


def running_sentences(spark, d):
    t = project_tokens(spark, d).groupBy("doc_id", "utt_idx").agg(F.sum(F.col("word").isin(".", "?", "!", "/.", "/?").cast("long")).alias("n_sents"))
    return dialogue.running_sentences(t.withColumnRenamed("doc_id", "conv_id")).withColumnRenamed("conv_id", "doc_id")


def label_means(spark, d):
    e = table(spark, d, "embeddings")
    means = embed.mean_vectors(e, ["label"], "embedding", 64)
    return means.select("label", "n", F.posexplode("vec").alias("dim", "mean")).select("label", "n", "dim", F.round("mean", 5).alias("mean"))


def corpus_vocabulary(spark, d):
    """An embeddings table over corpus words: a word's vector is that with the number of its digest, modulo the vectors' number; one word in five
    has none. Tuned for even labels, static for all; the unknown and the missing word have the first two.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "label", F.col("embedding").alias("vec"))
    n = e.count()
    words = project_tokens(spark, d).select(F.lower("word").alias("word")).where("word is not null").distinct()
    number = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    numbered = words.withColumn("number", number).where("number % 5 <> 0").select("word", F.pmod("number", F.lit(n)).alias("k"))
    reserved = spark.createDataFrame([(UNKNOWN_WORD, 0), (MISSING_WORD, 1)], "word string, k long")
    both = stash(numbered.unionByName(reserved).join(e, "k").select("word", "label", "vec"), "words")
    static = both.select(F.lit("static").alias("kind"), "word", "vec")
    return static.unionByName(both.where("label % 2 = 0").select(F.lit("tuned").alias("kind"), "word", "vec"))


def word_vectors(spark, d):
    """Per corpus word the vector found - tuned, static, or that of the unknown word - by its first entry and sum."""
    words = project_tokens(spark, d).select(F.lower("word").alias("key")).where("key is not null").distinct()
    v = embed.lookup(words, "key", corpus_vocabulary(spark, d))
    return v.select("key", F.round(F.get("vec", F.lit(0)), 5).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def fixed_layer(outputs, inputs):
    """A fixed, small weight matrix."""
    i, j = np.arange(outputs)[:, None], np.arange(inputs)[None, :]
    return ((i * 7 + j * 3) % 11 - 5) / 10.0, (np.arange(outputs) % 3 - 1) / 10.0


def network_scores(spark, d):
    layers = [fixed_layer(8, 64), fixed_layer(4, 8), fixed_layer(1, 4)]
    s = scoring.score_vectors(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features")), layers)
    return s.select("vec_id", F.round("score", 5).alias("score"))


VECTORS = """nv AS (SELECT count(*) AS n FROM embeddings), vw AS (SELECT DISTINCT lower(word) AS word FROM w WHERE word IS NOT NULL),
vn AS (SELECT word, ('0x' || substring(md5(word), 1, 8))::BIGINT AS number FROM vw),
vk AS (SELECT word, number % n AS k FROM vn, nv WHERE number % 5 <> 0 UNION ALL SELECT '*UNK*', 0 UNION ALL SELECT '<missing>', 1),
voc AS (SELECT word, CASE WHEN label % 2 = 0 THEN embedding END AS tuned, embedding AS static FROM vk JOIN embeddings ON vec_id = k)"""
_MEN = """men AS (SELECT DISTINCT mention_id, conll_doc_id AS doc_id, mentions_features AS mf, mentions_features[3] AS m_idx, mentions_pairs_length FROM mentions),
base AS (SELECT doc_id, min(mention_id - m_idx) AS base FROM men GROUP BY 1),
pr AS (SELECT DISTINCT pair_row, conll_doc_id AS doc_id, mention_id, (mention_id - base)::INT AS men_idx, (pairs_ant_index - base)::INT AS ant_idx, pairs_features AS f, pairs_labels AS label
  FROM mention_pairs JOIN base ON base.doc_id = conll_doc_id)"""
_BIN = "((x >= 1)::INT + (x >= 2)::INT + (x >= 3)::INT + (x >= 4)::INT + (x >= 5)::INT + (x >= 8)::INT + (x >= 16)::INT + (x >= 32)::INT + (x >= 64)::INT)"
_SCORED = _MEN + f", sc AS (SELECT *, (10 * f[5] + 5 * f[4] + 3 * f[6] - {_BIN.replace('x', 'f[8]')})::DOUBLE AS score FROM pr)"
_LINKS = _SCORED + """, top AS (SELECT doc_id, men_idx, ant_idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, men_idx ORDER BY score DESC, ant_idx) = 1),
links AS (SELECT men.doc_id, m_idx, CASE WHEN top.score > 0 THEN ant_idx ELSE m_idx END AS best_ant, CASE WHEN top.score > 0 THEN top.score ELSE 0.0 END AS best_score
  FROM men LEFT JOIN top ON top.doc_id = men.doc_id AND top.men_idx = m_idx)"""
_ROOTS = _LINKS + """, climb(doc_id, m_idx, up_) AS (SELECT doc_id, m_idx, best_ant FROM links UNION ALL
  SELECT c.doc_id, c.m_idx, l.best_ant FROM climb AS c JOIN links AS l ON l.doc_id = c.doc_id AND l.m_idx = c.up_ AND l.best_ant <> l.m_idx),
roots AS (SELECT doc_id, m_idx, min(up_) AS root FROM climb GROUP BY 1, 2),
full_ AS (SELECT r.*, mf[1] AS kind, best_ant, count(*) OVER (PARTITION BY r.doc_id, root) AS n FROM roots AS r JOIN men USING (doc_id, m_idx) JOIN links USING (doc_id, m_idx)),
kept AS (SELECT *, max(CASE WHEN m_idx = root THEN kind END) OVER (PARTITION BY doc_id, root) AS root_kind FROM full_ WHERE n > 1),
cl AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY root) - 1 AS cluster, root, m_idx,
  coalesce(max(CASE WHEN best_ant = root AND m_idx <> root AND kind <> root_kind AND (kind = 2 OR (kind = 1 AND root_kind = 0)) THEN m_idx END) OVER (PARTITION BY doc_id, root), root) AS main FROM kept)"""
_LOCATED = _U + ", " + PLACES + """, un AS (SELECT doc_id, utt_idx, len(u) AS n, coalesce(sum(len(u)) OVER (PARTITION BY doc_id ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base0 FROM u),
loc AS (SELECT p.doc_id, m_idx, base0 + "start" AS "start", base0 + least("end", n) AS "end" FROM places AS p JOIN un USING (doc_id, utt_idx) WHERE least("end", n) > "start"),
dt AS (SELECT doc_id, unnest(flatten(conll_tokens)) AS text, generate_subscripts(flatten(conll_tokens), 1) - 1 AS tok_idx FROM f)"""
_SIDES = _F + ", " + GOLD + ", " + PLACES + ", " + _ROOTS + """,
k AS (SELECT doc_id, concat_ws(':', utt_idx, "start", "end") AS mention, min(label::BIGINT) AS e FROM gold GROUP BY 1, 2),
r0 AS (SELECT cl.doc_id, cluster AS e, cl.m_idx AS seq, concat_ws(':', utt_idx, "start", "end") AS mention FROM cl JOIN places USING (doc_id, m_idx)),
r AS (SELECT doc_id, mention, arg_min(e, (seq, e)) AS e FROM r0 WHERE doc_id IN (SELECT doc_id FROM k) GROUP BY 1, 2),
ks AS (SELECT doc_id, e, count(*) AS n FROM k GROUP BY 1, 2), rs AS (SELECT doc_id, e, count(*) AS n FROM r GROUP BY 1, 2),
ov AS (SELECT k.doc_id, k.e AS k, r.e AS r, count(*) AS s FROM k JOIN r USING (doc_id, mention) GROUP BY 1, 2, 3),
os AS (SELECT ov.*, ks.n AS kn, rs.n AS rn FROM ov JOIN ks ON ks.doc_id = ov.doc_id AND ks.e = k JOIN rs ON rs.doc_id = ov.doc_id AND rs.e = r)"""
_HOT = lambda x, n: f"list_transform(range(0, {n}), lambda i: (i = {x})::INT::DOUBLE)"
_ENC = lambda x: f"list_concat({_HOT(_BIN.replace('x', x), 10)}, [least({x}, 64) / 64.0])"
_ALONE = lambda m: f"list_concat({_HOT(m + '[1]', 4)}, list_concat({_ENC(m + '[2]')}, [{m}[3] / {m}[4], {m}[5]::DOUBLE]))"
_DENSE = f"list_concat(list_concat(list_transform(f[1:6], lambda z: z::DOUBLE), list_concat({_ENC('f[7]')}, {_ENC('f[8]')})), list_concat(list_concat([f[9]::DOUBLE], {_ALONE('af')}), list_concat({_ALONE('mf')}, {_HOT('mf[6]', 7)})))"
_TARGETS = _MEN + """, y AS (SELECT mention_id, list(coalesce(label, 0) ORDER BY ant_idx) AS y FROM pr GROUP BY 1),
l AS (SELECT mention_id, y, CASE WHEN list_contains(y, 1) THEN 0 ELSE 1 END AS new FROM y), t AS (SELECT mention_id, y, new, list_append(y, new) AS labels FROM l),
pos AS (SELECT *, list_filter(range(0, len(labels)), lambda i: labels[i + 1] = 1) AS tr, list_filter(range(0, len(labels)), lambda i: labels[i + 1] = 0) AS fa FROM t)"""
_PAD = lambda c: f"array_to_string(list_concat({c}, list_transform(range(0, len(labels) - len({c})), lambda i: {c}[-1])), ',')"
_LOSS = _SCORED + """, s1 AS (SELECT mention_id, score / 10 AS score, coalesce(label, 0) AS label FROM sc), has AS (SELECT mention_id, max(label) AS has FROM s1 GROUP BY 1),
cand AS (SELECT mention_id, score, label, CASE WHEN has = 1 THEN 1.0 * (1 - label) ELSE 0.4 END AS cost FROM s1 JOIN has USING (mention_id)
  UNION ALL SELECT mention_id, 0.0, 1 - has, CASE WHEN has = 1 THEN 0.8 ELSE 0.0 END FROM has),
lp AS (SELECT *, greatest(least(1 / (1 + exp(-score)), 1 - 1e-7), 1e-7) AS p FROM cand),
tp AS (SELECT mention_id, max(CASE WHEN label = 1 THEN ln(p) END) AS t, min(CASE WHEN label = 0 THEN ln(1 - p) END) AS f, max(CASE WHEN label = 1 THEN score END) AS best FROM lp GROUP BY 1),
rk AS (SELECT mention_id, max(cost * (1 + score - best)) AS m FROM cand JOIN tp USING (mention_id) WHERE best IS NOT NULL GROUP BY 1)"""
# Rows in order of length; a batch closes behind the row with which the sum of length + 1 exceeds its size, and before the first row with pairs.
_BATCHES = """o AS (SELECT id, length::BIGINT AS length, row_number() OVER (ORDER BY length, id) AS i, sum(length + 1) OVER (ORDER BY length, id) AS s FROM ({rows})),
last AS (SELECT max(i) AS i, coalesce(max(i) FILTER (length = 0), 0) AS z FROM o),
b(batch, first, stop) AS (SELECT -1::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT batch + 1, stop + 1, least(CASE WHEN stop < z THEN z ELSE last.i END,
    coalesce((SELECT min(o.i) FROM o WHERE o.i > stop AND o.s - coalesce((SELECT p.s FROM o AS p WHERE p.i = stop), 0) > 20000), last.i)) FROM b, last WHERE stop < last.i),
inb AS (SELECT batch, o.* FROM o JOIN b ON o.i BETWEEN first AND stop)"""
_LW = lambda n, k: "[" + ", ".join("[" + ", ".join(str(x) for x in row) + "]" for row in fixed_layer(n, k)[0].tolist()) + "]"
_LB = lambda n: str(fixed_layer(n, 1)[1].tolist())
_APPLY = lambda x, n, k: f"list_transform(range(1, {n + 1}), lambda i: greatest(0, list_dot_product({_LW(n, k)}[i], {x}) + {_LB(n)}[i]))"

QUERIES = {
    f.__name__: f
    for f in (
        pair_offsets, unbounded_pairs, distance_bins, decoded_pairs, pair_labels, mention_labels, best_links, clusters, representatives, chains, resolved_texts, token_annotations, span_annotations, score_maps,
        ranking_targets, length_batches, padded_batches, losses, flat_rows, coref_scores, blanc_scores, ceaf_scores, speaker_pairs, running_sentences, label_means, word_vectors, network_scores,
    )
}
SQL = {
    "pair_offsets": f"""WITH {_MEN}, n AS (SELECT doc_id, men_idx, count(*) AS n FROM pr GROUP BY 1, 2)
      SELECT men.doc_id, m_idx, coalesce(n, 0) AS pairs_length, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY men.doc_id ORDER BY m_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pairs_start
      FROM men LEFT JOIN n ON n.doc_id = men.doc_id AND men_idx = m_idx""",
    "unbounded_pairs": f"""WITH {_MEN}, s AS (SELECT doc_id, count(*) AS n FROM men GROUP BY 1), p AS (SELECT doc_id, count(*) AS p FROM pr GROUP BY 1)
      SELECT doc_id, n, coalesce(p, 0) AS p, coalesce((SELECT count(*) FROM men AS a JOIN men AS b ON a.doc_id = b.doc_id AND a.m_idx < b.m_idx WHERE a.doc_id = s.doc_id), 0) AS enumerated, coalesce(p, 0) * 2 = n * (n - 1) AS complete FROM s LEFT JOIN p USING (doc_id)""",
    "distance_bins": f"""WITH {_MEN}, x AS (SELECT 0 AS kind, f[7] AS x FROM pr UNION ALL SELECT 1, f[8] FROM pr) SELECT kind, {_BIN} AS bin, count(*) AS n, round(sum(least(x, 64) / 64.0), 4) AS total FROM x GROUP BY 1, 2""",
    "decoded_pairs": f"""WITH {_MEN}, j AS (SELECT f, a.mf AS af, b.mf AS mf FROM pr JOIN men AS a ON a.doc_id = pr.doc_id AND a.m_idx = ant_idx JOIN men AS b ON b.doc_id = pr.doc_id AND b.m_idx = men_idx),
      v AS (SELECT {_DENSE} AS v FROM j), e AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS position FROM v) SELECT position::INT AS position, round(sum(x), 3) AS total FROM e GROUP BY 1""",
    "pair_labels": f"""WITH {_F}, {GOLD}, {PLACES}, {_MEN}, l AS (SELECT doc_id, utt_idx, "start", "end", min(label) AS g FROM gold GROUP BY 1, 2, 3, 4), m AS (SELECT doc_id, m_idx, g FROM places LEFT JOIN l USING (doc_id, utt_idx, "start", "end"))
      SELECT pr.label AS given, coalesce(a.g = b.g, false)::INT AS label, count(*) AS n FROM pr JOIN m AS a ON a.doc_id = pr.doc_id AND a.m_idx = ant_idx JOIN m AS b ON b.doc_id = pr.doc_id AND b.m_idx = men_idx GROUP BY 1, 2""",
    "mention_labels": f"""WITH {_F}, {GOLD}, {PLACES}, l AS (SELECT doc_id, utt_idx, "start", "end", min(label) AS g FROM gold GROUP BY 1, 2, 3, 4)
      SELECT doc_id, m_idx, (g IS NULL OR row_number() OVER (PARTITION BY doc_id, g ORDER BY m_idx) = 1)::INT AS label FROM places LEFT JOIN l USING (doc_id, utt_idx, "start", "end")""",
    "best_links": f"WITH {_LINKS} SELECT doc_id, m_idx AS men_idx, best_ant, best_score FROM links",
    "clusters": f"WITH RECURSIVE {_ROOTS} SELECT doc_id, cluster::INT AS cluster, root, main, m_idx FROM cl",
    "representatives": f"""WITH RECURSIVE {_ROOTS}, o AS (SELECT doc_id, root, list({{'m': m_idx, 'k': kind}} ORDER BY m_idx) AS l FROM kept GROUP BY 1, 2)
      SELECT doc_id, root, list_reduce(l, lambda a, x: CASE WHEN x.k <> a.k AND (x.k = 2 OR (x.k = 1 AND a.k = 0)) THEN x ELSE a END).m AS representative FROM o""",
    "chains": f"""WITH RECURSIVE {_LINKS}, last AS (SELECT doc_id, max(m_idx) AS up_ FROM men GROUP BY 1), walk(doc_id, up_) AS (SELECT doc_id, up_ FROM last UNION SELECT w.doc_id, l.best_ant FROM walk AS w JOIN links AS l ON l.doc_id = w.doc_id AND l.m_idx = w.up_)
      SELECT doc_id, count(*) AS n, min(up_) AS first FROM walk GROUP BY 1""",
    "resolved_texts": f"""WITH RECURSIVE {_LOCATED}, {_ROOTS}, mt AS (SELECT loc.doc_id, m_idx, array_to_string(list_slice(flatten(conll_tokens), "start" + 1, "end"), ' ') AS t FROM loc JOIN f USING (doc_id)),
      wr AS (SELECT cl.doc_id, cluster, cl.m_idx, "start", "end", t FROM cl JOIN loc USING (doc_id, m_idx) JOIN mt ON mt.doc_id = cl.doc_id AND mt.m_idx = main WHERE cl.m_idx <> main),
      cell0 AS (SELECT doc_id, cluster, m_idx, t, "start", unnest(range("start"::BIGINT, "end"::BIGINT)) AS tok_idx FROM wr),
      cell AS (SELECT doc_id, tok_idx, arg_max(CASE WHEN tok_idx = "start" THEN t || ' ' ELSE '' END, (cluster, m_idx)) AS new FROM cell0 GROUP BY 1, 2)
      SELECT doc_id, md5(string_agg(coalesce(new, text || ' '), '' ORDER BY tok_idx)) AS resolved_md5 FROM dt LEFT JOIN cell USING (doc_id, tok_idx) GROUP BY 1""",
    "token_annotations": f"""WITH RECURSIVE {_LOCATED}, {_ROOTS}, h AS (SELECT dt.doc_id, tok_idx, count(DISTINCT cluster) AS n FROM dt JOIN loc ON loc.doc_id = dt.doc_id AND tok_idx >= "start" AND tok_idx < "end" JOIN cl ON cl.doc_id = loc.doc_id AND cl.m_idx = loc.m_idx GROUP BY 1, 2)
      SELECT doc_id, count(n) AS in_coref, coalesce(sum(n), 0)::BIGINT AS memberships FROM dt LEFT JOIN h USING (doc_id, tok_idx) GROUP BY 1""",
    "span_annotations": f"WITH RECURSIVE {_ROOTS} SELECT men.doc_id, count(cluster) AS coreferent, count(*) AS mentions, max(cluster)::INT AS last_cluster FROM men LEFT JOIN cl USING (doc_id, m_idx) GROUP BY 1",
    "score_maps": f"""WITH {_SCORED}, r AS (SELECT doc_id, men_idx AS m_idx, score FROM sc UNION ALL SELECT doc_id, m_idx, 0.0 FROM men) SELECT doc_id, m_idx, count(*)::INT AS n, sum(score) AS total FROM r GROUP BY 1, 2""",
    "ranking_targets": f"""WITH {_TARGETS} SELECT mention_id, array_to_string(labels, ',') AS labels, round(CASE WHEN new = 0 THEN list_sum(list_transform(y, lambda z: 1.0 * (1 - z))) + 0.8 ELSE 0.4 * len(y) END, 6)::DOUBLE AS cost,
      {_PAD('tr')} AS true_ants, CASE WHEN len(fa) > 0 THEN {_PAD('fa')} END AS false_ants FROM pos""",
    "length_batches": f"""WITH RECURSIVE {_MEN}, {_BATCHES.format(rows="SELECT mention_id AS id, coalesce(mentions_pairs_length, 0) AS length FROM men")}
      SELECT batch::BIGINT AS batch, count(*) AS mentions, sum(length)::BIGINT AS pairs, min(length)::BIGINT AS shortest, max(length)::BIGINT AS longest FROM inb GROUP BY 1""",
    "padded_batches": f"""WITH RECURSIVE {_TARGETS}, {_BATCHES.format(rows="SELECT mention_id AS id, len(labels) - 1 AS length FROM t")}
      SELECT batch::BIGINT AS batch, count(*) AS mentions, (max(length) + 1)::INT AS width, (max(length) + 1)::INT AS least, sum(longest - length)::BIGINT AS padding
      FROM (SELECT *, max(length) OVER (PARTITION BY batch) AS longest FROM inb) GROUP BY 1""",
    "losses": f"""WITH {_LOSS} SELECT 'all_pairs' AS name, round(sum(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))) / 1000, 4)::DOUBLE AS loss FROM cand
      UNION ALL SELECT 'top_pairs', round(sum(-coalesce(t, 0) - coalesce(f, 0)) / 1000, 4) FROM tp UNION ALL SELECT 'ranking', round(sum(m) / 1000, 4) FROM rk""",
    "flat_rows": f"""WITH {_MEN}, n AS (SELECT doc_id, men_idx AS m_idx, count(*) AS n FROM pr GROUP BY 1, 2)
      SELECT doc_id, m_idx, row_number() OVER (ORDER BY doc_id, m_idx) - 1 AS flat_idx, coalesce(sum(n) OVER (ORDER BY doc_id, m_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pairs_start FROM men LEFT JOIN n USING (doc_id, m_idx)""",
    "coref_scores": f"""WITH RECURSIVE {_SIDES}, t AS (SELECT (SELECT sum(n) FROM ks) AS km, (SELECT sum(n - 1) FROM ks) AS kl, (SELECT sum(n) FROM rs) AS rm, (SELECT sum(n - 1) FROM rs) AS rl, sum(s) AS c, sum(s - 1) AS l, sum(s * s / kn) AS b, sum(s * s / rn) AS q FROM os),
      m AS (SELECT 'ident' AS metric, c::DOUBLE AS recall_num, km::DOUBLE AS recall_den, c::DOUBLE AS precision_num, rm::DOUBLE AS precision_den FROM t UNION ALL SELECT 'muc', l, kl, l, rl FROM t UNION ALL SELECT 'bcub', b, km, q, rm FROM t),
      p AS (SELECT metric, recall_num::DOUBLE AS recall_num, recall_den::DOUBLE AS recall_den, precision_num::DOUBLE AS precision_num, precision_den::DOUBLE AS precision_den, recall_num / recall_den AS recall, precision_num / precision_den AS precision FROM m)
      SELECT metric, round(recall_num, 6) AS recall_num, recall_den, round(precision_num, 6) AS precision_num, precision_den, round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * recall * precision / (recall + precision), 6) AS f1 FROM p""",
    "blanc_scores": f"""WITH RECURSIVE {_SIDES}, ik AS (SELECT doc_id, sum(s * (s - 1) / 2) AS x FROM (SELECT doc_id, k, sum(s) AS s FROM ov GROUP BY 1, 2) GROUP BY 1), ir AS (SELECT doc_id, sum(s * (s - 1) / 2) AS x FROM (SELECT doc_id, r, sum(s) AS s FROM ov GROUP BY 1, 2) GROUP BY 1),
      kd AS (SELECT doc_id, sum(n * (n - 1) / 2) AS ck, sum(n) AS kn FROM ks GROUP BY 1), rd AS (SELECT doc_id, sum(n * (n - 1) / 2) AS cr, sum(n) AS rn FROM rs GROUP BY 1), od AS (SELECT doc_id, sum(s * (s - 1) / 2) AS cc, sum(s) AS c FROM ov GROUP BY 1),
      t AS (SELECT sum(ck) AS ck, sum(coalesce(cr, 0)) AS cr, sum(coalesce(cc, 0)) AS cc, sum(kn * (kn - 1) / 2 - ck) AS nk, sum(coalesce(rn * (rn - 1) / 2 - cr, 0)) AS nr, sum(coalesce(c * (c - 1) / 2 - ik.x - ir.x + cc, 0)) AS nn
        FROM kd LEFT JOIN rd USING (doc_id) LEFT JOIN od USING (doc_id) LEFT JOIN ik USING (doc_id) LEFT JOIN ir USING (doc_id)),
      s AS (SELECT cc / ck AS r1, cc / cr AS p1, nn / nk AS r2, nn / nr AS p2 FROM t)
      SELECT 'blanc' AS metric, round((r1 + r2) / 2, 6) AS recall, round((p1 + p2) / 2, 6) AS precision, round((2 * r1 * p1 / (r1 + p1) + 2 * r2 * p2 / (r2 + p2)) / 2, 6) AS f1 FROM s""",
    "speaker_pairs": f"""WITH {_C}, u AS (SELECT doc_id, unnest(utts_speakers) AS s, generate_subscripts(utts_speakers, 1) - 1 AS place FROM c),
      v AS (SELECT doc_id, place, coalesce(nullif(s, '-'), ((place + 2) % 2)::VARCHAR) AS s FROM u), w AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY place) AS b FROM v)
      SELECT doc_id, sum((s = b)::INT)::BIGINT AS same, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY 1""",
    "running_sentences": f"""WITH {_W}, n AS (SELECT doc_id, utt_idx, sum((word IN ('.', '?', '!', '/.', '/?'))::INT)::BIGINT AS n_sents FROM w GROUP BY 1, 2)
      SELECT doc_id, utt_idx, n_sents, coalesce(sum(n_sents) OVER (PARTITION BY doc_id ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_sentence FROM n""",
    "label_means": """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, count(*) AS n, dim::INT AS dim, round(avg(x::DOUBLE), 5) AS mean FROM e GROUP BY label, dim""",
    "word_vectors": f"""WITH {_W}, k AS (SELECT DISTINCT lower(word) AS key FROM w WHERE word IS NOT NULL), {VECTORS},
      v AS (SELECT key, coalesce(tuned, static, (SELECT coalesce(tuned, static) FROM voc WHERE word = '*UNK*')) AS v FROM k LEFT JOIN voc ON word = key)
      SELECT key, round(v[1]::DOUBLE, 5) AS first, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS total FROM v""",
    "network_scores": f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), b AS (SELECT vec_id, {_APPLY('x', 8, 64)} AS x FROM a), c AS (SELECT vec_id, {_APPLY('x', 4, 8)} AS x FROM b)
      SELECT vec_id, round(list_dot_product({_LW(1, 4)}[1], x) + {_LB(1)}[1], 5) AS score FROM c""",
}
