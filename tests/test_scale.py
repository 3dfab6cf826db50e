"""How much is kept and sent: partitions of texts, exchanges of pairs, tables written on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import SMALL

from corefold.functions import features as feat
from corefold.operators import annotate, candidates, embed, mentions, metrics, pairs, scoring
from corefold.plans import corpus, corpus_queries, evaluate, pair_queries, text_queries
from corefold.runtime import stash, table
from corefold.streaming import dialogue


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_join_are_not_cut_into_the_product_of_its_sides(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").limit(20)
    wide = spark.range(3_000_000).selectExpr("id AS doc_id", "uuid() AS other")
    joined = docs.hint("merge").join(wide, "doc_id", "left").select("doc_id", "text")
    assert annotate.annotate(joined).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("profile", "blacklist"), [("inference", True), ("training", False)])
def test_mentions_in_one_pass_are_the_described_spans(spark, profile, blacklist):
    tokens = stash(annotate.annotate(table(spark, SMALL, "documents").limit(30)), "tokens")
    want = mentions.describe_mentions(mentions.extract_spans(tokens, profile, blacklist), tokens)
    got = mentions.detect_mentions(tokens, profile, blacklist)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert mentions.detect_mentions(tokens.limit(0)).count() == 0


def test_pairs_are_not_sent(spark):
    found = stash(mentions.detect_mentions(annotate.annotate(table(spark, SMALL, "documents").limit(30))), "mentions")
    candidates = pairs.candidate_pairs(found, 5, 50)
    assert _plan(candidates.groupBy("doc_id", "men_idx").count()).count("Exchange hashpartitioning") == 2  # of mentions
    both = pairs.with_sides(candidates, found.select("doc_id", "m_idx", "start"))
    assert _plan(both).count("Exchange hashpartitioning") == 3
    rows = found.select("doc_id", "m_idx", "content_words").collect()
    words = {(r["doc_id"], r["m_idx"]): set(r["content_words"]) for r in rows}
    want = {(d, b, a) for d, b in words for a in range(max(0, b - 50), b) if a >= b - 5 or words[d, b] & words[d, a]}
    got = [tuple(r) for r in candidates.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_arrays_are_made_without_writing_tokens_or_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(corpus, "stash", lambda df, label: written.append(label) or stash(df, label))
    c = corpus_queries.prepared(spark, SMALL)
    assert c.mention_arrays.count() > 0 and c.pair_arrays.count() > 0
    assert not {"tokens", "words", "gold", "pairs"} & set(written)


def test_gold_mentions_are_made_without_writing_tokens(spark, monkeypatch):
    written = []
    monkeypatch.setattr(corpus, "stash", lambda df, label: written.append(label) or stash(df, label))
    c = corpus_queries.prepared(spark, SMALL, use_gold_mentions=True)
    assert "placed" not in written  # arrays nobody asked for
    assert c.mention_arrays.count() > 0 and "tokens" not in written
    tokens = stash(c.annotated, "tokens")
    want = mentions.describe_mentions(corpus._gold_tokens(c.places, tokens).select("doc_id", "start", "end").distinct(), tokens)
    got = c.mentions.select(want.columns)
    assert got.dtypes == want.dtypes and want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_array_rows_with_a_band(spark):
    c = corpus_queries.prepared(spark, SMALL, max_dist=3)
    rows = {r["pair_row"]: r for r in c.pair_arrays.collect()}
    mine = c.mention_arrays.orderBy("flat_idx").collect()
    assert sorted(rows) == list(range(len(rows)))
    assert [r["flat_idx"] for r in mine] == list(range(len(mine)))
    for r in mine[:2000]:
        for k in range(r["pairs_length"]):
            pair = rows[r["pairs_start"] + k]
            assert (pair["doc_id"], pair["men_idx"]) == (r["doc_id"], r["m_idx"])
            assert mine[pair["pairs_ant_index"]]["m_idx"] == pair["ant_idx"] == r["m_idx"] - r["pairs_length"] + k


def _features(found, max_dist, match, profile="inference", new=None):
    a, m = F.col("a"), F.col("m")
    both = pairs.with_sides(pairs.candidate_pairs(found, max_dist, match, new=new), found)
    f = both.select("doc_id", "men_idx", "ant_idx", "a", "m", feat.compressed_pair(a, m, F.lit(True), F.lit(False), F.lit(False), profile).alias("f"))
    return f.select("doc_id", "men_idx", "ant_idx", "f", feat.pair_features(a, m, F.col("f")).alias("features"))


def _pair_scores(scored):
    return {(r["doc_id"], r["men_idx"], r["ant_idx"]): r["score"] for r in scored.collect()}


@pytest.mark.parametrize(("max_dist", "match"), [(5, 50), (50, 500), (None, 500), (3, None), (50, 5)])
def test_pairs_scored_where_their_mentions_are(spark, monkeypatch, max_dist, match):
    monkeypatch.setattr(candidates, "_PAIRS", 100)
    monkeypatch.setattr(candidates, "_MENTIONS", 200)
    found = stash(mentions.detect_mentions(annotate.annotate(table(spark, SMALL, "documents").limit(40))), "mentions")
    vec = F.when(F.col("m_idx") != 7, F.array((F.col("m_idx") % 7 / 10), F.col("mention_type").cast("double")))
    layers = scoring.random_layers(68, (6, 3))
    featured = stash(_features(found, max_dist, match), "featured")
    want = _pair_scores(scoring.score_pairs(featured, found.select("doc_id", "m_idx", vec.alias("embedding")), layers))
    got = candidates.score_network(found.withColumn("embedding", vec), layers, max_dist, match)
    assert got.count() == len(want)
    got = _pair_scores(got)
    assert got.keys() == want.keys() and None in got.values()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-5) for k, v in want.items())
    dense = np.array([r["features"] for r in featured.collect()])
    sums = {r["position"]: r["total"] for r in candidates.feature_sums(found, max_dist, match).collect()}
    assert np.allclose([sums[i] for i in range(64)], dense.sum(axis=0), rtol=1e-6)


@pytest.mark.parametrize("profile", ["inference", "training"])
def test_rule_scores_where_the_mentions_are(spark, profile):
    found = stash(mentions.detect_mentions(annotate.annotate(table(spark, SMALL, "documents").limit(40)), profile), "mentions")
    found = found.where("m_idx % 11 <> 4")  # with missing numbers
    new = F.col("m_idx") % 2 == 0
    want = _pair_scores(scoring.rule_scores(_features(found, 5, 50, profile, new)))
    assert _pair_scores(candidates.score_rule(found, profile, 5, 50, new=new)) == want and want


def test_conversations_are_linked_without_writing_tokens_or_mentions_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dialogue, "stash", lambda df, label: written.append(label) or stash(df, label))
    assert corpus_queries.dialogue_links(spark, SMALL).count() > 0
    assert not {"tokens", "moved", "all"} & set(written)


def test_embedding_sums_are_made_without_writing_tokens_or_vectors(spark, monkeypatch):
    written = []
    for module in (corpus, embed):
        monkeypatch.setattr(module, "stash", lambda df, label: written.append(label) or stash(df, label))
    got = {(r["profile"], r["block"]): (r["first"], r["total"]) for r in corpus_queries.mention_vectors(spark, SMALL).collect()}
    assert not {"tokens", "static", "words"} & set(written)
    c = corpus_queries.prepared(spark, SMALL)
    voc = embed.vocabulary(pair_queries.corpus_vocabulary(spark, SMALL))
    for profile in ("inference", "training"):
        rows = embed.mention_embeddings(c.mentions, c.tokens, voc, 64, profile, utterances=c.utterances).collect()
        sums = np.array([r["embedding"] for r in rows]).reshape(-1, 13, 64).sum(axis=0)
        for block in range(13):
            assert np.allclose(got[profile, block], (sums[block, 0], sums[block].sum()), atol=0.06)


def test_candidates_are_counted_where_the_mentions_are(spark, monkeypatch):
    counted = text_queries.candidate_counts(spark, SMALL)
    assert _plan(counted).count("Exchange hashpartitioning") + _plan(counted).count("Exchange(") <= 1 and "corefold-" not in "".join(counted.inputFiles())  # texts only
    monkeypatch.setattr(candidates, "_PAIRS", 100)
    monkeypatch.setattr(candidates, "_MENTIONS", 200)
    found = stash(mentions.detect_mentions(annotate.annotate(table(spark, SMALL, "documents").limit(40))), "mentions")
    found = stash(found.where("m_idx % 11 <> 4 and m_idx > 0").coalesce(1), "some")  # with missing numbers
    for max_dist, match in [(5, 50), (50, 500), (None, 500), (3, None), (50, 5), (0, 9)]:
        ant = {}
        for r in candidates.score_rule(found, "inference", max_dist, match).collect():
            ant.setdefault((r["doc_id"], r["men_idx"]), []).append(r["ant_idx"])
        got = {(r["doc_id"], r["men_idx"]): (r["n"], r["first"], r["total"]) for r in candidates.count_pairs(found, max_dist, match).collect()}
        assert got == {k: (len(v), min(v), sum(v)) for k, v in ant.items()} and got


def _written(monkeypatch):
    written = []
    for module in (corpus, evaluate):
        monkeypatch.setattr(module, "stash", lambda df, label: written.append(label) or stash(df, label))
    return written


def test_undetected_spans_are_found_in_the_pass_over_the_tokens(spark, monkeypatch):
    want = sorted(map(tuple, corpus_queries.prepared(spark, SMALL).undetected().select("doc_id", "start", "end", "label").distinct().collect()))
    written = _written(monkeypatch)
    found = corpus_queries.corpus_undetected(spark, SMALL)
    assert written == ["texts"] and _plan(found).count("MapInArrow") == 1
    assert sorted(map(tuple, found.collect())) == want and want


def test_places_of_several_batches_are_compared_with_the_spans_of_their_documents(spark):
    rows = spark.createDataFrame([(d, 0, "Ann Lee met the man yesterday .".split(), None) for d in range(3)] + [(3, 0, ["Bob"], None), (3, 1, ["She", "left"], None)], "doc_id long, utt_idx int, words array<string>, speaker string")
    spans = [(0, 0, 0, 2, "1"), (0, 0, 2, 4, "1"), (0, 0, 2, 4, "2"), (0, 0, 5, 9, "3"), (1, 0, 0, 2, None), (3, 1, 0, 1, "4"), (3, 1, 0, 2, "4"), (3, 0, 1, 1, "5"), (7, 0, 0, 1, "6")]
    gold = spark.createDataFrame(spans, "doc_id long, utt_idx int, start int, end int, label string")
    assert sorted(map(tuple, corpus.undetected(rows, gold).collect())) == sorted(map(tuple, corpus.prepare(rows, gold).undetected().distinct().collect()))
    assert corpus.undetected(rows, gold.limit(0)).count() == 0 and corpus.undetected(rows.limit(0), gold).count() == 0
    places, tokens = corpus.gold_places(rows, gold)
    table = mentions._with_places(places, tokens, "start_char", "end_char", "label").orderBy("doc_id", "tok_idx").toArrow()
    whole = mentions._missed_batch(table, False, False).to_pylist()
    for size in (1, 2, 5):
        parts = mentions.whole_documents(lambda t: mentions._missed_batch(t, False, False), 1)(iter(table.to_batches(size)))
        assert [r for part in parts for r in part.to_pylist()] == whole and whole


def test_identified_mentions_are_counted_in_the_pass_over_the_tokens(spark, monkeypatch):
    def ident(c):
        found = metrics.totals(evaluate.identification(c.mentions, c.gold)).where("metric = 'ident'")
        return [tuple(r) for r in found.select("metric", *metrics.COUNTERS).collect()]

    rows = spark.createDataFrame([(d, 0, "Ann Lee met the man yesterday .".split(), None) for d in range(3)], "doc_id long, utt_idx int, words array<string>, speaker string")
    # The spans of document 2 do not lie in the text, so its mentions do not count.
    gold = spark.createDataFrame([(0, 0, 0, 2, "1"), (0, 0, 0, 2, "2"), (0, 0, 1, 2, "1"), (1, 0, 3, 5, "1"), (2, 0, 5, 9, "3")], "doc_id long, utt_idx int, start int, end int, label string")
    want, small = ident(corpus_queries.prepared(spark, SMALL)), ident(corpus.prepare(rows, gold))
    assert [tuple(r) for r in evaluate.identified(rows, gold).collect()] == small and small[0][1] > 0
    assert [tuple(r) for r in evaluate.identified(rows, gold.limit(0)).collect()] == [("ident", 0, 0, 0, 0)]
    written = _written(monkeypatch)
    found = corpus_queries.identified_mentions(spark, SMALL)
    assert written == ["texts"] and _plan(found).count("MapInArrow") == 1
    assert [tuple(r) for r in found.collect()] == want
