"""Evaluation of mentions and scores against the gold labels of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.operators import annotate, coref, mentions, metrics
from corefold.plans.corpus import Corpus, gold_places
from corefold.runtime import stash

def _span():
    return F.concat_ws(":", "start", "end").alias("mention")


def gold_entities(gold: DataFrame) -> DataFrame:
    """(doc_id, entity, mention, seq) of gold spans (doc_id, start, end, label); a label's entity is numbered by a hash of the label."""
    return gold.select("doc_id", F.xxhash64(F.col("label").cast("string")).alias("entity"), _span(), F.lit(0).alias("seq"))


def identification(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """Counters of the metrics with every mention as an entity of its own: which gold spans are found at all."""
    alone = mentions.select("doc_id", F.col("m_idx").cast("long").alias("entity"), _span(), F.col("m_idx").alias("seq"))
    return metrics.document_counters(stash(gold_entities(gold), "key"), stash(alone, "response"), ceaf=False)


def identified(utterances: DataFrame, gold: DataFrame, profile: str = "training", blacklist: bool = False, parser=annotate.annotate) -> DataFrame:
    """The row ``ident`` of the totals of ``identification``, for the utterances and gold spans of ``corpus.prepare``, without making its mentions.

    Spans are compared in one pass over the tokens, of which only numbers leave. Without gold spans in the texts all counters are 0.
    """
    n = mentions.count_places(*gold_places(utterances, gold, parser), profile, blacklist)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    counters = zip(("both", "places", "both", "mentions"), metrics.COUNTERS)
    return n.agg(*[total(c).alias(name) for c, name in counters]).select(F.lit("ident").alias("metric"), *metrics.COUNTERS)


def evaluate(corpus: Corpus, pair_scores: DataFrame, single_scores: DataFrame, greedyness: float = 0.5, ceaf: bool = True) -> DataFrame:
    """The totals of all metrics for the entities that scores give, against the corpus's gold labels. pair_scores and single_scores: as of ``coref.best_links``."""
    found = coref.clusters(coref.forest_roots(coref.best_links(pair_scores, single_scores, greedyness)), corpus.mentions)
    places = corpus.mentions.select("doc_id", "m_idx", _span())
    response = found.join(places, ["doc_id", "m_idx"]).select("doc_id", F.col("cluster").cast("long").alias("entity"), "mention", F.col("m_idx").alias("seq"))
    return metrics.totals(metrics.document_counters(stash(gold_entities(corpus.gold), "key"), stash(response, "response"), ceaf=ceaf))
