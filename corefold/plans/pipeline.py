"""The whole dataflow from texts to clusters as a chain of operators. ``corpus`` has the preparation of training data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.functions import features as feat
from corefold.operators import annotate, candidates, coref, dialogue, embed, mentions, pairs, scoring
from corefold.runtime import stash


@dataclass(frozen=True)
class Parameters:
    """Defaults of the pipeline. blacklist: leave out first and second person words. conversions: (word, replacements) for rare words.
    utterances: (doc_id, utt_idx, speaker_id) of all utterances, for document embeddings and speaker features in the training profile; tokens
    then have utt_idx. genres: (doc_id, genre), for seven genre features instead of one zero. since: a condition on mentions; those
    that do not meet it are context, antecedents only.
    """

    greedyness: float = 0.5
    max_dist: int | None = 50
    max_dist_match: int | None = 500
    blacklist: bool = True
    profile: str = "inference"
    width: int = 50
    conversions: DataFrame | None = None
    compat_unsigned: bool = False
    utterances: DataFrame | None = None
    genres: DataFrame | None = None
    since: Column | None = None


@dataclass
class Result:
    """The tables of one run; each is a DataFrame."""

    tokens: DataFrame
    mentions: DataFrame
    pair_scores: DataFrame
    single_scores: DataFrame
    clusters: DataFrame
    docs: DataFrame
    extra: dict = field(default_factory=dict)

    def resolved(self) -> DataFrame:
        return coref.resolve(self.tokens, self.clusters, self.mentions)

    def scores(self) -> DataFrame:
        return coref.score_map(self.pair_scores, self.single_scores)

    def token_annotations(self) -> DataFrame:
        return coref.annotate_tokens(self.tokens, self.clusters, self.mentions, self.scores())

    def span_annotations(self) -> DataFrame:
        return coref.annotate_spans(self.mentions, self.clusters, self.scores())

    def document_annotations(self) -> DataFrame:
        return coref.annotate_docs(self.docs, self.clusters, self.resolved())

    def payloads(self) -> DataFrame:
        return coref.payload(self.mentions, self.clusters, self.resolved())

    def lines(self) -> DataFrame:
        return coref.cluster_lines(self.clusters, self.mentions)


def run(docs: DataFrame, model: dict[str, scoring.Layers] | None = None, embeddings: DataFrame | None = None, tokens: DataFrame | None = None, parameters: Parameters = Parameters()) -> Result:
    """Resolve coreference in documents (doc_id, text).

    tokens: annotations of any parser (``annotate.TOKEN_COLUMNS``); without them the rule-based stand-in is used.
    model and embeddings: the networks ``single`` and ``pair`` with the word vectors they were trained on; without them the rule score is used.
    """
    p = parameters
    tokens = stash(annotate.annotate(docs) if tokens is None else tokens, "tokens")
    found = mentions.detect_mentions(tokens, p.profile, p.blacklist)
    spoken = p.profile == "training" and p.utterances is not None and "speaker_id" in p.utterances.columns
    if spoken:
        found = dialogue.with_speakers(found, tokens, p.utterances)
    if p.genres is not None:
        found = found.join(p.genres.select("doc_id", "genre"), "doc_id", "left")
    found = stash(found, "mentions")
    if model is None:
        scored = candidates.score_rule(found, p.profile, p.max_dist, p.max_dist_match, p.compat_unsigned, p.since)
        single = found.select("doc_id", "m_idx", F.lit(0.0).alias("score"))
    else:
        both = pairs.with_sides(pairs.candidate_pairs(found, p.max_dist, p.max_dist_match, p.compat_unsigned, p.since), found.drop("text", "start_char", "end_char"))
        a, m = F.col("a"), F.col("m")
        flags = feat.speaker_flags(a, m) if spoken else (F.lit(True), F.lit(False), F.lit(False))
        f = both.select("doc_id", "men_idx", "ant_idx", "a", "m", feat.compressed_pair(a, m, *flags, p.profile).alias("f"))
        conversions = None if p.conversions is None else embed.conversion_vectors(p.conversions, embeddings, p.width)
        vectors = embed.mention_embeddings(found, tokens, embeddings, p.width, p.profile, conversions, p.utterances)
        vectors = stash(vectors, "vectors")
        genre = None if p.genres is None else F.col("m.genre")
        dense = feat.pair_features(a, m, F.col("f"), genre)
        scored = scoring.score_pairs(f.select("doc_id", "men_idx", "ant_idx", dense.alias("features")), vectors, model["pair"])
        me = F.struct(*[c for c in found.columns if c != "doc_id"])
        inputs = found.select("doc_id", "m_idx", me.alias("m")).join(vectors, ["doc_id", "m_idx"])
        own = feat.single_features(m, m["n_mentions"], genre)
        single = scoring.score_vectors(inputs.select("doc_id", "m_idx", F.concat("embedding", own).alias("features")), model["single"])
    scored, single = stash(scored, "pair-scores"), stash(single, "single-scores")
    roots = coref.forest_roots(coref.best_links(scored, single, p.greedyness))
    return Result(tokens, found, scored, single, stash(coref.clusters(roots, found), "clusters"), docs)
