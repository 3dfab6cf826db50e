"""From a corpus to training arrays: utterances, annotated tokens, mentions with gold labels, pairs, features, labels, row numbers.

A document is partitioned once, by its id; its utterances are joined to one text, so that annotation, mention rules and
features are those of ``pipeline``. Corpus words and parser tokens are aligned by character position.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefold.functions import features as feat
from corefold.functions.lexical import clean_token, genre
from corefold.operators import annotate, dialogue, embed, mentions, pairs, training
from corefold.runtime import by_document, stash
from corefold.sources import conll
from corefold.sources.vectors import document_offsets


@dataclass
class Corpus:
    """mentions: ``describe_mentions`` with gold_label, speaker and genre.
    annotated: the parser's tokens; utterances: (doc_id, utt_idx, words, speaker_id); places: gold spans in characters of the document's text.

    Made when first asked for: mention_arrays and pair_arrays, the training arrays, see ``arrays``; tokens, annotated, with utt_idx; gold, the
    spans of parser tokens.
    """

    annotated: DataFrame
    utterances: DataFrame
    places: DataFrame
    mentions: DataFrame
    max_dist: int | None = None
    profile: str = "training"

    @cached_property
    def _arrays(self) -> tuple[DataFrame, DataFrame]:
        return arrays(self.mentions, self.max_dist, self.profile)

    @property
    def mention_arrays(self) -> DataFrame:
        return self._arrays[0]

    @property
    def pair_arrays(self) -> DataFrame:
        return self._arrays[1]

    @cached_property
    def tokens(self) -> DataFrame:
        return stash(_with_utterances(self.annotated, self.utterances), "tokens")

    @cached_property
    def gold(self) -> DataFrame:
        return stash(_gold_tokens(self.places, self.annotated), "gold")

    def undetected(self) -> DataFrame:
        return mentions.undetected_gold(self.mentions, self.gold)


def read_corpus(spark: SparkSession, paths: str | list[str], **options) -> Corpus:
    """``prepare`` for files in the column format. Speakers' names are their ids, split at underscores."""
    documents = conll.read_documents(spark, paths)
    rows = stash(conll.document_tokens(documents), "rows")
    utterances = conll.utterances(rows, clean=False).select(F.col("doc").alias("doc_id"), "utt_idx", F.col("tokens").alias("words"), "speaker")
    spans = conll.parse_brackets(rows)
    gold = spans.select(F.col("doc").alias("doc_id"), "utt_idx", "start", (F.col("end") + 1).alias("end"), "label")
    names = documents.select(F.col("doc").alias("doc_id"), "name")
    return prepare(utterances, gold, names, **options)


def prepare(
    utterances: DataFrame,
    gold: DataFrame,
    names: DataFrame | None = None,
    profile: str = "training",
    use_gold_mentions: bool = False,
    max_dist: int | None = None,
    blacklist: bool = False,
    parser=annotate.annotate,
) -> Corpus:
    """utterances: (doc_id, utt_idx, words, speaker); gold: (doc_id, utt_idx, start, end, label) in words, ends exclusive; names: (doc_id, name).

    use_gold_mentions: the mentions are the gold spans instead of those of the rules. max_dist: all earlier mentions are
    candidates with None. parser: from (doc_id, text) to ``annotate.TOKEN_COLUMNS``. Utterances count from 0, null words and utterances
    without words are kept as they are; a document without words has no mentions.
    """
    utts = stash(utterances.select("doc_id", "utt_idx", _clean().alias("words"), F.col("speaker").alias("speaker_id")), "utterances")
    tokens = parser(stash(document_texts(utts), "texts"))
    places = stash(_gold_places(gold, utts.select("doc_id", "utt_idx", _sizes().alias("sizes"))), "places")
    if use_gold_mentions:
        described = mentions.located_mentions(places, tokens)
    else:
        described = mentions.detect_mentions(tokens, profile, blacklist)
    # Tokens do not share their first or last characters, so a span's characters stand for its tokens.
    labels = places.groupBy("doc_id", "start_char", "end_char").agg(F.min("label").alias("gold_label"))
    described = described.join(labels, ["doc_id", "start_char", "end_char"], "left")
    parts = F.coalesce(dialogue.name_tokens(F.col("speaker_id").cast("string")), F.array().cast("array<string>"))
    said = utts.select("doc_id", "utt_idx", characters().alias("n_chars"), F.col("speaker_id").cast("string").alias("speaker_id"), parts.alias("speaker_tokens"))
    described = dialogue.utterance_of(described, said, "speaker_id", "speaker_tokens")
    codes = None if names is None else names.groupBy("doc_id").agg(F.min(genre(F.col("name"))).alias("genre"))
    described = described.withColumn("genre", F.lit(None).cast("int")) if codes is None else described.join(codes, "doc_id", "left")
    described = stash(described, "mentions")
    return Corpus(tokens, utts, places, described, max_dist, profile)


def gold_places(utterances: DataFrame, gold: DataFrame, parser=annotate.annotate) -> tuple[DataFrame, DataFrame]:
    """(places, tokens) of ``prepare``, for what needs no more: spans in characters of the documents' texts, and the parser's tokens.

    One table is written, the texts with the sizes of their words; utterances that are partitioned by document are not sent to make it.
    """
    words = utterances.select("doc_id", "utt_idx", _clean().alias("words"))
    rows = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", _utterance_text().alias("t"), _sizes().alias("sizes")))).alias("u"))
    text = F.array_join(F.transform("u", lambda u: u["t"]), "\n").alias("text")
    documents = stash(rows.select("doc_id", text, F.transform("u", lambda u: F.struct(u["utt_idx"].alias("utt_idx"), u["sizes"].alias("sizes"))).alias("u")), "texts")
    return _gold_places(gold, documents.select("doc_id", F.inline("u"))), parser(documents.select("doc_id", "text"))


def undetected(utterances: DataFrame, gold: DataFrame, profile: str = "training", blacklist: bool = False, parser=annotate.annotate) -> DataFrame:
    """(doc_id, start, end, label): ``Corpus.undetected`` of ``prepare``, in one pass over the tokens, without making the corpus's mentions."""
    return mentions.missed_places(*gold_places(utterances, gold, parser), profile, blacklist)


def document_texts(utts: DataFrame) -> DataFrame:
    """(doc_id, text): each word followed by a blank, each utterance by a line break."""
    rows = utts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", _utterance_text().alias("t")))).alias("u"))
    return rows.select("doc_id", F.array_join(F.transform("u", lambda u: u["t"]), "\n").alias("text"))


def _clean() -> Column:
    return F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: clean_token(w))


def _utterance_text() -> Column:
    return F.array_join(F.transform("words", lambda w: F.concat(w, F.lit(" "))), "")


def _sizes() -> Column:
    return F.transform("words", lambda w: F.length(w))


def characters() -> Column:
    """Of an utterance in the document's text, with the line break."""
    return F.aggregate("words", F.lit(1), lambda acc, w: acc + F.length(w) + 1)


def _words(utts: DataFrame) -> DataFrame:
    """(doc_id, utt_idx, i, start_char, end_char) of the corpus words in the document's text."""
    sizes = utts.select("doc_id", "utt_idx", "words", characters().alias("n"))
    before = Window.partitionBy("doc_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    words = based.select("doc_id", "utt_idx", "base", F.posexplode("words").alias("i", "w"))
    within = Window.partitionBy("doc_id", "utt_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.length("w") + 1).over(within), F.lit(0))
    return words.select("doc_id", "utt_idx", "i", start.cast("int").alias("start_char"), (start + F.length("w")).cast("int").alias("end_char"))


def _with_utterances(tokens: DataFrame, utts: DataFrame) -> DataFrame:
    """Add utt_idx: that of the corpus word that starts where the token does, or last did before it."""
    starts = _words(utts).select("doc_id", "start_char", "utt_idx")
    order = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.join(starts, ["doc_id", "start_char"], "left").withColumn("utt_idx", F.last("utt_idx", ignorenulls=True).over(order)).select(*tokens.columns, "utt_idx")


def _gold_places(gold: DataFrame, utts: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, label) in the document's text of the gold spans (in words) that lie inside their utterance. utts: with the sizes of their words."""
    before = Window.partitionBy("doc_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n + 1)
    based = utts.select("doc_id", "utt_idx", "sizes", F.coalesce(F.sum(total("sizes") + 1).over(before), F.lit(0)).alias("base"))
    spans = gold.where("label is not null and end > start and start >= 0").select("doc_id", "utt_idx", "start", "end", "label").distinct()
    size = lambda lo, n: total(F.slice("sizes", lo, n))
    first = F.col("base") + size(1, F.col("start").cast("int"))
    placed = spans.join(based, ["doc_id", "utt_idx"]).where(F.col("end") <= F.size("sizes"))
    placed = placed.withColumn("first", first).withColumn("last", F.col("first") + size(F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) - 1)
    return placed.select("doc_id", F.col("first").cast("int").alias("start_char"), F.col("last").cast("int").alias("end_char"), "label")


def _gold_tokens(places: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label) in parser tokens of the spans that begin and end where tokens do."""
    # Tokens are passed once: a document's positions are two arrays, in which its few spans are looked up.
    held = tokens.select("doc_id", F.struct("tok_idx", "start_char", "end_char").alias("t"))
    per_doc = held.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("doc_id", F.col("t.tok_idx").alias("i"), F.col("t.start_char").alias("s"), F.col("t.end_char").alias("e"))
    at = places.join(per_doc, "doc_id").select("doc_id", "label", "i", F.array_position("s", F.col("start_char")).cast("int").alias("a"), F.array_position("e", F.col("end_char")).cast("int").alias("b"))
    at = at.where("a > 0 and b > 0")
    return at.select("doc_id", F.element_at("i", F.col("a")).alias("start"), (F.element_at("i", F.col("b")) + 1).alias("end"), "label")


def arrays(described: DataFrame, max_dist: int | None = None, profile: str = "training") -> tuple[DataFrame, DataFrame]:
    """The training arrays of described mentions with gold_label, speaker_id, speaker_tokens and genre.

    mentions: (doc_id, m_idx, flat_idx, features (6), label, pairs_length, pairs_start, location (start, end, utterance, mention));
    pairs: (doc_id, men_idx, ant_idx, pair_row, pairs_ant_index, features (9), label).
    """
    length = pairs.band_length(max_dist)
    sizes = described.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("p"))
    # A mention's pairs start behind those of the document's earlier mentions: 0 + 1 + 2 + ..., from max_dist on always as many.
    start = F.col("p_base") + length * (length - 1) / 2 + (F.col("m_idx") - length) * (0 if max_dist is None else max_dist)
    place = described.join(document_offsets(sizes), "doc_id").withColumn("pairs_length", length.cast("long")).withColumn("pairs_start", start.cast("long")).drop("p_base")
    place = stash(place, "placed")
    both = pairs.with_sides(pairs.band_pairs(by_document(place, "doc_id", "m_idx"), max_dist), place.drop("text", "start_char", "end_char"))
    a, m = F.col("a"), F.col("m")
    flags = feat.speaker_flags(a, m)
    same = F.coalesce(a["gold_label"] == m["gold_label"], F.lit(False)).cast("int")
    row = m["pairs_start"] + F.col("ant_idx") - F.col("men_idx") + m["pairs_length"]
    rows = both.select("doc_id", "men_idx", "ant_idx", feat.compressed_pair(a, m, *flags, profile).alias("features"), same.alias("label"), row.alias("pair_row"), (m["m_base"] + F.col("ant_idx")).alias("pairs_ant_index"))
    code = F.coalesce("genre", F.lit(-1))  # an unknown genre has no place in the one-hot code
    me = F.struct("mention_type", "start", "end", "m_idx", "nested")
    where = F.struct("start", "end", F.col("utt_idx").alias("utterance"), F.col("m_idx").alias("mention"))
    mine = place.withColumn("m", me).select(
        "doc_id", "m_idx", feat.compressed_mention(F.col("m"), F.col("n_mentions"), code).alias("features"), where.alias("location"),
        training.new_entity().alias("label"), "pairs_length", (F.col("m_base") + F.col("m_idx")).alias("flat_idx"), "pairs_start",
    )
    return mine, rows


def embedded(corpus: Corpus, embeddings: DataFrame, width: int = 50, utterances: DataFrame | None = None, profile: str = "training") -> DataFrame:
    """(doc_id, m_idx, embedding): the words and averages of every mention, for the dense inputs of the networks."""
    return embed.mention_embeddings(corpus.mentions, corpus.tokens, embeddings, width, profile, utterances=utterances)
