"""Conversations: utterances that are appended, speakers, context, and links of new mentions only.

An utterances table has (conv_id, utt_idx, text) and optionally speaker_id; a batch of a conversation is
processed like a document whose id is the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions.lexical import name_tokens


def append_utterances(old: DataFrame, new: DataFrame) -> DataFrame:
    """Utterances of ``new`` numbered behind those of ``old``, with default speakers; both (conv_id, utt_idx, text, speaker_id)."""
    behind = old.groupBy("conv_id").agg((F.max("utt_idx") + 1).alias("n"), F.max_by("speaker_id", "utt_idx").alias("last_speaker"))
    order = Window.partitionBy("conv_id").orderBy("utt_idx")
    place = F.row_number().over(order) - 1
    moved = new.withColumn("place", place).join(behind, "conv_id", "left").withColumn("utt_idx", (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int"))
    return old.select("conv_id", "utt_idx", "text", "speaker_id").unionByName(default_speakers(moved).select("conv_id", "utt_idx", "text", "speaker_id"))


def default_speakers(utterances: DataFrame) -> DataFrame:
    """Null speakers alternate 0 and 1 by place, going on after the last integer speaker (``last_speaker``; none counts as 1)."""
    last = F.coalesce(F.expr("try_cast(last_speaker AS int)"), F.lit(1))
    alternate = F.pmod(F.col("place") + last + 1, F.lit(2)).cast("string")
    return utterances.withColumn("speaker_id", F.coalesce(F.col("speaker_id").cast("string"), alternate))


def speakers(utterances: DataFrame, names: DataFrame | None = None, compat_characters: bool = False) -> DataFrame:
    """(conv_id, speaker_id, names, tokens). Names default to the id. compat_characters: a list of one name is taken apart into the characters
    of its printed form.
    """
    ids = utterances.where(F.col("speaker_id").isNotNull()).select("conv_id", F.col("speaker_id").cast("string").alias("speaker_id")).distinct()
    if names is None:
        out = ids.withColumn("names", F.array("speaker_id"))
    else:
        out = ids.join(names.select("conv_id", F.col("speaker_id").cast("string").alias("speaker_id"), "names"), ["conv_id", "speaker_id"], "left").withColumn("names", F.coalesce("names", F.array("speaker_id")))
        if compat_characters:
            printed = F.concat(F.lit("['"), F.col("names")[0], F.lit("']"))
            out = out.withColumn("names", F.when(F.size("names") == 1, F.split(printed, "")).otherwise(F.col("names")))
    return out.withColumn("tokens", F.flatten(F.transform("names", name_tokens)))


def utterance_of(mentions: DataFrame, sizes: DataFrame, *also: str) -> DataFrame:
    """Add utt_idx to mentions (doc_id, start_char, ...): the utterance in whose characters they start. sizes: (doc_id, utt_idx, n_chars) of all utterances, in
    order. also: columns of the utterances that are added too.
    """
    before = Window.partitionBy("doc_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n_chars").over(before), F.lit(0)).cast("long")
    nothing = F.lit(None).cast(mentions.drop("doc_id").schema)
    starts = sizes.select("doc_id", begin.alias("at"), F.struct(F.col("utt_idx").cast("int").alias("utt_idx"), *also).alias("u"), nothing.alias("x"))
    rows = mentions.select("doc_id", F.col("start_char").cast("long").alias("at"), F.lit(None).cast(starts.schema["u"].dataType).alias("u"), F.struct(*[c for c in mentions.columns if c != "doc_id"]).alias("x"))
    order = Window.partitionBy("doc_id").orderBy("at", F.col("x").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(rows).withColumn("u", F.last("u", ignorenulls=True).over(order))
    return placed.where("x is not null").select("doc_id", "u.*", "x.*")


def with_speakers(mentions: DataFrame, tokens: DataFrame, utterances: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add utt_idx, speaker_id and speaker_tokens (the parts of the speaker's names) to mentions.

    tokens: (doc_id, tok_idx, utt_idx); utterances: (doc_id, utt_idx, speaker_id); names: (doc_id, speaker_id, names), by default the ids.
    """
    place = tokens.select("doc_id", F.col("tok_idx").alias("start"), "utt_idx")
    said = utterances.select("doc_id", "utt_idx", F.col("speaker_id").cast("string").alias("speaker_id"))
    if names is None:
        said = said.withColumn("names", F.array("speaker_id"))
    else:
        given = names.select("doc_id", F.col("speaker_id").cast("string").alias("speaker_id"), "names")
        said = said.join(given, ["doc_id", "speaker_id"], "left").withColumn("names", F.coalesce("names", F.array("speaker_id")))
    parts = F.coalesce(F.flatten(F.transform("names", name_tokens)), F.array().cast("array<string>"))
    said = said.select("doc_id", "utt_idx", "speaker_id", parts.alias("speaker_tokens"))
    return mentions.join(place, ["doc_id", "start"], "left").join(said, ["doc_id", "utt_idx"], "left")


def conversation_text(utterances: DataFrame) -> DataFrame:
    """(doc_id, text): each conversation as one document, an utterance per line."""
    rows = utterances.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("u"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("u", lambda u: u["text"]), "\n").alias("text"))


def running_sentences(sentences_per_utterance: DataFrame) -> DataFrame:
    """Add first_sentence: the number of sentences before each utterance (conv_id, utt_idx, n_sents)."""
    before = Window.partitionBy("conv_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sentences_per_utterance.withColumn("first_sentence", F.coalesce(F.sum("n_sents").over(before), F.lit(0)))


def new_mentions(mentions: DataFrame, since: Column) -> DataFrame:
    """The mentions that links are sought for: those not before ``since``; all others are context and serve as antecedents only."""
    return mentions.where(since)


def last_utterances(utterances: DataFrame, added: DataFrame) -> DataFrame:
    """The utterances listed in ``added`` (conv_id, utt_idx)."""
    return utterances.join(added.select("conv_id", "utt_idx").distinct(), ["conv_id", "utt_idx"], "left_semi")
