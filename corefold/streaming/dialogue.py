"""Coreference in conversations: continuous, one-shot with context, and as a stream.

Utterances (conv_id, utt_idx, text, speaker_id) that arrive together are annotated, their mentions extracted, paired and scored by
the operators of the library; only mentions of new utterances are linked, to any earlier mention of the conversation
that the candidate rules admit, so links once given out do not change. What is kept of a conversation is a table of
its mentions in typed columns; indices, sentences and tokens of new utterances count on from there.

A stream runs this once per micro-batch. Its state is a table in a folder that all executors share, one partition per
batch, so that a batch that is repeated after a failure writes the same partition again; only conversations of
the batch are read back. The result equals that of all utterances in one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corefold.operators import annotate, candidates, coref, dialogue, mentions
from corefold.plans.pipeline import Parameters
from corefold.runtime import stash

_COUNTS = ["n_mentions", "n_sentences", "n_tokens"]
_SIDE = [
    "doc_id", "m_idx", "utt_idx", "sent_idx", "start", "end", "root", "mention_type", "root_lower", "root_tag", "span_lower", "content_words", "nested", "ent_label",
    "speaker_id", "speaker_tokens",
]
_STATE = [*_SIDE, "entity", *_COUNTS]


def _described(utterances: DataFrame, p: Parameters, parser) -> DataFrame:
    """The mentions of utterances, counted from 0 in each conversation, with the conversation's counts (null mentions for those without any)."""
    speaker = F.col("speaker_id").cast("string") if "speaker_id" in utterances.columns else F.lit(None).cast("string")
    keys = [F.col("conv_id").alias("doc_id"), F.col("utt_idx").cast("int").alias("utt_idx")]
    # a line break ends an utterance here, so one inside an utterance becomes a blank
    text = F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ")
    utts = utterances.where("conv_id is not null and utt_idx is not null").groupBy(*keys).agg(F.min(text).alias("text"), F.min(speaker).alias("speaker_id"))
    utts = stash(utts, "utterances")
    # Tokens are made twice, for the mentions and for the counts, which need few of their columns, but never written or sent.
    tokens = parser(stash(dialogue.conversation_text(utts.withColumnRenamed("doc_id", "conv_id")), "texts"))
    parts = F.coalesce(dialogue.name_tokens(F.col("speaker_id")), F.array().cast("array<string>"))
    said = utts.select("doc_id", "utt_idx", (F.length("text") + 1).alias("n_chars"), "speaker_id", parts.alias("speaker_tokens"))
    found = dialogue.utterance_of(mentions.detect_mentions(tokens, p.profile, p.blacklist), said, "speaker_id", "speaker_tokens")
    sums = [(F.max("sent_idx") + 1).alias("n_sentences"), (F.max("tok_idx") + 1).alias("n_tokens")]
    return stash(tokens.groupBy("doc_id").agg(*sums).join(found, "doc_id", "left").na.fill(0, ["n_mentions"]), "described")


def resolve_new(new: DataFrame, state: DataFrame | None = None, parameters: Parameters = Parameters(), parser=annotate.annotate) -> tuple[DataFrame, DataFrame]:
    """(links, additions): (conv_id, utt_idx, m_idx, mention, best_ant, root) of the mentions in new utterances, and the rows to add to the state.

    best_ant is the mention itself where it starts an entity; root is the entity's first mention. Utterances without text
    have no mentions, null conversations and numbers are dropped, repeated rows count once, a missing speaker is null.
    """
    p = parameters
    added = _described(new, p, parser)
    if state is None:
        return _linked(added, None, p)
    state = stash(state.join(added.select("doc_id").distinct(), "doc_id", "left_semi"), "earlier")
    behind = state.groupBy("doc_id").agg(*[F.max(c).alias(f"p_{c}") for c in _COUNTS])
    moved = added.join(behind, "doc_id", "left").na.fill(0, ["p_n_mentions", "p_n_sentences", "p_n_tokens"])
    for column, by in {"m_idx": "mentions", "sent_idx": "sentences", "start": "tokens", "end": "tokens", "root": "tokens"}.items():
        moved = moved.withColumn(column, (F.col(column) + F.col(f"p_n_{by}")).cast("int"))
    for column in _COUNTS:
        moved = moved.withColumn(column, (F.col(column) + F.col(f"p_{column}")).cast("int"))  # of the whole conversation so far
    return _linked(stash(moved, "moved"), state, p)


def _linked(moved: DataFrame, state: DataFrame | None, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """The results of ``resolve_new`` from described mentions that are numbered behind those of the state."""
    fresh = moved.where("m_idx is not null")
    every = fresh.select(*_SIDE, F.lit(True).alias("new"))
    if state is not None:
        every = stash(state.where("m_idx is not null").select(*_SIDE, F.lit(False).alias("new")).unionByName(every), "all")
    # The rule score has no part for speakers.
    scored = candidates.score_rule(every, p.profile, p.max_dist, p.max_dist_match, p.compat_unsigned, F.col("new"))
    links = coref.best_links(scored, fresh.select("doc_id", "m_idx", F.lit(0.0).alias("score")), p.greedyness)
    links = stash(links, "links").select("doc_id", "men_idx", "best_ant")
    if state is not None:
        links = links.unionByName(state.where("m_idx is not null").select("doc_id", F.col("m_idx").alias("men_idx"), F.col("entity").alias("best_ant")))
    roots = coref.forest_roots(links)
    rows = stash(fresh.join(roots.select("doc_id", "m_idx", "best_ant", F.col("root").alias("entity")), ["doc_id", "m_idx"]), "resolved")
    out = rows.select(F.col("doc_id").alias("conv_id"), "utt_idx", "m_idx", F.col("text").alias("mention"), "best_ant", F.col("entity").alias("root"))
    empty = moved.where("m_idx is null").withColumn("entity", F.lit(None).cast("int"))  # its counts must not be lost
    return out, rows.select(*_STATE).unionByName(empty.select(*_STATE))


def batch_coref(utterances: DataFrame, parameters: Parameters = Parameters(), parser=annotate.annotate) -> DataFrame:
    """(conv_id, utt_idx, m_idx, mention, best_ant, root) for a finished table of utterances."""
    return resolve_new(utterances, None, parameters, parser)[0]


def one_shot(utterances: DataFrame, context: DataFrame, parameters: Parameters = Parameters(), parser=annotate.annotate) -> DataFrame:
    """Links of the mentions in ``utterances`` only; mentions of the context utterances are antecedents, each an entity of its own.

    Utterances are numbered behind those of the context.
    """
    _, state = resolve_new(context, None, parameters, parser)
    return resolve_new(utterances, state.withColumn("entity", F.col("m_idx")), parameters, parser)[0]


class Conversations:
    """Conversations kept in a folder: utterances are appended, and their mentions linked.

    append returns the links; replace forgets the conversations that occur first. Both may be called once per batch number: the
    same number again overwrites what that batch had added.
    """

    def __init__(self, spark: SparkSession, folder: str, parameters: Parameters = Parameters(), parser=annotate.annotate) -> None:
        self.spark, self.folder, self.parameters, self.parser = spark, folder.rstrip("/"), parameters, parser

    def _table(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}") if found else None

    def state(self, before: int) -> DataFrame | None:
        """The mentions added by batches before this one and since the conversation was last replaced."""
        rows, resets = self._table("state"), self._table("resets")
        if rows is None:
            return None
        rows = rows.where(F.col("batch") < before)
        if resets is not None:
            since = resets.where(F.col("batch") <= before).groupBy("doc_id").agg(F.max("batch").alias("since"))
            rows = rows.join(since, "doc_id", "left").where(F.coalesce(F.col("batch") >= F.col("since"), F.lit(True))).drop("since")
        return rows.drop("batch")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def append(self, utterances: DataFrame, batch: int) -> DataFrame:
        links, added = resolve_new(utterances, self.state(batch), self.parameters, self.parser)
        links = stash(links, "links")
        self._write(added, "state", batch)
        return links

    def replace(self, utterances: DataFrame, batch: int) -> DataFrame:
        self._write(utterances.select(F.col("conv_id").alias("doc_id")).where("doc_id is not null").distinct(), "resets", batch)
        return self.append(utterances, batch)


def continuous_coref(utterances: DataFrame, folder: str, parameters: Parameters = Parameters(), parser=annotate.annotate, **trigger) -> StreamingQuery:
    """Start a query over a stream of utterances (conv_id, utt_idx, text[, speaker_id]); links go to ``<folder>/links`` as parquet, one partition per batch.

    ``folder`` must be shared by all executors; it also holds the state and the stream's checkpoint. ``trigger``: see ``DataStreamWriter.trigger``.
    """
    kept = Conversations(utterances.sparkSession, folder, parameters, parser)

    def step(rows: DataFrame, batch: int) -> None:
        kept._write(kept.append(rows, batch), "links", batch)

    writer = utterances.writeStream.foreachBatch(step).option("checkpointLocation", f"{kept.folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
