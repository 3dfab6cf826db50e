"""Token annotations: the input contract of the mention rules, and a rule-based stand-in for a parser.

A table with the columns of ``TOKEN_COLUMNS`` from any parser can be used as it is. ``annotate``
makes one with regular expressions, closed word classes and flat noun chunks only. Its linguistic
quality is that of a stand-in; it exists so that the whole dataflow runs without a model.

Documents are shuffled once, by id, before they are split into tokens; all windows then run inside
that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN_COLUMNS = ["doc_id", "sent_idx", "tok_idx", "text", "lower", "ws", "tag", "pos", "dep", "head", "l_edge", "r_edge", "n_lefts", "n_rights", "ent_iob", "ent_type", "is_digit", "start_char", "end_char"]
TOKEN_PATTERN = r"('s|’s|[\p{L}\p{N}]+|[^\s\p{L}\p{N}])(\s*)"
# Closed word classes of the stand-in tagger.
WORD_CLASSES = {
    "PRP": ["he", "her", "him", "i", "it", "me", "she", "them", "they", "us", "we", "you"],
    "PRP$": ["his", "its", "my", "our", "their", "your"],
    "DT": ["a", "an", "that", "the", "these", "this", "those"],
    "IN": ["about", "after", "at", "because", "before", "by", "for", "from", "if", "in", "near", "of", "on", "over", "to", "while", "with"],
    "CC": ["and", "but", "nor", "or"],
    ",": [","],
    ".": [".", "!", "?"],
    "POS": ["'s", "’s"],
}
POS_OF_TAG = {"PRP": "PRON", "PRP$": "PRON", "DT": "DET", "IN": "ADP", "CC": "CCONJ", ",": "PUNCT", ".": "PUNCT", "SYM": "PUNCT", "POS": "PART", "CD": "NUM", "NNP": "PROPN", "NN": "NOUN"}
_CHUNK_TAGS = ["DT", "NN", "NNP"]


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per token. Null ids and null or empty texts give no tokens; positions count from 0 in each document.

    partitions: of the documents; by default one for every two million characters, which are counted in a pass over the texts: what Spark
    expects of a join is the product of its sides, and of compressed tables a part of their size.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    # Tokens are many times the size of the texts, by which adaptive execution would coalesce; so the number is given.
    texts = texts.repartition(partitions or _partitions(texts), "doc_id")
    parts = texts.select("doc_id", F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), F.lit(1)).alias("w"), F.regexp_extract_all("t", F.lit(TOKEN_PATTERN), F.lit(2)).alias("ws"), F.length(F.regexp_extract("t", r"^\s*", 0)).alias("lead"))
    flat = parts.select("doc_id", "lead", F.posexplode(F.arrays_zip("w", "ws")).alias("tok_idx", "x")).select("doc_id", "lead", "tok_idx", F.col("x.w").alias("text"), F.col("x.ws").alias("ws"))
    doc = Window.partitionBy("doc_id").orderBy("tok_idx")
    past = doc.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.lag(F.col("text").isin(".", "!", "?") | F.col("ws").contains("\n"), 1, False).over(doc)
    tokens = flat.withColumn("lower", F.lower("text")).withColumn("start_char", F.col("lead") + F.coalesce(F.sum(F.length("text") + F.length("ws")).over(past), F.lit(0))).withColumn("new", breaks.cast("int"))
    tokens = tokens.withColumn("sent_idx", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("initial", (F.col("tok_idx") == 0) | (F.col("new") == 1))
    tag = F.when(F.col("text").rlike(r"^\p{N}+$"), "CD").when(~F.col("text").rlike(r"^[\p{L}\p{N}]"), "SYM").when(F.col("text").rlike(r"^\p{Lu}") & ~F.col("initial"), "NNP").otherwise("NN")
    for name, words in reversed(WORD_CLASSES.items()):
        tag = F.when(F.col("lower").isin(words), name).otherwise(tag)
    return _parse(tokens.withColumn("tag", tag))


def _partitions(texts: DataFrame, characters: int = 2_000_000) -> int:
    total = texts.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // characters))


def _parse(tokens: DataFrame) -> DataFrame:
    """Flat noun chunks: the last token is the head; chunk heads and all other tokens hang on the sentence's last token."""
    sent = Window.partitionBy("doc_id", "sent_idx").orderBy("tok_idx")
    whole = Window.partitionBy("doc_id", "sent_idx")
    inside = F.col("tag").isin(_CHUNK_TAGS)
    before = F.lag("tag").over(sent)
    opens = inside & ((F.col("tag") == "DT") | F.coalesce(~before.isin(_CHUNK_TAGS), F.lit(True)))
    t = tokens.withColumn("inside", inside).withColumn("opens", opens.cast("int")).withColumn("after_in", F.coalesce(before == "IN", F.lit(False)))
    t = t.withColumn("chunk", F.when(F.col("inside"), F.sum("opens").over(sent.rowsBetween(Window.unboundedPreceding, 0))))
    t = t.withColumn("first", F.min("tok_idx").over(whole)).withColumn("root", F.max("tok_idx").over(whole)).withColumn("iob", F.when(F.col("tag") != "NNP", 2).when(F.coalesce(before == "NNP", F.lit(False)), 1).otherwise(3))
    chunk = Window.partitionBy("doc_id", "sent_idx", "chunk")
    t = t.withColumn("c_first", F.when(F.col("inside"), F.min("tok_idx").over(chunk)).otherwise(F.col("tok_idx"))).withColumn("c_last", F.when(F.col("inside"), F.max("tok_idx").over(chunk)).otherwise(F.col("tok_idx")))
    t = t.withColumn("c_in", F.when(F.col("inside"), F.max((F.col("opens") == 1) & F.col("after_in")).over(chunk)))
    is_root, is_head = F.col("tok_idx") == F.col("root"), F.col("tok_idx") == F.col("c_last")
    head = F.when(is_root, F.col("tok_idx")).when(is_head, F.col("root")).otherwise(F.col("c_last"))
    chunk_dep = F.when(~is_head, F.when(F.col("tag") == "DT", "det").otherwise("compound")).when(F.col("chunk") == 1, "nsubj").when(F.col("c_in"), "pobj").otherwise("dobj")
    by_tag = F.when(is_root & F.col("tag").isin(".", ",", "SYM"), "ROOT")
    for name, dep in (("PRP", "nsubj"), ("PRP$", "poss"), ("IN", "prep"), ("CC", "cc"), ("POS", "case"), ("CD", "nummod")):
        by_tag = by_tag.when(F.col("tag") == name, dep)
    t = t.withColumn("dep", F.when(F.col("inside"), chunk_dep).otherwise(by_tag.otherwise("punct"))).withColumn("head", head)
    t = t.withColumn("hangs", ((F.col("head") == F.col("root")) & ~is_root).cast("int"))
    pos = F.element_at(F.create_map(*[F.lit(x) for pair in POS_OF_TAG.items() for x in pair]), F.col("tag"))
    own_lefts = F.when(is_head, F.col("tok_idx") - F.col("c_first")).otherwise(0)
    return t.select(
        "doc_id", "sent_idx", "tok_idx", "text", "lower", "ws", "tag", pos.alias("pos"), "dep", "head",
        F.when(is_root, F.col("first")).when(is_head, F.col("c_first")).otherwise(F.col("tok_idx")).alias("l_edge"),
        F.col("tok_idx").alias("r_edge"),
        F.when(is_root, F.sum("hangs").over(whole)).otherwise(own_lefts).cast("int").alias("n_lefts"),
        F.lit(0).alias("n_rights"), F.col("iob").alias("ent_iob"), F.when(F.col("tag") == "NNP", "PERSON").alias("ent_type"),
        (F.col("tag") == "CD").alias("is_digit"), F.col("start_char").cast("int").alias("start_char"), (F.col("start_char") + F.length("text")).cast("int").alias("end_char"),
    )
