"""Corpora in the column format of the coreference shared tasks: read, parse, write.

A file is split into documents by the reader itself (the end line is the record separator), so that a
concatenation of any size is read in parallel, one row per document. Everything after that is column
expressions and windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefold.functions.lexical import clean_token, utterance_text

END_LINE = "#end document"
_BEGIN = r"#begin document \((.*)\);(?:[ \t]+part[ \t]+(\S+))?"


def find_files(spark: SparkSession, folder: str, prefer_gold: bool = True) -> DataFrame:
    """(path, stem, is_gold) of the corpus files below a folder; of a stem's files the gold one, if asked. The stem is the file name up to its first dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.v4_*_conll").load(folder).select("path")
    files = files.where(F.col("path").rlike(r"[.]v4_(auto|gold)_conll$"))
    marked = files.withColumn("stem", F.regexp_extract("path", r"^(.*/[^/.]*)[^/]*$", 1)).withColumn("is_gold", F.col("path").endswith(".v4_gold_conll"))
    if not prefer_gold:
        return marked
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(F.col("is_gold").desc(), "path"))
    return marked.withColumn("r", rank).where("r = 1").drop("r")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc, name, part, body): one row per document of the files. doc is ``name; part part`` and the key of all later tables."""
    raw = spark.read.option("lineSep", END_LINE).text(paths).withColumnRenamed("value", "raw")
    return parse_documents(raw.where(F.col("raw").contains("#begin document")))


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, value): every file as one string."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_documents(raw: DataFrame) -> DataFrame:
    head = lambda i: F.regexp_extract("raw", _BEGIN, i)
    part = F.when(head(2) == "", None).otherwise(head(2))
    body = F.regexp_replace(F.regexp_extract("raw", r"(?s)#begin document[^\n]*\n?(.*)$", 1), r"\r", "")
    return raw.select(head(1).alias("name"), part.alias("part"), body.alias("body")).withColumn("doc", F.concat("name", F.coalesce(F.concat(F.lit("; part "), "part"), F.lit(""))))


def document_tokens(documents: DataFrame, strict: bool = True, min_columns: int = 8) -> DataFrame:
    """(doc, name, part, utt_idx, tok_idx, word, speaker, coref): one row per token line.

    Blank lines end an utterance; several in a row end one. strict: a line with fewer than ``min_columns`` columns, another
    name or part than the document's, a word index out of order, or two speakers in one utterance raise an error.
    """
    # An utterance is a maximal run of lines with content.
    utterances = F.filter(F.split("body", r"\n(?:[ \t]*\n)+"), lambda u: F.trim(u) != "")
    u = documents.select("doc", "name", "part", F.posexplode(utterances).alias("utt_idx", "u"))
    lines = F.filter(F.split("u", "\n"), lambda x: F.trim(x) != "")
    t = u.select("doc", "name", "part", "utt_idx", F.posexplode(lines).alias("tok_idx", "line")).withColumn("c", F.split(F.trim("line"), r"\s+"))
    n = F.size("c")
    if strict:
        spoken = Window.partitionBy("doc", "utt_idx")
        same_part = F.col("c")[1].cast("int") == F.col("part").cast("int")
        checks = [
            (n >= min_columns, "line not standard: "),
            ((F.col("c")[0] == F.col("name")) & F.coalesce(same_part, F.lit(True)), "name or part differs: "),
            (F.col("c")[2].cast("int") == F.col("tok_idx"), "word index out of order: "),
        ]
        for ok, message in checks:
            t = t.withColumn("c", F.when(F.coalesce(ok, F.lit(False)), F.col("c")).otherwise(F.raise_error(F.concat(F.lit(message), "line")).cast("array<string>")))
        t = t.withColumn("speaker", F.get("c", F.lit(9)))
        changed = F.min("speaker").over(spoken) != F.max("speaker").over(spoken)
        t = t.withColumn("speaker", F.when(F.coalesce(changed, F.lit(False)), F.raise_error(F.concat(F.lit("speaker changed: "), "line"))).otherwise(F.col("speaker")))
    else:
        t = t.withColumn("speaker", F.get("c", F.lit(9)))
    return t.select("doc", "name", "part", "utt_idx", "tok_idx", F.get("c", F.lit(3)).alias("word"), "speaker", F.element_at("c", -1).alias("coref"))


def parse_brackets(tokens: DataFrame, strict: bool = True, within: tuple[str, ...] = ("doc", "utt_idx"), position: str = "tok_idx") -> DataFrame:
    """(*within, label, start, end): the spans of the bracket column ``coref``, with inclusive ends.

    ``(n`` opens and ``n)`` closes the latest open span of label n, ``(n)`` is a span of one token. With windows: the
    nesting depth before each bracket pairs the k-th opening with the k-th closing of its depth. strict: brackets
    without a partner raise an error; otherwise they are dropped.
    """
    parts = F.posexplode(F.split("coref", r"\|")).alias("place", "x")
    b = tokens.where(F.coalesce(~F.col("coref").isin("-", "_"), F.lit(False))).select(*within, F.col(position).alias("at"), "coref", parts)
    label = F.regexp_extract("x", r"^\(?(\d+)\)?$", 1)
    if strict:
        label = F.when(label != "", label).otherwise(F.raise_error(F.concat(F.lit("bad coreference field: "), "x")))
    b = b.withColumn("label", label).where("label <> ''").withColumn("opens", F.col("x").startswith("(")).withColumn("closes", F.col("x").endswith(")"))
    single = b.where("opens and closes").select(*within, "label", F.col("at").alias("start"), F.col("at").alias("end"))
    rest = b.where("opens <> closes").withColumn("step", F.when(F.col("opens"), 1).otherwise(-1))
    own = Window.partitionBy(*within, "label")
    running = F.sum("step").over(own.orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0))
    rest = rest.withColumn("depth", running + F.when(F.col("opens"), 0).otherwise(1))
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy(*within, "label", "depth", "opens").orderBy("at", "place")))
    pairs = rest.groupBy(*within, "label", "depth", "k").agg(F.min(F.when(F.col("opens"), F.col("at"))).alias("start"), F.max(F.when(~F.col("opens"), F.col("at"))).alias("end"))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("depth") > 0)
    if strict:
        pairs = pairs.withColumn("end", F.when(whole, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("coreference bracket without partner: "), "label")).cast("int")))
    else:
        pairs = pairs.where(whole)
    return pairs.select(*within, "label", "start", "end").unionByName(single)


def utterances(tokens: DataFrame, clean: bool = True) -> DataFrame:
    """(doc, name, part, utt_idx, tokens, speaker, text) per utterance."""
    word = clean_token(F.col("word")) if clean else F.col("word")
    rows = tokens.groupBy("doc", "name", "part", "utt_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", word.alias("w")))).alias("x"), F.max("speaker").alias("speaker"))
    return rows.select("doc", "name", "part", "utt_idx", F.transform("x", lambda x: x["w"]).alias("tokens"), "speaker").withColumn("text", utterance_text(F.col("tokens")))


def scorer_tokens(documents: DataFrame) -> DataFrame:
    """(doc, pos, coref) as the scorer reads it: the last field of every line that is not blank, positions counted over the document."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    return documents.select("doc", F.posexplode(lines).alias("pos", "line")).select("doc", "pos", F.element_at(F.split(F.trim("line"), r"\s+"), -1).alias("coref"))


def scorer_entities(documents: DataFrame) -> DataFrame:
    """(doc_id, entity, mention, seq): input of the metrics. mention is ``start:end``; spans of one token count as read first."""
    found = parse_brackets(scorer_tokens(documents), within=("doc",), position="pos")
    seq = F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(F.col("start") + (1 << 30))
    return found.select(F.col("doc").alias("doc_id"), F.col("label").cast("long").alias("entity"), F.concat_ws(":", "start", "end").alias("mention"), seq.alias("seq"))


def align_tokens(pairs: DataFrame) -> DataFrame:
    """Add lookup: for each corpus token the numbers of the finer parser tokens that spell it.

    pairs has arrays ``conll`` and ``parsed`` that spell the same text. Both token sequences become offsets of their running
    lengths; a parser token belongs to the corpus token whose range holds its start, found by binary search. Texts that differ raise an error.
    """

    def numbers(conll: pd.Series, parsed: pd.Series) -> pd.Series:
        out = []
        for words, parts in zip(conll, parsed):
            if words is None or parts is None:
                out.append(None)
                continue
            ends, begins = (np.cumsum([0, *map(len, x)]) for x in (words, parts))
            at = np.searchsorted(begins[:-1], ends)
            out.append([list(range(a, b)) for a, b in zip(at, at[1:])])
        return pd.Series(out)

    same = F.array_join("conll", "") == F.array_join("parsed", "")
    lookup = F.pandas_udf(numbers, "array<array<int>>")("conll", "parsed")
    return pairs.withColumn("lookup", F.when(same, lookup).otherwise(F.raise_error(F.lit("corpus and parser tokens differ")).cast("array<array<int>>")))


def coref_column(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, utt_idx, tok_idx, coref): the bracket column of spans (doc, utt_idx, start, end inclusive, cluster, m_idx), in mention order, ``-`` without any."""
    one = F.col("start") == F.col("end")
    label = F.col("cluster").cast("string")
    marks = F.when(one, F.array(F.struct(F.col("start").alias("t"), F.concat(F.lit("("), label, F.lit(")")).alias("x")))).otherwise(
        F.array(F.struct(F.col("start").alias("t"), F.concat(F.lit("("), label).alias("x")), F.struct(F.col("end").alias("t"), F.concat(label, F.lit(")")).alias("x")))
    )
    cells = spans.where(F.col("cluster").isNotNull()).select("doc", "utt_idx", "m_idx", F.explode(marks).alias("m")).select("doc", "utt_idx", F.col("m.t").alias("tok_idx"), "m_idx", "m.x")
    joined = cells.groupBy("doc", "utt_idx", "tok_idx").agg(F.array_sort(F.collect_list(F.struct("m_idx", "x"))).alias("a")).select("doc", "utt_idx", "tok_idx", F.array_join(F.transform("a", lambda x: x["x"]), "|").alias("coref"))
    return tokens.drop("coref").join(joined, ["doc", "utt_idx", "tok_idx"], "left").withColumn("coref", F.coalesce("coref", F.lit("-")))


def response_spans(mentions: DataFrame, clusters: DataFrame, remove_singleton: bool = False, print_all_mentions: bool = False) -> DataFrame:
    """Mentions (doc_id, m_idx, ...) with the number ``cluster`` under which they are written, null for those left out.

    clusters: (doc_id, root, m_idx) of entities with two mentions or more, numbered by their roots. print_all_mentions: mentions outside them
    are written as entities of their own, unless remove_singleton.
    """
    found = mentions.join(clusters.select("doc_id", "m_idx", F.col("root").alias("__entity")), ["doc_id", "m_idx"], "left")
    alone = F.col("m_idx") if print_all_mentions and not remove_singleton else F.lit(None).cast("int")
    return found.withColumn("cluster", F.coalesce("__entity", alone)).drop("__entity")


def document_texts(tokens: DataFrame, line: Column | None = None) -> DataFrame:
    """(doc, value): documents written out, one line per token, a blank line after each utterance."""
    row = F.concat_ws(" ", "name", "part", F.col("tok_idx").cast("string"), "word", "coref") if line is None else line
    utts = tokens.withColumn("line", row).groupBy("doc", "name", "part", "utt_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "line"))).alias("l"))
    text = utts.withColumn("text", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n")))
    docs = text.groupBy("doc", "name", "part").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "text"))).alias("u"))
    head = F.concat(F.lit("#begin document ("), "name", F.lit("); part "), F.coalesce("part", F.lit("")), F.lit("\n"))
    return docs.select("doc", F.concat(head, F.array_join(F.transform("u", lambda x: x["text"]), ""), F.lit(END_LINE)).alias("value"))


def write_documents(texts: DataFrame, path: str, files: int | None = None) -> None:
    """Write documents (doc, value) as text, sorted by document within each file; ``files`` = 1 gives one key or response file."""
    out = texts.repartition(files) if files else texts
    out.sortWithinPartitions("doc").select("value").write.mode("overwrite").text(path)


def sentence_texts(utts: DataFrame) -> DataFrame:
    """(doc, value): documents as plain utterances between begin and end lines."""
    docs = utts.groupBy("doc", "name", "part").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "text"))).alias("u"))
    head = F.concat(F.lit("#begin document ("), "name", F.lit("); part "), F.coalesce("part", F.lit("")), F.lit("\n"))
    return docs.select("doc", F.concat(head, F.array_join(F.transform("u", lambda x: F.concat(x["text"], F.lit("\n"))), ""), F.lit(END_LINE)).alias("value"))
