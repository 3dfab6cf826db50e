"""Embedding lookups and averages: left joins with fallbacks and element-wise means of arrays.

An embeddings table has (kind: static | tuned, word, vec). It is joined like any dimension; whether it is
broadcast is left to its measured size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions.lexical import MISSING_WORD, UNKNOWN_WORD, normalise_inference, normalise_training
from corefold.operators.mentions import whole_documents
from corefold.runtime import stash

PUNCTUATION = [".", "!", "?"]


def vector_sum(vectors: Column, width: int) -> Column:
    """Element-wise sum of an array of arrays of ``width`` numbers; zeros for none."""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def mean_vectors(rows: DataFrame, keys: list[str], vec: str, width: int) -> DataFrame:
    """(keys, vec, n): the mean vector of each group, one sum per dimension, so that partial sums are combined before the shuffle."""
    sums = rows.groupBy(*keys).agg(F.count(vec).alias("n"), *[F.sum(F.get(vec, F.lit(i)).cast("double")).alias(f"s{i}") for i in range(width)])
    return sums.select(*keys, F.array(*[F.coalesce(F.col(f"s{i}") / F.greatest("n", F.lit(1)), F.lit(0.0)) for i in range(width)]).alias("vec"), "n")


def conversion_vectors(conversions: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """(word, vec): each key of a conversion table (word, replacements) with the mean of its replacements' vectors, tuned before static; no replacement gives zeros."""
    words = conversions.select(F.lower("word").alias("word"), F.explode_outer("replacements").alias("r")).withColumn("lookup", F.lower("r"))
    found = lookup(words.where("r is not null").withColumnRenamed("lookup", "key"), "key", embeddings)
    every = words.select("word").distinct()
    return every.join(mean_vectors(found, ["word"], "vec", width).drop("n"), "word", "left").select("word", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))


def vocabulary(embeddings: DataFrame) -> DataFrame:
    """(word, tuned, static): one row per word, written once, so that a word that a third of all tokens are does not fill one task of a join."""
    of = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("vec")), ignorenulls=True).alias(kind)
    return stash(embeddings.where("word is not null").groupBy("word").agg(of("tuned"), of("static")), "vocabulary")


def lookup(rows: DataFrame, key: str, embeddings: DataFrame, tuned: bool = True, conversions: DataFrame | None = None, out: str = "vec") -> DataFrame:
    """Add a word's vector: from the conversions, else tuned (if asked), else static, else the unknown word's. embeddings: (kind, word, vec) or a ``vocabulary``."""
    known = embeddings if "static" in embeddings.columns else vocabulary(embeddings)
    own = F.coalesce("tuned", "static") if tuned else F.col("static")
    joined, parts = rows.join(known.select(F.col("word").alias(key), own.alias("__own")), key, "left"), ["__own"]
    if conversions is not None:
        joined = joined.join(conversions.select(F.col("word").alias(key), F.col("vec").cast("array<double>").alias("__c")), key, "left")
        parts.insert(0, "__c")
    unknown = known.where(F.col("word") == UNKNOWN_WORD).agg(F.first(F.coalesce(*(["tuned", "static"] if tuned else ["static", "tuned"]))).alias("__unk"))
    joined = joined.join(F.broadcast(unknown), F.lit(True), "left")  # one row
    return joined.withColumn(out, F.coalesce(*[F.col(p).cast("array<double>") for p in [*parts, "__unk"]])).drop(*parts, "__unk")


def initial_vectors(words: DataFrame, width: int, seed: int = 0, bound: float = 0.5) -> DataFrame:
    """(kind, word, vec): tuned vectors with seeded numbers, even over -bound to bound, for words without pretrained ones."""
    number = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "word", i), F.lit(1 << 24)) / float(1 << 23) - 1) * bound
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: number(i).cast("float"))
    return words.where("word is not null").select("word").distinct().select(F.lit("tuned").alias("kind"), "word", vec.alias("vec"))


def check_width(embeddings: DataFrame, width: int) -> DataFrame:
    """The same table; reading a vector of another width raises an error."""
    wrong = F.raise_error(F.concat(F.lit("vector of another width: "), "word")).cast(embeddings.schema["vec"].dataType)
    return embeddings.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")).otherwise(wrong))


def normalised(tokens: DataFrame, profile: str) -> DataFrame:
    return tokens.withColumn("key", normalise_inference(F.col("text")) if profile == "inference" else normalise_training(F.col("text")))


def average_spans(spans: DataFrame, tokens: DataFrame, width: int, out: str, skip_punctuation: bool) -> DataFrame:
    """Add the mean static vector of the tokens in [start, end) of spans (doc_id, m_idx, start, end); zeros for none.

    Prefix sums per document make each average the difference of two rows, so long spans and sentences cost no more than short ones.
    """
    counts = F.lit(1) if not skip_punctuation else (~F.col("text").isin(PUNCTUATION)).cast("int")
    order = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    dims = [F.sum(F.get("vec", F.lit(i)) * F.col("counts")).over(order).alias(f"d{i}") for i in range(width)]
    sums = tokens.withColumn("counts", counts).select("doc_id", "tok_idx", F.sum("counts").over(order).alias("n"), *dims)
    sums = sums.select("doc_id", (F.col("tok_idx") + 1).alias("at"), "n", F.array(*[f"d{i}" for i in range(width)]).alias("v"))
    right = sums.select("doc_id", F.col("at").alias("end"), F.col("n").alias("n1"), F.col("v").alias("v1"))
    left = sums.select("doc_id", F.col("at").alias("start"), F.col("n").alias("n0"), F.col("v").alias("v0"))
    zero = F.array_repeat(F.lit(0.0), width)
    joined = spans.join(right, ["doc_id", "end"], "left").join(left, ["doc_id", "start"], "left")
    n = F.greatest(F.coalesce("n1", F.lit(0)) - F.coalesce("n0", F.lit(0)), F.lit(1))
    mean = F.zip_with(F.coalesce("v1", zero), F.coalesce("v0", zero), lambda a, b: (a - b) / n)
    return joined.withColumn(out, F.when(F.col("end") > F.col("start"), mean).otherwise(zero)).drop("n0", "n1", "v0", "v1")


def document_embeddings(static: DataFrame, width: int, utterances: DataFrame | None = None) -> DataFrame:
    """(doc_id, vec): the mean over a document's utterances of the mean vector of their words without punctuation; utterances without words count as zeros.

    static: (doc_id, utt_idx, text, vec) of all tokens. utterances: (doc_id, utt_idx) of all utterances; without it those up to the last one with tokens count.
    """
    if utterances is None:
        totals = static.groupBy("doc_id").agg((F.max("utt_idx") + 1).alias("total"))
    else:
        totals = utterances.groupBy("doc_id").agg(F.countDistinct("utt_idx").alias("total"))
    per_utterance = mean_vectors(static.where(~F.col("text").isin(PUNCTUATION)), ["doc_id", "utt_idx"], "vec", width).drop("n")
    means = mean_vectors(per_utterance, ["doc_id"], "vec", width)
    return means.join(totals, "doc_id").select("doc_id", F.transform("vec", lambda x: x * F.col("n") / F.col("total")).alias("vec"))


def mention_embeddings(mentions: DataFrame, tokens: DataFrame, embeddings: DataFrame, width: int = 50, profile: str = "inference", conversions: DataFrame | None = None, utterances: DataFrame | None = None) -> DataFrame:
    """(doc_id, m_idx, embedding): 13 blocks of ``width`` - mention, left and right context (5 tokens), sentence and document averages, then
    root, first, last, the words at -1, 0 (after the end), -2, +1, and the root's head. Neighbours beyond the sentence are the missing word.
    The document block is zero in the inference profile; else it averages the utterances (utt_idx of the tokens, without it one a document;
    empty ones are taken from ``utterances``).
    """
    embeddings = embeddings if "static" in embeddings.columns else vocabulary(embeddings)
    t = normalised(tokens if "utt_idx" in tokens.columns else tokens.withColumn("utt_idx", F.lit(0)), profile)
    static = stash(lookup(t.select("doc_id", "sent_idx", "utt_idx", "tok_idx", "text", "key"), "key", embeddings, tuned=False), "static")
    word = lookup(t.select("doc_id", "sent_idx", "tok_idx", "head", "key"), "key", embeddings, True, conversions, "wv").select("doc_id", "sent_idx", "tok_idx", "head", "wv")
    word = stash(word, "words")
    bounds = tokens.groupBy("doc_id", "sent_idx").agg(F.min("tok_idx").alias("s0"), (F.max("tok_idx") + 1).alias("s1"))
    m = mentions.select("doc_id", "m_idx", "sent_idx", "start", "end", "root").join(bounds, ["doc_id", "sent_idx"])
    skip = profile == "training"
    ranges = {"e0": ("start", "end"), "e1": (F.greatest(F.col("start") - 5, F.col("s0")), "start"), "e2": ("end", F.least(F.col("end") + 5, F.col("s1"))), "e3": ("s0", "s1")}
    out = m
    for name, (lo, hi) in ranges.items():
        col = lambda c: F.col(c) if isinstance(c, str) else c
        spans = m.select("doc_id", "m_idx", col(lo).alias("start"), col(hi).alias("end"))
        out = out.join(average_spans(spans, static, width, name, skip).select("doc_id", "m_idx", name), ["doc_id", "m_idx"])
    zero = F.array_repeat(F.lit(0.0), width)
    if profile == "training":
        out = out.join(document_embeddings(static, width, utterances).select("doc_id", F.col("vec").alias("e4")), "doc_id", "left").withColumn("e4", F.coalesce("e4", zero))
    else:
        out = out.withColumn("e4", zero)
    missing = embeddings.where(F.col("word") == MISSING_WORD).agg(F.first(F.coalesce("tuned", "static")).cast("array<double>").alias("missing"))
    out = out.join(F.broadcast(missing), F.lit(True), "left")  # one row
    heads = word.select("doc_id", F.col("tok_idx").alias("root"), "head")
    out = out.join(heads, ["doc_id", "root"], "left")
    places = {"e5": F.col("root"), "e6": F.col("start"), "e7": F.col("end") - 1, "e8": F.col("start") - 1, "e9": F.col("end"), "e10": F.col("start") - 2, "e11": F.col("end") + 1, "e12": F.col("head")}
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("int").alias("tok_idx")) for name, at in places.items()])).alias("x")
    cells = out.select("doc_id", "m_idx", "sent_idx", wanted).select("doc_id", "m_idx", "sent_idx", "x.name", "x.tok_idx").join(word.select("doc_id", "sent_idx", "tok_idx", "wv"), ["doc_id", "sent_idx", "tok_idx"])
    words = cells.groupBy("doc_id", "m_idx").agg(F.map_from_entries(F.collect_list(F.struct("name", "wv"))).alias("w"))
    out = out.join(words, ["doc_id", "m_idx"], "left")
    blocks = [F.col(f"e{i}") for i in range(5)] + [F.coalesce(F.element_at("w", name), "missing", zero) for name in places]
    return out.select("doc_id", "m_idx", F.concat(*blocks).cast("array<float>").alias("embedding"))


_BLOCKS = [f"b{i}" for i in range(13)]


def block_weights(mentions: DataFrame, tokens: DataFrame, utterances: DataFrame) -> DataFrame:
    """(profile, key, b0 .. b12): how much of each word's vector the embeddings of all mentions hold, block by block, in both profiles.

    A block's sum over mentions is linear in the words' vectors, so that only numbers leave the batches of whole documents, one row for a
    word and batch. The blocks are those of ``mention_embeddings``; a null key stands for the missing word. utterances: (doc_id, utt_idx,
    n_chars) of all utterances; a token's is the one in whose characters it starts. Tokens are numbered from 0 in each document, without gaps.
    """
    order = Window.partitionBy("doc_id").orderBy("utt_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = utterances.select("doc_id", F.coalesce(F.sum("n_chars").over(order), F.lit(0)).cast("long").alias("at")).groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("u"))
    each = mentions.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("start", "end", "root")])).alias("m"))
    held = each.join(starts, "doc_id", "left")
    rows = tokens.select("doc_id", "sent_idx", "tok_idx", "head", "start_char", F.col("text").isin(PUNCTUATION).alias("mark"), normalise_inference(F.col("text")).alias("inference"), normalise_training(F.col("text")).alias("training"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx"))).join(held.hint("shuffle_hash"), "doc_id")
    # A document's mentions and utterances go with its first token only.
    first = lambda c: F.when(F.col("row") == 1, F.col(c)).alias(c)
    found = rows.select(*rows.columns[1:-2], first("m"), first("u")).mapInArrow(whole_documents(_weighed_batch), "profile string, key string, " + ", ".join(f"{b} double" for b in _BLOCKS))
    return found.groupBy("profile", "key").agg(*[F.sum(b).alias(b) for b in _BLOCKS])


def _weighed_batch(table: pa.Table) -> pa.RecordBatch:
    column = {c: table[c].combine_chunks() for c in table.column_names}
    number = lambda c: pc.fill_null(column[c], -1).to_numpy().astype(np.int64)
    n, opens, sent, head = table.num_rows, number("row") == 1, number("sent_idx"), number("head")
    doc, doc_row = np.cumsum(opens) - 1, np.flatnonzero(opens)
    begins = np.flatnonzero(opens | np.r_[True, sent[1:] != sent[:-1]])
    sentence = np.zeros(n, np.int64)
    sentence[begins[1:]] = 1
    sentence = np.cumsum(sentence)
    s0, s1 = begins, np.r_[begins[1:], n]
    lists = lambda c: (pc.fill_null(pc.list_value_length(column[c].take(pa.array(doc_row))), 0).to_numpy().astype(np.int64), column[c].take(pa.array(doc_row)).flatten())
    per_doc, flat = lists("m")
    base = np.repeat(doc_row, per_doc)
    start, end, root = (base + flat.field(c).to_numpy() for c in ("start", "end", "root"))
    low, high = s0[sentence[start]], s1[sentence[start]]

    n_utts, starts = lists("u")
    far = max(int(starts.to_numpy().max(initial=0)), int(number("start_char").max(initial=0))) + 1
    firsts = np.repeat(np.arange(len(doc_row)), n_utts) * far + starts.to_numpy()
    utt = np.searchsorted(firsts, doc * far + number("start_char"), "right") - 1

    ranges = [(start, end), (np.maximum(start - 5, low), start), (end, np.minimum(end + 5, high)), (low, high)]
    words = [root, start, end - 1, start - 1, end, start - 2, end + 1, base + head[root]]
    mark = pc.fill_null(column["mark"], False).to_numpy(zero_copy_only=False)
    out = []
    for profile in ("inference", "training"):
        counts = ~mark if profile == "training" else np.ones(n, bool)
        before = np.r_[0, np.cumsum(counts)]
        keys = column[profile].dictionary_encode()
        # The last code is that of the missing word.
        code, missing = pc.fill_null(keys.indices, len(keys.dictionary)).to_numpy().astype(np.int64), len(keys.dictionary)
        total = np.zeros((13, missing + 1))
        for block, (lo, hi) in enumerate(ranges):
            real = hi > lo
            share = 1 / np.maximum(before[hi] - before[lo], 1)
            steps = np.bincount(lo[real], share[real], n + 1) - np.bincount(hi[real], share[real], n + 1)
            total[block] = np.bincount(code, np.where(counts, np.cumsum(steps)[:n], 0), missing + 1)
        if profile == "training":
            told = np.flatnonzero(counts & (n_utts[doc] > 0))
            share = per_doc[doc[told]] / n_utts[doc[told]] / np.bincount(utt[told], minlength=len(firsts))[utt[told]]
            total[4] = np.bincount(code[told], share, missing + 1)
        for block, at in enumerate(words, 5):
            inside = (at >= low) & (at < high)
            total[block] = np.bincount(np.where(inside, code[np.clip(at, 0, n - 1)], missing), minlength=missing + 1)
        names = pa.concat_arrays([keys.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        out.append(pa.RecordBatch.from_arrays([pa.array([profile] * (missing + 1)), names, *map(pa.array, total)], names=["profile", "key", *_BLOCKS]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def block_sums(weights: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(profile, block, first, total) from ``block_weights``: over all mentions, the sums of each block's first position and of all its positions."""
    known = embeddings if "static" in embeddings.columns else vocabulary(embeddings)
    both = lambda v: F.array(F.get(v, F.lit(0)).cast("double"), F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x))
    known = known.select("word", *[F.when(F.col(c).isNotNull(), both(c)).alias(c) for c in ("static", "tuned")])
    of = lambda word, *kinds: F.first(F.when(F.col("word") == word, F.coalesce(*kinds)), ignorenulls=True)
    reserved = known.where(F.col("word").isin(UNKNOWN_WORD, MISSING_WORD)).agg(of(UNKNOWN_WORD, "static", "tuned").alias("us"), of(UNKNOWN_WORD, "tuned", "static").alias("ut"), of(MISSING_WORD, "tuned", "static").alias("missing"))
    rows = weights.join(known, F.col("key") == F.col("word"), "left").join(F.broadcast(reserved), F.lit(True), "left")  # one row
    zero = F.array(F.lit(0.0), F.lit(0.0))
    static = F.coalesce("static", "us", zero)
    word = F.when(F.col("key").isNull(), F.coalesce("missing", zero)).otherwise(F.coalesce("tuned", "static", "ut", "missing", zero))
    cells = [F.struct(F.lit(i).alias("block"), *[(F.col(b) * F.get(static if i < 5 else word, F.lit(k))).alias(name) for k, name in enumerate(("first", "total"))]) for i, b in enumerate(_BLOCKS)]
    return rows.select("profile", F.explode(F.array(*cells)).alias("x")).groupBy("profile", "x.block").agg(F.sum("x.first").alias("first"), F.sum("x.total").alias("total"))


def words_outside(words: DataFrame, embeddings: DataFrame, kind: str = "static") -> DataFrame:
    """Rows whose word has no vector of that kind."""
    known = stash(embeddings.where(F.col("kind") == kind).select("word").distinct(), "known")  # so that a hot word can be split
    return words.join(known, "word", "left_anti")


def word_ids(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add word_id from a vocabulary (word, word_id); a word that it lacks has the missing word's."""
    missing = vocabulary.where(F.col("word") == MISSING_WORD).agg(F.min("word_id").alias("__missing"))
    return words.join(vocabulary, "word", "left").join(F.broadcast(missing), F.lit(True), "left").withColumn("word_id", F.coalesce("word_id", "__missing")).drop("__missing")  # one row
