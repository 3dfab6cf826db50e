"""Candidate pairs of mentions: an index band, shared content words, or all earlier mentions.

A mentions table has doc_id and m_idx (0, 1, ... in each document). Bands are generated from the index, not
joined, and word matches from the list of a word's mentions, as far back as they may reach. Mentions are partitioned by document
before their pairs are made, by the same rule here and in ``with_sides``; so pairs, the largest table, are never sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.runtime import by_document


def band_pairs(mentions: DataFrame, max_dist: int | None = 50) -> DataFrame:
    """(doc_id, men_idx, ant_idx) of all antecedents at most ``max_dist`` back; of all earlier ones with None."""
    lowest = F.col("m_idx") - band_length(max_dist)
    return mentions.where("m_idx > 0").select("doc_id", F.col("m_idx").alias("men_idx"), F.explode(F.sequence(lowest, F.col("m_idx") - 1)).alias("ant_idx"))


def band_length(max_dist: int | None) -> Column:
    """How many antecedents ``band_pairs`` gives a mention, where all earlier numbers are there."""
    return F.col("m_idx") if max_dist is None else F.least(F.col("m_idx"), F.lit(max_dist))


def match_pairs(mentions: DataFrame, max_dist_match: int | None = 500, beyond: int = 0, compat_unsigned: bool = False, new: Column | None = None) -> DataFrame:
    """Pairs that share a content word, between ``beyond`` + 1 and ``max_dist_match`` back.

    compat_unsigned leaves out mentions before index ``max_dist_match``, as unsigned index arithmetic does. new: a condition on the later mention.
    """
    # The mentions of a word in a document are one list, in order; those at most so far back are among as many places before.
    one = F.struct(F.col("m_idx").cast("int").alias("i"), (F.lit(True) if new is None else new).alias("new"))
    words = by_document(mentions, "doc_id", "content_words", one.alias("m")).select("doc_id", "m", F.explode(F.array_distinct("content_words")).alias("word"))
    lists = words.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("m")).alias("l")).where(F.size("l") > 1)
    later = lists.select("doc_id", F.col("l")["i"].alias("l"), F.posexplode("l").alias("k", "m")).where("m.new")
    behind = F.col("k") if max_dist_match is None else F.least("k", F.lit(max_dist_match))
    pairs = later.select("doc_id", F.col("m.i").alias("men_idx"), F.explode(F.slice("l", F.col("k") - behind + 1, behind)).alias("ant_idx"))
    far = F.col("men_idx") - F.col("ant_idx")
    pairs = pairs.where(far > beyond if max_dist_match is None else far.between(beyond + 1, max_dist_match))
    if compat_unsigned and max_dist_match is not None:
        pairs = pairs.where(F.col("men_idx") >= max_dist_match)
    return pairs.distinct()


def candidate_pairs(mentions: DataFrame, max_dist: int | None = 50, max_dist_match: int | None = 500, compat_unsigned: bool = False, new: Column | None = None) -> DataFrame:
    """The union of the band and the word matches. Matches are made beyond the band only, so the union needs no distinct.

    new: a condition on the later mention of a pair. All pairs of a document are made where its mentions are.
    """
    band = band_pairs(by_document(mentions, "doc_id", "m_idx", *([] if new is None else [new.alias("new")])).where(F.lit(True) if new is None else F.col("new")), max_dist)
    if max_dist is None or max_dist_match is not None and max_dist_match <= max_dist:
        return band
    return band.unionByName(match_pairs(mentions, max_dist_match, max_dist, compat_unsigned, new))


def pairs_of_new(pairs: DataFrame, mentions: DataFrame, is_new: Column) -> DataFrame:
    """Only the pairs whose later mention is new; antecedents may be any earlier mention."""
    new = mentions.where(is_new).select("doc_id", F.col("m_idx").alias("men_idx"))
    return pairs.join(new, ["doc_id", "men_idx"], "left_semi")


def pair_offsets(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, m_idx, pairs_length, pairs_start): how many pairs each mention has and where they start in its document."""
    counts = pairs.groupBy("doc_id", F.col("men_idx").alias("m_idx")).agg(F.count(F.lit(1)).alias("n"))
    all_ = mentions.select("doc_id", "m_idx").join(counts, ["doc_id", "m_idx"], "left").withColumn("pairs_length", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("doc_id").orderBy("m_idx").rowsBetween(Window.unboundedPreceding, -1)
    return all_.select("doc_id", "m_idx", "pairs_length", F.coalesce(F.sum("pairs_length").over(before), F.lit(0)).alias("pairs_start"))


def self_pairs(mentions: DataFrame) -> DataFrame:
    """The pair of every mention with itself, which stands for a new entity."""
    return mentions.select("doc_id", F.col("m_idx").alias("men_idx"), F.col("m_idx").alias("ant_idx"))


def with_sides(pairs: DataFrame, mentions: DataFrame, names: tuple[str, str] = ("a", "m")) -> DataFrame:
    """Add both mentions as structs ``a`` (antecedent) and ``m``.

    A document's mentions are one array, in which both are looked up by index. The mentions are partitioned as ``candidate_pairs`` of
    as many are, so that these are not sent. Pairs of mentions that do not exist are dropped.
    """
    side = F.struct(F.col("m_idx").cast("int").alias("m_idx"), *[c for c in mentions.columns if c not in ("doc_id", "m_idx")])
    lists = by_document(mentions, "doc_id", "m_idx", side.alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("m_idx").cast("int").alias("at"), "x"))).alias("l"))
    dense = F.element_at("l", -1)["at"] + 1 == F.size("l")
    # Where numbers are missing, their places are null.
    upto = lambda x, k: F.coalesce(F.get("l", k + 1)["at"] - 1, x["at"])
    places = lambda x, k: F.sequence(F.when(k == 0, F.lit(0)).otherwise(x["at"]), upto(x, k))
    filled = F.flatten(F.transform("l", lambda x, k: F.transform(places(x, k), lambda i: F.when(i == x["at"], x["x"]))))
    per_doc = lists.select("doc_id", F.when(dense, F.col("l")["x"]).otherwise(filled).alias("__all"))
    found = lambda index: F.get("__all", F.col(index).cast("int"))
    # A partition's arrays are those of ``each`` mentions or of one document; hashed, they spare a sort of the pairs.
    joined = pairs.join(per_doc.hint("shuffle_hash"), "doc_id").select(*pairs.columns, found("ant_idx").alias(names[0]), found("men_idx").alias(names[1]))
    return joined.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())
