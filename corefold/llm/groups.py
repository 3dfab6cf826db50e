"""Pairwise matches consolidated into groups by randomised contraction.

Every round each vertex hooks to the neighbour (or itself) that comes first in the order of a
fresh hash; edges are relabelled by the hooks and made distinct, loops fall away. The number of
vertices that still have an edge falls geometrically, so a chain of any length needs a
logarithmic number of rounds. Each round's hooks are a mapping table; the mappings are expanded
from the last, smallest one back to the first.

Scale: the first round moves the edges a few times, the later ones a shrinking part of them. A
vertex with very many edges costs no task more than others: its minimum is combined before the
shuffle, and in the relabelling joins both sides come from written tables, so that adaptive
execution splits its partition. Nothing but the number of remaining edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.runtime import discard, stash

_MAX_ROUNDS = 200


def connected_groups(edges: DataFrame, src: str = "src", dst: str = "dst", seed: int = 11) -> DataFrame:
    """(group_id, member): one row per vertex that is linked to another; group_id is the group's smallest member.

    Rows with a null end or with two equal ends link nothing. Repeated and reversed rows count as one
    link. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    current = stash(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mappings: list[DataFrame] = []
    for turn in range(_MAX_ROUNDS):
        if current.isEmpty():
            break
        mappings.append(stash(_hooks(current, seed + turn), "hooks"))
        relabelled = stash(_relabel(current, mappings[-1]), "edges")
        discard(spark, current)
        current = relabelled
    else:
        raise RuntimeError("the contraction did not end")
    discard(spark, current)
    if not mappings:
        return ends.select(F.col("a").alias("group_id"), F.col("b").alias("member")).limit(0)
    labels = mappings[-1]
    for mapping in reversed(mappings[:-1]):
        upper = labels.select(F.col("v").alias("r"), F.col("r").alias("top"))
        labels = mapping.join(upper, "r", "left").select("v", F.coalesce("top", "r").alias("r"))
    labels = stash(labels, "labels")
    discard(spark, *mappings)
    smallest = stash(labels.groupBy("r").agg(F.min("v").alias("group_id")), "smallest")
    return labels.join(smallest, "r").select("group_id", F.col("v").alias("member"))


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(v, r): every vertex with the first of itself and its neighbours in this round's hash order."""
    directed = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
    order = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    first = directed.withColumn("h", order("w")).groupBy("v").agg(F.min("h").alias("h"), F.min_by("w", "h").alias("w"))
    return first.select("v", F.when(F.col("h") < order("v"), F.col("w")).otherwise(F.col("v")).alias("r"))


def _relabel(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    left = hooks.select(F.col("v").alias("a"), F.col("r").alias("ra"))
    right = hooks.select(F.col("v").alias("b"), F.col("r").alias("rb"))
    moved = edges.join(left, "a").select("ra", "b").join(right, "b").where("ra <> rb")
    return moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def mention_links(pairs: DataFrame, mentions: DataFrame, features: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst): the links between mentions, from matched pairs and from equal gold labels.

    A label links its mentions as a star around the smallest one, not pair by pair. Spans are
    compared in one document and utterance, the inclusive gold end against the exclusive end of
    ``locations`` less one. A mention's row is found by its document and index.
    """
    matched = pairs.where(F.col("pairs_labels") == 1).select(F.col("mention_id").alias("src"), F.col("pairs_ant_index").alias("dst"))
    utterances = docs.select("conll_doc_id", F.posexplode("gold_corefs").alias("utterance", "entries"))
    gold = utterances.select("conll_doc_id", "utterance", F.explode("entries").alias("g")).select(
        "conll_doc_id", "utterance", F.col("g.span_start").alias("s"), F.col("g.span_end").alias("e"), F.col("g.label").alias("label")
    )
    gold = gold.where(F.col("label").isNotNull()).distinct()
    places = features.select("conll_doc_id", F.explode("locations").alias("p")).select(
        "conll_doc_id", F.col("p.utterance").alias("utterance"), F.col("p.span_start").alias("s"), (F.col("p.span_end") - 1).alias("e"), F.col("p.mention").alias("index")
    )
    rows = mentions.select("conll_doc_id", F.get("mentions_features", F.lit(2)).alias("index"), "mention_id")
    labelled = gold.join(places, ["conll_doc_id", "utterance", "s", "e"]).select("conll_doc_id", "index", "label").distinct()
    labelled = stash(labelled.join(rows, ["conll_doc_id", "index"]).select("conll_doc_id", "label", "mention_id").distinct(), "labelled")
    centre = labelled.groupBy("conll_doc_id", "label").agg(F.min("mention_id").alias("dst"))
    stars = labelled.join(centre, ["conll_doc_id", "label"]).select(F.col("mention_id").alias("src"), "dst")
    return matched.unionByName(stars)
