"""Per-key results where a few keys own most rows.

``tree_aggregate`` merges mergeable states (sums, minima, maxima) in rounds. Round 0 combines
each input chunk - one task's split - locally; round r merges the partial states of at most
``fan_in`` chunks of round r-1. No task ever receives all partial states of a key: with C
chunks a key needs ceil(log_fan_in C) rounds, and one task merges at most ``fan_in`` states
of a key in each round (``chunks / fan_in**rounds`` more in the first one where there are
more splits than slots).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.runtime import stash

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
_SLOT = "__slot"


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: dict[str, tuple[str, Column]], fan_in: int = 32, slots: int | None = None) -> DataFrame:
    """One row per distinct ``keys`` with the merged states.

    states: output name -> (``sum`` | ``min`` | ``max``, expression over a row). A null key is a
    group of its own; null values are ignored as by SQL aggregates (a sum over no value is
    null). Repeated rows count each time, so rows that must count once are made distinct
    before. An empty table gives no rows. Columns beside keys and expressions are not read. slots: about how many
    splits the input has; by default what the session makes of a shuffle, at least 1,024.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    slots = slots or max(1024, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    level = df.select(*keys, F.pmod(F.spark_partition_id(), F.lit(slots)).alias(_SLOT), *[value.alias(name) for name, (_, value) in states.items()])
    merged = [_MERGE[kind](F.col(name)).alias(name) for name, (kind, _) in states.items()]
    level = level.groupBy(*keys, _SLOT).agg(*merged)
    for _ in range(max(1, math.ceil(math.log(slots, fan_in))) - 1):
        level = level.withColumn(_SLOT, F.floor(F.col(_SLOT) / fan_in).cast("int")).groupBy(*keys, _SLOT).agg(*merged)
    return level.drop(_SLOT).groupBy(*keys).agg(*merged)


def fill_from(df: DataFrame, column: str, key: str, lookup: DataFrame) -> DataFrame:
    """Replace null ``column`` by the lookup's value for ``key``; other rows take no part in the join.

    lookup has the columns ``key`` and ``column``. A key that it lacks leaves the null; of several
    values for one key the smallest holds. Only the rows with a null travel, so rows
    that need no value cannot pile up on the null key.
    """
    values = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias("__filled"))
    missing = df.where(F.col(column).isNull()).join(values, key, "left").withColumn(column, F.col("__filled")).select(*df.columns)
    return df.where(F.col(column).isNotNull()).unionByName(missing)


def name_results(pairs: DataFrame, mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, pairs, matches, mentions, pairs_length) for every name.

    Each ``pair_row`` and each ``mention_id`` counts once (repeated rows are exact copies); rows
    without one do not count. A null name is the name of the row's document; where that is null or
    missing too, the rows form the group of the null name. ``matches`` counts labels equal to 1.
    Duplicates are dropped by their high-cardinality row id, which spreads a hot name over all
    tasks; names are resolved on the (document, name) states, after the local combine.
    """
    pair_rows = pairs.where(F.col("pair_row").isNotNull()).select("pair_row", "conll_doc_id", "name", F.coalesce((F.col("pairs_labels") == 1).cast("int"), F.lit(0)).alias("hit"))
    pair_rows = pair_rows.distinct()
    by_doc = tree_aggregate(pair_rows, ["conll_doc_id", "name"], {"pairs": ("sum", F.lit(1).cast("long")), "matches": ("sum", F.col("hit").cast("long"))})
    mention_rows = mentions.where(F.col("mention_id").isNotNull()).select("mention_id", "conll_doc_id", "name", F.coalesce(F.col("mentions_pairs_length"), F.lit(0)).cast("long").alias("length")).distinct()
    of_mentions = tree_aggregate(mention_rows, ["conll_doc_id", "name"], {"mentions": ("sum", F.lit(1).cast("long")), "pairs_length": ("sum", F.col("length"))})
    zero = F.lit(0).cast("long")
    both = by_doc.withColumn("mentions", zero).withColumn("pairs_length", zero).unionByName(of_mentions.withColumn("pairs", zero).withColumn("matches", zero))
    both = stash(both, "states")  # small, and read twice
    named = fill_from(both, "name", "conll_doc_id", docs.select("conll_doc_id", "name"))
    return tree_aggregate(named, ["name"], {c: ("sum", F.col(c)) for c in ("pairs", "matches", "mentions", "pairs_length")})


def heavy_names(results: DataFrame, one_in: int = 20) -> DataFrame:
    """Names that own at least one in ``one_in`` of all pair rows (the null group has no name and is left out)."""
    kept = stash(results.select("name", "pairs"), "name-results")
    total = kept.agg(F.sum("pairs").alias("total"))
    return kept.where(F.col("name").isNotNull()).where(F.col("pairs") * one_in >= total.scalar()).select("name")
