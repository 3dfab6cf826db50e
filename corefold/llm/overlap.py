"""Records of evaluation splits that occur, exactly or almost, in the training split.

Method: the hashes of the evaluation records' word n-grams are partitioned by hash, the training records are
scanned for hits, hits are summed by pair of records, and from the sums come the containment of the evaluation
record in the training record and the similarity of the two.

* Records of one side with one n-gram set are a class, known by two fingerprints of the set, and only classes are compared.
* A filter of the evaluation n-grams (``hashes.key_filter``, bounded) is applied in the scan of the training records, before
  anything is exploded or shuffled: n-grams that no evaluation record has stay where they are.
* N-grams that over ``hot`` training classes have would cause most of the hits and say least. A pair at the threshold
  shares at least ``least`` n-grams, so an evaluation record may put off looking up ``least - 1`` of
  them: it puts off its hot ones, the hottest first, and looks up all others. A pair whose hits and put-off
  n-grams together do not reach the threshold is dropped; for the rest the put-off n-grams are counted in
  the sets themselves. No hit is capped or left out.

Records without tokens of their own - all n-grams hot, more than can be put off - look up the least hot ones; if a large
part of a collection is like that, these hits are what the operator costs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.llm.hashes import MOST_WORDS, key_filter, may_hold, mix
from corefold.runtime import discard, stash

_MOST_KEPT = 1 << 19
_U = np.uint64
_SET = "n int, f long, g long, grams array<long>"


def _scan(records: DataFrame, n: int, clean: Callable[[str], str] | None, keep) -> DataFrame:
    """(id, n, f, g, grams): the number of distinct n-gram hashes of each row, two fingerprints of their set, and what ``keep`` leaves of it.

    keep(ids, doc, gram, f, g) is called by batch with the rows' ids and fingerprints, and for every n-gram its row and hash; it returns
    which rows and which of the n-grams to put out. clean maps a token (null as '') to its plain form, once per distinct token and process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, int] = {}
        chosen = keep()
        for batch in batches:
            tokens = batch["tokens"]
            sizes = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode(null_encoding="encode")
            if len(seen) > _MOST_KEPT:
                seen.clear()
            for word in coded.dictionary.to_pylist():
                if word not in seen:
                    plain = (clean(word or "") if clean else word or "").encode("utf-8", "surrogatepass")
                    seen[word] = int.from_bytes(hashlib.blake2b(plain, digest_size=8).digest(), "little")
            table = np.array([seen[word] for word in coded.dictionary.to_pylist()], np.uint64)
            words = table[coded.indices.to_numpy()] if len(table) else table
            counts = np.maximum(sizes - (n - 1), 0)
            doc = np.repeat(np.arange(len(sizes)), counts)
            at = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
            gram = words[at]
            for k in range(1, n):
                gram = mix(gram * _U(0x9E3779B97F4A7C15) + words[at + k])
            order = np.lexsort((gram, doc))
            doc, gram = doc[order], gram[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
            doc, gram = doc[new], gram[new]
            held = np.bincount(doc, minlength=len(sizes))
            ends = np.r_[0, np.cumsum(held)]
            sums = [np.r_[_U(0), np.cumsum(mix(gram + _U(seed)))] for seed in (1, 2)]
            f, g = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
            ids = batch["id"].to_numpy(zero_copy_only=False)
            rows, kept = chosen(ids, doc, gram.view(np.int64), f, g)
            kept &= rows[doc]
            left = np.bincount(doc[kept], minlength=len(sizes))[rows]
            grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)], pa.int32()), pa.array(gram[kept].view(np.int64)))
            columns = [ids[rows], held[rows].astype(np.int32), f[rows], g[rows]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), grams], names=["id", "n", "f", "g", "grams"])

    tokens = F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    plain = records.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), tokens)
    return plain.mapInArrow(run, "id long, " + _SET)


def _of_ids(words: np.ndarray):
    """All rows; of those whose id may be in the filter, with their n-grams."""

    def start():
        return lambda ids, doc, gram, f, g: (np.ones(len(ids), bool), may_hold(words, ids)[doc])

    return start


def _of_grams(words: np.ndarray):
    """The first row of each set in this task; those of its n-grams that may be in the filter."""

    def start():
        seen: set[tuple[int, int]] = set()

        def chosen(ids, doc, gram, f, g):
            kept = may_hold(words, gram)
            rows = np.bincount(doc[kept], minlength=len(ids)) > 0
            for k in np.flatnonzero(rows):
                pair = (f[k], g[k])
                rows[k] = pair not in seen
                if len(seen) < _MOST_KEPT:
                    seen.add(pair)
            return rows, kept

        return chosen

    return start


def _least(n: Column, share: float) -> Column:
    """The smallest whole number that is at least ``share`` of n, rounding errors aside."""
    return F.ceil(n * share - 1e-9).cast("int")


def find_overlaps(
    records: DataFrame,
    sides: DataFrame,
    n: int = 5,
    similarity: float | None = None,
    containment: float | None = None,
    clean: Callable[[str], str] | None = None,
    hot: int = 16,
    most_words: int = MOST_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(overlaps, classes) of records (id, tokens) and their sides (id, side), side being 'train' or 'eval'.

    classes: (id, side, class, n), one row per record with an n-gram; class is the smallest id of the records of
    that side with the same n-gram set. overlaps: (eval_class, train_class, shared, eval_n, train_n, similarity,
    containment), one row per pair of classes that reaches the thresholds given (of two, both); similarity is
    shared / all n-grams, containment shared / those of the evaluation record. Without any, similarity 0.8.

    Ids without a side, with another one, or null take no part; an id on both sides counts as 'eval'. Repeated
    rows of an id count once; should they differ, the smallest fingerprint decides. Null tokens count as ''.
    Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    similarity = 0.8 if similarity is None and containment is None else similarity
    shares = [x for x in (similarity, containment) if x is not None]
    if not all(0 < x <= 1 for x in shares):
        raise ValueError("thresholds must be over 0 and at most 1")
    spark = records.sparkSession
    sides = sides.where(F.col("side").isin("train", "eval")).select(F.col("id").cast("long").alias("id"), "side").where("id is not null")
    sides = stash(sides.groupBy("id").agg(F.min("side").alias("side")), "sides")
    eval_ids = sides.where("side = 'eval'").select(F.col("id").alias("key"))
    of_ids = key_filter(eval_ids, eval_ids.count(), most_words)
    sets = stash(_scan(records, n, clean, _of_ids(of_ids)).where("n > 0"), "sets")

    narrow = sets.select("id", "n", "f", "g").join(sides, "id").groupBy("id", "side").agg(F.min(F.struct("n", "f", "g")).alias("s"))
    narrow = stash(narrow.select("id", "side", "s.*"), "narrow")
    firsts = stash(narrow.groupBy("side", "n", "f", "g").agg(F.min("id").alias("class")), "firsts")
    classes = stash(narrow.join(firsts, ["side", "n", "f", "g"]).select("id", "side", "class", "n"), "classes")

    asked = firsts.where("side = 'eval'").select(F.col("class").alias("id"), "n", "f", "g")
    evals = stash(sets.join(asked, ["id", "n", "f", "g"]).select(F.col("id").alias("class"), "n", "grams").dropDuplicates(["class"]), "evals")
    discard(spark, sets, sides, narrow)
    grams = evals.select(F.explode("grams").alias("key"))
    of_grams = key_filter(grams, evals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], most_words)

    given = firsts.where("side = 'train'").select("class", "n", "f", "g")
    scanned = _scan(records, n, clean, _of_grams(of_grams)).drop("id").dropDuplicates(["n", "f", "g"])
    trains = scanned.join(given, ["n", "f", "g"]).select("class", "n", "grams")
    if similarity is not None:  # it cannot reach the threshold with fewer hits
        trains = trains.where(F.size("grams") >= _least(F.col("n"), similarity))
    trains = stash(trains, "trains")

    queries = stash(_queries(evals, trains, max(shares), hot), "queries")
    discard(spark, evals, firsts)
    found = stash(_candidates(queries, trains, similarity, containment), "candidates")
    left = queries.select(F.col("class").alias("eval_class"), F.col("n").alias("eval_n"), "later")
    right = trains.select(F.col("class").alias("train_class"), F.col("n").alias("train_n"), "grams")
    both = found.join(left, "eval_class").join(right, "train_class")
    both = both.withColumn("shared", (F.col("hits") + F.size(F.array_intersect("later", "grams"))).cast("int"))
    both = both.withColumn("similarity", F.col("shared") / (F.col("eval_n") + F.col("train_n") - F.col("shared")))
    both = both.withColumn("containment", F.col("shared") / F.col("eval_n"))
    for column, least in (("similarity", similarity), ("containment", containment)):
        both = both if least is None else both.where(F.col(column) >= least)
    overlaps = stash(both.select("eval_class", "train_class", "shared", "eval_n", "train_n", "similarity", "containment"), "overlaps")
    discard(spark, queries, trains, found)
    return overlaps, classes


def _queries(evals: DataFrame, trains: DataFrame, share: float, hot: int) -> DataFrame:
    """(class, n, now, later): the n-grams of each evaluation class with a hit, to be looked up and put off; classes with too few hits are dropped."""
    counts = trains.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("t"))
    hit = evals.select("class", "n", F.explode("grams").alias("gram")).join(counts, "gram")
    lists = hit.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("t", "gram")), asc=False).alias("a"))
    least = _least(F.col("n"), share)
    off = F.least(least - 1, F.size(F.filter("a", lambda x: x["t"] > hot)))
    kept = lists.where(F.size("a") >= least).withColumn("off", off)
    place = lambda start, size: F.slice("a", start, size)["gram"]
    return kept.select("class", "n", place(F.col("off") + 1, F.size("a")).alias("now"), place(F.lit(1), F.col("off")).alias("later"))


def _candidates(queries: DataFrame, trains: DataFrame, similarity: float | None, containment: float | None) -> DataFrame:
    """(eval_class, train_class, hits): the pairs whose hits, with all that was put off, could reach the thresholds."""
    left = queries.select(F.col("class").alias("eval_class"), F.col("n").alias("en"), F.size("later").alias("off"), F.explode("now").alias("gram"))
    right = trains.select(F.col("class").alias("train_class"), F.col("n").alias("tn"), F.explode("grams").alias("gram"))
    least = [] if containment is None else [_least(F.col("en"), containment)]
    if similarity is not None:
        least.append(_least(F.col("en") + F.col("tn"), similarity / (1 + similarity)))
    least = F.greatest(*least) if len(least) > 1 else least[0]
    hits = left.join(right, "gram").where(least <= F.least("en", "tn"))
    sums = hits.select("eval_class", "train_class", (least - F.col("off")).alias("enough")).groupBy("eval_class", "train_class", "enough")
    return sums.agg(F.count(F.lit(1)).alias("hits")).where("hits >= enough").drop("enough")


def expand_pairs(overlaps: DataFrame, classes: DataFrame) -> DataFrame:
    """(eval_id, train_id, similarity, containment): the overlaps of all records, not of classes only."""
    evals = classes.where("side = 'eval'").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"))
    trains = classes.where("side = 'train'").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"))
    return overlaps.join(evals, "eval_class").join(trains, "train_class").select("eval_id", "train_id", "similarity", "containment")


def overlap_report(overlaps: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, pairs) over the evaluation records of ``labels`` (id, split, source).

    Computed from classes and their sizes, without expanding the pairs. Records too short for an
    n-gram count as records. A null source is a group of its own.
    """
    sizes = classes.where("side = 'train'").groupBy(F.col("class").alias("train_class")).agg(F.count(F.lit(1)).alias("size"))
    per_class = overlaps.join(sizes, "train_class").groupBy(F.col("eval_class").alias("class")).agg(F.sum("size").alias("partners"))
    hit = classes.where("side = 'eval'").select("id", "class").join(per_class, "class").select("id", "partners")
    sums = labels.join(hit, "id", "left").groupBy("split", "source")
    pairs = F.coalesce(F.sum("partners"), F.lit(0)).cast("long")
    return sums.agg(F.count(F.lit(1)).alias("records"), F.count("partners").alias("overlapping"), pairs.alias("pairs"))
