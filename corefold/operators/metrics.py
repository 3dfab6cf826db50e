"""Scores of a response clustering against a key clustering: MUC, B-cubed, CEAF, BLANC and mention identification.

Input: (doc_id, entity, mention, seq), one row per mention of an entity; a mention is any value that tells spans
apart within a document. Everything but the assignment in CEAF is sums over one overlap table (doc_id, key
entity, response entity, shared mentions); no pairs of mentions are formed. Counters are made per document and
summed over documents, so scores are micro averages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["recall_num", "recall_den", "precision_num", "precision_den"]
METRICS = ["muc", "bcub", "ceafm", "ceafe"]


def first_occurrences(side: DataFrame) -> DataFrame:
    """(doc_id, entity, mention): every mention once, in the entity where it came first by ``seq``; equal seqs go to the smallest entity."""
    return side.where(F.col("mention").isNotNull()).groupBy("doc_id", "mention").agg(F.min(F.struct("seq", "entity")).alias("f")).select("doc_id", F.col("f.entity").alias("entity"), "mention")


def overlaps(key: DataFrame, response: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of key entities, sizes of response entities, overlaps). Response documents that the key lacks are ignored."""
    k = first_occurrences(key)
    r = first_occurrences(response).join(k.select("doc_id").distinct(), "doc_id", "left_semi")
    ks = k.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    rs = r.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    shared = k.select("doc_id", "mention", F.col("entity").alias("k")).join(r.select("doc_id", "mention", F.col("entity").alias("r")), ["doc_id", "mention"])
    return ks, rs, shared.groupBy("doc_id", "k", "r").agg(F.count(F.lit(1)).alias("s"))


def _sized(ks: DataFrame, rs: DataFrame, shared: DataFrame) -> DataFrame:
    a = ks.select("doc_id", F.col("entity").alias("k"), F.col("n").alias("kn"))
    b = rs.select("doc_id", F.col("entity").alias("r"), F.col("n").alias("rn"))
    return shared.join(a, ["doc_id", "k"]).join(b, ["doc_id", "r"])


def document_counters(key: DataFrame, response: DataFrame, ceaf: bool = True) -> DataFrame:
    """(doc_id, metric, recall_num, recall_den, precision_num, precision_den) for ident, muc, bcub and, if asked, ceafm and ceafe."""
    ks, rs, shared = overlaps(key, response)
    sized = _sized(ks, rs, shared)
    a = ks.groupBy("doc_id").agg(F.sum("n").alias("k_mentions"), F.sum(F.col("n") - 1).alias("k_links"), F.count(F.lit(1)).alias("k_entities"))
    b = rs.groupBy("doc_id").agg(F.sum("n").alias("r_mentions"), F.sum(F.col("n") - 1).alias("r_links"), F.count(F.lit(1)).alias("r_entities"))
    c = sized.groupBy("doc_id").agg(
        F.sum("s").alias("common"), F.sum(F.col("s") - 1).alias("links"), F.sum(F.col("s") * F.col("s") / F.col("kn")).alias("b_recall"), F.sum(F.col("s") * F.col("s") / F.col("rn")).alias("b_precision")
    )
    docs = a.join(b, "doc_id", "left").join(c, "doc_id", "left")
    if ceaf:
        docs = docs.join(_assigned(sized), "doc_id", "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    row = lambda name, *cols: F.struct(F.lit(name).alias("metric"), *[num(c).alias(out) for c, out in zip(cols, COUNTERS)])
    rows = [row("ident", "common", "k_mentions", "common", "r_mentions"), row("muc", "links", "k_links", "links", "r_links"), row("bcub", "b_recall", "k_mentions", "b_precision", "r_mentions")]
    if ceaf:
        rows += [row("ceafm", "phi_m", "k_mentions", "phi_m", "r_mentions"), row("ceafe", "phi_e", "k_entities", "phi_e", "r_entities")]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def _assigned(sized: DataFrame) -> DataFrame:
    """(doc_id, phi_m, phi_e): the best one-to-one assignment's total similarity, by shared mentions and by the entity-based ratio.

    Documents come in order in each partition, and all documents of a batch are solved together; a document whose rows reach over batches waits for its last one.
    """
    kind = sized.schema["doc_id"].dataType.simpleString()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        doc, names = pd.factorize(frame["doc_id"])
        k = frame.groupby([doc, frame["k"].to_numpy()]).ngroup().to_numpy()
        r = frame.groupby([doc, frame["r"].to_numpy()]).ngroup().to_numpy()
        s = frame["s"].to_numpy(float)
        ratio = 2 * s / (frame["kn"].to_numpy(float) + frame["rn"].to_numpy(float))
        edges, totals = best_assignments(k, r, [s, ratio])
        phi = [np.bincount(doc[edges], weights=t, minlength=len(names)) for t in totals]
        return pd.DataFrame({"doc_id": names, "phi_m": phi[0], "phi_e": phi[1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(frame):
                last = frame["doc_id"] == frame["doc_id"].iloc[-1]
                held = frame[last]
                if not last.all():
                    yield solve(frame[~last].reset_index(drop=True))
        if held is not None and len(held):
            yield solve(held.reset_index(drop=True))

    return sized.select("doc_id", "k", "r", "s", "kn", "rn").repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, f"doc_id {kind}, phi_m double, phi_e double")


def best_assignments(rows: np.ndarray, cols: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The largest total weight of a one-to-one assignment of each connected component of a sparse bipartite graph.

    Returns one edge of each component and, for each of the weightings, the components' totals.
    """
    n = int(rows.max()) + 1
    label = np.arange(n + int(cols.max()) + 1)
    while True:
        low = np.minimum(label[rows], label[n + cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, n + cols, low)
        if (new == label).all():
            break
        label = new
    part = label[rows]
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    sizes = np.diff(np.r_[starts, len(order)])
    totals = [np.maximum.reduceat(w[order], starts) for w in weights]  # right where one side is a single entity
    for c in np.flatnonzero(sizes > 1):
        chunk = order[starts[c] : starts[c] + sizes[c]]
        a, b = np.unique(rows[chunk], return_inverse=True)[1], np.unique(cols[chunk], return_inverse=True)[1]
        if a.max() and b.max():
            for w, total in zip(weights, totals):
                dense = np.zeros((a.max() + 1, b.max() + 1))
                dense[a, b] = w[chunk]
                total[c] = hungarian(dense if dense.shape[0] <= dense.shape[1] else dense.T)
    return order[starts], totals


def best_assignment(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> float:
    """The largest total weight of a one-to-one assignment of a sparse bipartite graph."""
    return float(best_assignments(rows, cols, [weights])[1][0].sum())


def hungarian(gain: np.ndarray) -> float:
    """The largest total of a matching of all rows to distinct columns (rows <= columns): shortest augmenting paths with potentials."""
    n, m = gain.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    cost = gain.max() - gain
    for row in range(n):
        dist, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        here, column, base = row, -1, 0.0
        while True:
            reduced = base + cost[here] - u[here] - v
            closer = ~done & (reduced < dist)
            dist[closer], parent[closer] = reduced[closer], column
            column = int(np.where(done, np.inf, dist).argmin())
            base = dist[column]
            if match[column] < 0:
                break
            done[column] = True
            here = match[column]
        seen = np.flatnonzero(done)
        u[match[seen]] += base - dist[seen]
        v[seen] -= base - dist[seen]
        u[row] += base
        while column >= 0:
            before = parent[column]
            match[column] = row if before < 0 else match[before]
            column = before
    return float(gain[match[match >= 0], np.flatnonzero(match >= 0)].sum())


def blanc_counters(key: DataFrame, response: DataFrame) -> DataFrame:
    """(doc_id, ck, cr, cc, nk, nr, nn): coreference and other links of key, response and both, in closed form."""
    ks, rs, shared = overlaps(key, response)
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    a = ks.groupBy("doc_id").agg(F.sum(two("n")).alias("ck"), F.sum("n").alias("kn"))
    b = rs.groupBy("doc_id").agg(F.sum(two("n")).alias("cr"), F.sum("n").alias("rn"))
    c = shared.groupBy("doc_id").agg(F.sum(two("s")).alias("cc"), F.sum("s").alias("c"))
    per_k = shared.groupBy("doc_id", "k").agg(F.sum("s").alias("s")).groupBy("doc_id").agg(F.sum(two("s")).alias("in_k"))
    per_r = shared.groupBy("doc_id", "r").agg(F.sum("s").alias("s")).groupBy("doc_id").agg(F.sum(two("s")).alias("in_r"))
    docs = a.join(b, "doc_id", "left").join(c, "doc_id", "left").join(per_k, "doc_id", "left").join(per_r, "doc_id", "left").na.fill(0)
    return docs.select("doc_id", "ck", "cr", "cc", (two("kn") - F.col("ck")).alias("nk"), (two("rn") - F.col("cr")).alias("nr"), (two("c") - F.col("in_k") - F.col("in_r") + F.col("cc")).alias("nn"))


def blanc_scores(counters: DataFrame) -> DataFrame:
    """(metric, recall, precision, f1): the mean over coreference and other links; where the key lacks one kind, the other kind alone."""
    t = counters.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).cast("double").alias(c) for c in ("ck", "cr", "cc", "nk", "nr", "nn")])
    part = lambda both, k, r: F.struct(_ratio(F.col(both), F.col(k)).alias("recall"), _ratio(F.col(both), F.col(r)).alias("precision"), _f1(_ratio(F.col(both), F.col(k)), _ratio(F.col(both), F.col(r))).alias("f1"))
    t = t.withColumn("c", part("cc", "ck", "cr")).withColumn("n", part("nn", "nk", "nr"))
    pick = lambda f: F.when((F.col("ck") == 0) & (F.col("nk") == 0), 0.0).when(F.col("ck") == 0, F.col("n")[f]).when(F.col("nk") == 0, F.col("c")[f]).otherwise((F.col("c")[f] + F.col("n")[f]) / 2)
    return t.select(F.lit("blanc").alias("metric"), *[pick(f).alias(f) for f in ("recall", "precision", "f1")])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(recall: Column, precision: Column) -> Column:
    return F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))


def totals(counters: DataFrame) -> DataFrame:
    """(metric, the four counters, recall, precision, f1) over all documents."""
    t = counters.groupBy("metric").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    recall, precision = _ratio(F.col("recall_num"), F.col("recall_den")), _ratio(F.col("precision_num"), F.col("precision_den"))
    return t.select("metric", *COUNTERS, recall.alias("recall"), precision.alias("precision"), _f1(recall, precision).alias("f1"))


def conll_average(scores: DataFrame) -> DataFrame:
    """(conll_f1): the mean F1 of muc, bcub and ceafe."""
    return scores.where(F.col("metric").isin("muc", "bcub", "ceafe")).agg((F.sum("f1") / 3).alias("conll_f1"))
