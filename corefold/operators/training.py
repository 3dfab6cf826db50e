"""Labels, ranking targets, batches, padding and losses of the training data, and a trainer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefold.functions.features import clipped_sigmoid
from corefold.operators.pairs import with_sides
from corefold.operators.scoring import Layers
from corefold.runtime import discard, stash

# Default costs of a false new entity, a false link and a wrong link.
COSTS = {"FN": 0.8, "FL": 0.4, "WL": 1.0}


def pair_labels(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Add label: 1 if both mentions have the same gold label, which must not be null; else 0."""
    joined = with_sides(pairs, mentions.select("doc_id", "m_idx", "gold_label"), ("__a", "__m"))
    same = (F.col("__a.gold_label") == F.col("__m.gold_label")).cast("int")
    return joined.withColumn("label", F.coalesce(same, F.lit(0))).drop("__a", "__m")


def mention_labels(mentions: DataFrame) -> DataFrame:
    """(doc_id, m_idx, label): 1 for a mention without an earlier one of its gold label or without a label; else 0. No pairs are needed."""
    return mentions.select("doc_id", "m_idx", new_entity().alias("label"))


def new_entity() -> Column:
    """The label of ``mention_labels`` as a column over mentions."""
    order = Window.partitionBy("doc_id", "gold_label").orderBy("m_idx")
    return (F.col("gold_label").isNull() | (F.row_number().over(order) == 1)).cast("int")


def ranking_targets(labelled: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """(mention_id, labels, costs, true_ants, false_ants): one row per mention from pairs (mention_id, place, label).

    The last entry of each array stands for a new entity. Positions of true and false candidates are padded with their last
    value to the number of candidates. A mention with a true antecedent pays WL for each wrong one and FN for a new entity;
    one without pays FL for each antecedent and nothing for a new entity. Null labels count as 0.
    """
    rows = labelled.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("label", F.lit(0)).alias("label")))).alias("x"))
    own = rows.select("mention_id", F.transform("x", lambda x: x["label"].cast("int")).alias("y"))
    new = F.when(F.exists("y", lambda y: y == 1), 0).otherwise(1)
    full = own.withColumn("new", new).withColumn("labels", F.concat("y", F.array("new")))
    cost = F.when(F.col("new") == 0, F.concat(F.transform("y", lambda y: costs["WL"] * (1 - y)), F.array(F.lit(costs["FN"])))).otherwise(F.concat(F.transform("y", lambda y: F.lit(costs["FL"])), F.array(F.lit(0.0))))
    places = lambda wanted: F.filter(F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.when(F.get("labels", i) == wanted, i)), lambda i: i.isNotNull())
    padded = lambda c: F.concat(c, F.array_repeat(F.element_at(c, -1), F.size("labels") - F.size(c)))
    return full.withColumn("t", places(1)).withColumn("f", places(0)).select("mention_id", "labels", cost.alias("costs"), padded(F.col("t")).alias("true_ants"), F.when(F.size("f") > 0, padded(F.col("f"))).alias("false_ants"))


def length_batches(mentions: DataFrame, batch_size: int = 600, id_col: str = "mention_id", length_col: str = "pairs_length") -> DataFrame:
    """(id, length, batch): mentions in the order of length and id, a batch closed once the sum of length + 1 exceeds ``batch_size``, or
    when the mentions without pairs end.

    Mentions of one length are alike, so batches follow from the histogram of lengths in closed form; its rows are bounded by the
    longest candidate list. Ranks within a length come from per-bucket counts, never from one global sort.
    """
    rows = mentions.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length"))
    histogram = sorted((r["length"], r["count"]) for r in rows.groupBy("length").count().collect())
    if histogram and histogram[-1][0] >= 1 << 23:
        raise ValueError("a length is too large to be coded with its rank")
    plan = _batch_plan(histogram, batch_size)
    code = np.array([(n << 40) + first for n, first, *_ in plan], np.int64)
    base, each = (np.array([p[i] for p in plan], np.int64) for i in (2, 3))

    def batch(length: pd.Series, rank: pd.Series) -> pd.Series:
        asked = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        k = np.maximum(np.searchsorted(code, asked, "right") - 1, 0)
        return pd.Series(base[k] + (asked - code[k]) // each[k])

    ranked = rank_within(rows, "length", "id", sum(n for _, n in histogram))
    return ranked.select("id", "length", F.pandas_udf(batch, "long")("length", "rank").alias("batch"))


def _batch_plan(histogram: list[tuple[int, int]], batch_size: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first batch, mentions per batch) of stretches of equal length."""
    plan, batch, held, size = [], 0, 0, 0
    for length, count in histogram:
        first = 0
        while first < count:
            if size > batch_size or (held and size == held and length):
                batch, held, size = batch + 1, 0, 0
            room = max(0, batch_size - size) // (length + 1) + 1
            take = min(room, count - first)
            if held == 0 and count - first > room:
                full = (count - first) // room
                plan.append((length, first, batch, room))
                first += full * room
                batch, held, size = batch + full - 1, room, room * (length + 1)
                continue
            plan.append((length, first, batch, max(take, 1)))
            first, held, size = first + take, held + take, size + take * (length + 1)
    return plan


def rank_within(rows: DataFrame, group: str, order: str, total: int, bucket_rows: int = 500_000) -> DataFrame:
    """Add rank: the row's position, from 0, in the order of ``order`` within its group. Range buckets share the work on a large group."""
    buckets = max(1, total // bucket_rows)
    cuts = [] if buckets == 1 else rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.01)
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + (F.col(order) > cut).cast("int")
    marked = rows.withColumn("__bucket", bucket)
    counts = marked.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order)) - 1
    return marked.withColumn("__within", within).join(offsets, [group, "__bucket"]).withColumn("rank", F.col("__offset") + F.col("__within")).drop("__offset", "__within", "__bucket")


def pad_batches(rows: DataFrame, arrays: list[str], batch: str = "batch") -> DataFrame:
    """Pad arrays, whose last entry stands for a new entity, to the longest of their batch; that entry stays last. Adds mask (1 = padding)."""
    size = F.size(arrays[0])
    longest = F.max(size).over(Window.partitionBy(batch))
    widened = rows.withColumn("__n", longest)
    for name in arrays:
        fill = F.array_repeat(F.lit(0).cast(rows.schema[name].dataType.elementType), F.col("__n") - size)
        widened = widened.withColumn(f"__{name}", F.concat(F.slice(name, 1, size - 1), fill, F.slice(name, size, 1)))
    mask = F.concat(F.array_repeat(F.lit(0), size - 1), F.array_repeat(F.lit(1), F.col("__n") - size), F.array(F.lit(0)))
    widened = widened.withColumn("mask", mask)
    return widened.select(*[F.col(f"__{c}").alias(c) if c in arrays else c for c in rows.columns], "mask")


def all_pairs_loss(rows: DataFrame, n: float) -> DataFrame:
    """(loss): the sum over candidates (score, label, weight) of the weighted logistic loss, over n."""
    x, z = F.col("score"), F.col("label")
    return rows.agg((F.sum(F.col("weight") * (F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x))))) / n).alias("loss"))


def top_pairs_loss(rows: DataFrame, n: float) -> DataFrame:
    """(loss): per mention the best true candidate's and the worst false candidate's log loss, summed, over n. Mentions without a false candidate have the first part only."""
    p = clipped_sigmoid(F.col("score"))
    per = rows.groupBy("mention_id").agg(F.max(F.when(F.col("label") == 1, F.log(p))).alias("t"), F.min(F.when(F.col("label") == 0, F.log(1 - p))).alias("f"))
    return per.agg((F.sum(-F.coalesce("t", F.lit(0.0)) - F.coalesce("f", F.lit(0.0))) / n).alias("loss"))


def ranking_loss(rows: DataFrame, n: float) -> DataFrame:
    """(loss): per mention the largest cost * weight * (1 + score - best true score), summed, over n."""
    best = rows.where("label = 1").groupBy("mention_id").agg(F.max("score").alias("t"))
    margin = F.col("cost") * F.col("weight") * (1 + F.col("score") - F.col("t"))
    return rows.join(best, "mention_id").groupBy("mention_id").agg(F.max(margin).alias("m")).agg((F.sum("m") / n).alias("loss"))


def flat_links(best: DataFrame) -> DataFrame:
    """(flat_idx, linked): the global row of the chosen antecedent from (flat_idx, n_pairs, choice); null where the choice is a new entity."""
    return best.select("flat_idx", F.when(F.col("choice") < F.col("n_pairs"), F.col("flat_idx") - F.col("n_pairs") + F.col("choice")).alias("linked"))


def array_invariants(counts: DataFrame) -> DataFrame:
    """Documents (doc_id, n, p) that break p = n (n - 1) / 2; none for data with all pairs."""
    return counts.where(F.col("p") != F.col("n") * (F.col("n") - 1) / 2)


def batch_order(batches: DataFrame, seed: int) -> DataFrame:
    """(batch): the different batches of a table, sorted in a seeded random order."""
    return batches.select("batch").distinct().orderBy(F.xxhash64(F.lit(seed), "batch"), "batch")


def write_batch_sizes(batches: DataFrame, path: str) -> None:
    """Dump the batches of ``length_batches`` as text: longest length and number of mentions, by tab, in the order of batches."""
    sizes = batches.groupBy("batch").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n"))
    lines = sizes.orderBy("batch").select(F.concat_ws("\t", F.col("length").cast("string"), F.col("n").cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def candidates(rows: DataFrame) -> DataFrame:
    """(mention_id, features, labels, costs): the trainer's input, one row per mention, from candidates (mention_id, place, features, label, cost)."""
    one = F.struct("place", "features", F.col("label").cast("int").alias("label"), F.col("cost").cast("double").alias("cost"))
    lists = rows.groupBy("mention_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return lists.select("mention_id", *[F.col(f"x.{c}").alias(name) for c, name in (("features", "features"), ("label", "labels"), ("cost", "costs"))])


@dataclass
class Trained:
    """layers: after the last epoch; best: those with the highest score, without an evaluation with the lowest loss. scalars: (stage, epoch, loss, rate, score)."""

    layers: Layers
    best: Layers
    scalars: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.scalars, "stage string, epoch int, loss double, rate double, score double")


#: The stages in their order.
STAGES = ("all_pairs", "top_pairs", "ranking")


def train(
    rows: DataFrame,
    layers: Layers,
    stage: str = "all_pairs",
    epochs: int = 20,
    rate: float = 0.01,
    decay: float = 0.9,
    patience: int = 3,
    factor: float = 0.5,
    evaluate: Callable[[Layers], float] | None = None,
    every: int = 1,
    fan_in: int = 32,
) -> Trained:
    """Fit a network to ``candidates`` by full-batch RMSprop on the loss of a stage.

    all_pairs: the logistic loss of each candidate; top_pairs: that of the best true and the worst false one of each mention; ranking:
    each mention's largest cost * (1 + score - best true score). Every task sums the gradients of its mentions; sums are merged in
    rounds of ``fan_in``, so that at most as many, each of the model's size, reach the driver. The rate is cut by ``factor``
    after ``patience`` epochs without a lower loss. evaluate scores the network every ``every`` epochs.
    """
    if stage not in STAGES:
        raise ValueError(stage)
    spark = rows.sparkSession
    layers = [(w.astype(float).copy(), b.astype(float).copy()) for w, b in layers]
    square = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    data = stash(rows.select("features", "labels", "costs"), "candidates")
    out = Trained(layers, [(w.copy(), b.copy()) for w, b in layers])
    lowest, highest, waits = np.inf, -np.inf, 0
    for epoch in range(epochs):
        flat, loss = _gradient(data, layers, stage, fan_in)
        if flat is None:
            break
        at = 0
        for (w, b), (sw, sb) in zip(layers, square):
            for value, mean in ((w, sw), (b, sb)):
                g = flat[at : at + value.size].reshape(value.shape)
                at += value.size
                mean *= decay
                mean += (1 - decay) * g * g
                value -= rate * g / (np.sqrt(mean) + 1e-8)
        score = evaluate(layers) if evaluate and (epoch + 1) % every == 0 else None
        out.scalars.append((stage, epoch, float(loss), float(rate), score))
        if score is not None and score > highest or evaluate is None and loss < lowest:
            highest = score if score is not None else highest
            out.best = [(w.copy(), b.copy()) for w, b in layers]
        if loss < lowest - 1e-6:
            lowest, waits = loss, 0
        else:
            waits += 1
            if waits >= patience:
                rate, waits = rate * factor, 0
    discard(spark, data)
    return out


def train_stages(rows: DataFrame, layers: Layers, epochs: dict[str, int], rates: dict[str, float] | None = None, **options) -> Trained:
    """All pairs, then top pairs, then ranking, each from the best network of the one before. epochs and rates: by stage; a stage without epochs is left out."""
    out = Trained(layers, layers)
    for stage in STAGES:
        if epochs.get(stage):
            done = train(rows, out.best, stage, epochs[stage], (rates or {}).get(stage, 0.01), **options)
            out = Trained(done.layers, done.best, out.scalars + done.scalars)
    return out


def _gradient(data: DataFrame, layers: Layers, stage: str, fan_in: int) -> tuple[np.ndarray | None, float]:
    """The mean gradient over all mentions, flat, and the mean loss."""
    model = data.sparkSession.sparkContext.broadcast(layers)  # bounded by the model

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = 0.0, 0.0, 0
        for frame in frames:
            for features, labels, costs in zip(frame["features"], frame["labels"], frame["costs"]):
                x = np.stack([np.asarray(v, float) for v in features])
                part, value = _backward(model.value, x, stage, np.asarray(labels, float), np.asarray(costs, float))
                total, loss, n = total + part, loss + value, n + 1
        if n:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "g": [total], "loss": [loss], "n": [n]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [group["slot"].iloc[0]], "g": [np.sum(np.stack(group["g"].to_numpy()), axis=0)], "loss": [group["loss"].sum()], "n": [group["n"].sum()]})

    schema = "slot int, g array<double>, loss double, n long"
    parts, slots = data.mapInPandas(own, schema), data.rdd.getNumPartitions()
    while slots > fan_in:
        slots = -(-slots // fan_in)
        parts = parts.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int")).groupBy("slot").applyInPandas(merged, schema)
    held = parts.collect()  # at most ``fan_in`` rows
    model.unpersist()
    n = sum(p["n"] for p in held)
    return (sum(np.array(p["g"]) for p in held) / n, sum(p["loss"] for p in held) / n) if n else (None, 0.0)


def _slopes(stage: str, s: np.ndarray, y: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    """The derivative of a mention's loss by its candidates' scores, and the loss."""
    p = np.clip(1 / (1 + np.exp(-s)), 1e-7, 1 - 1e-7)
    if stage == "all_pairs":
        return p - y, float((np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s)))).sum())
    slope, loss = np.zeros_like(s), 0.0
    true, false = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    best = true[np.argmax(s[true])] if len(true) else None
    if stage == "top_pairs":
        if best is not None:
            slope[best] += p[best] - 1
            loss -= float(np.log(p[best]))
        if len(false):
            worst = false[np.argmax(s[false])]
            slope[worst] += p[worst]
            loss -= float(np.log(1 - p[worst]))
    elif best is not None:
        margin = costs * (1 + s - s[best])
        top = int(np.argmax(margin))
        slope[top] += costs[top]
        slope[best] -= costs[top]
        loss = float(margin[top])
    return slope, loss


def _backward(layers: Layers, x: np.ndarray, stage: str, label: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    inputs = []
    for w, b in layers:
        inputs.append(x)
        x = x @ w.T + b
        if w.shape[0] > 1:
            x = np.maximum(x, 0)
    slope, loss = _slopes(stage, x[:, 0], label, costs)
    delta, out = slope[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        w, _ = layers[k]
        out[:0] = [delta.T @ inputs[k], delta.sum(0)]
        if k:
            delta = delta @ w
            if layers[k - 1][0].shape[0] > 1:
                delta = delta * (inputs[k] > 0)
    return np.concatenate([g.ravel() for g in out]), loss
