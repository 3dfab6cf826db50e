"""Feed-forward scoring of mentions and pairs in Arrow batches.

Dense pair inputs (1364 floats) are never shuffled, nor is an embedding sent along with a pair: pairs and embeddings
meet by document, each once, and the input is gathered by index where it is multiplied. Only scores leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layers = list[tuple[np.ndarray, np.ndarray]]

#: Default sizes of the hidden layers; both networks end in two affine layers of one output.
HIDDEN = (1000, 500, 500)


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    """Affine layers, each followed by a rectifier while it has more than one output. Weights are (outputs, inputs)."""
    for w, b in layers:
        x = x @ w.T + b
        if w.shape[0] > 1:
            x = np.maximum(x, 0)
    return x[:, 0]


def random_layers(inputs: int, hidden: tuple[int, ...] = HIDDEN, seed: int = 0) -> Layers:
    """Seeded weights (uniform by fan-in and fan-out) and zero biases."""
    rng, sizes = np.random.default_rng(seed), [inputs, *hidden, 1, 1]
    bound = [np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return [(rng.uniform(-r, r, (b, a)), np.zeros(b)) for a, b, r in zip(sizes, sizes[1:], bound)]


def score_vectors(rows: DataFrame, layers: Layers, features: str = "features", out: str = "score") -> DataFrame:
    """Replace the feature array by the network's score. A null or short array gives a null score."""
    width = layers[0][0].shape[1]
    model = rows.sparkSession.sparkContext.broadcast(layers)  # bounded by the model
    kept = [f for f in rows.schema.fields if f.name not in (features, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{out} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, matrix = _matrix(batch[features], width)
            scores = np.full(batch.num_rows, np.nan)
            scores[good] = forward(model.value, matrix)
            columns = [*(batch[f.name] for f in kept), pa.array(scores, pa.float64(), mask=np.isnan(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), out])

    return rows.select(*[F.col(f.name) for f in kept], features).mapInArrow(run, schema)


def _matrix(lists: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of lists have ``width`` numbers (by default, as many as the longest), and these as a matrix."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    good = sizes == width
    values = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return good, values.reshape(int(good.sum()), width)


def score_pairs(pairs: DataFrame, vectors: DataFrame, layers: Layers, rows: int = 20_000) -> DataFrame:
    """(doc_id, men_idx, ant_idx, score). pairs: (doc_id, men_idx, ant_idx, features); vectors: (doc_id, m_idx, embedding).

    The input is antecedent embedding, mention embedding, pair features. A document's embeddings are one matrix, sent once;
    its pairs are multiplied ``rows`` at a time. A pair of a mention without an embedding, or without features, has a null score.
    """
    model = pairs.sparkSession.sparkContext.broadcast(layers)  # bounded by the model
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scores = np.full(left.num_rows, np.nan)
        if left.num_rows and right.num_rows:
            order = np.argsort(right["m_idx"].to_numpy(), kind="stable")
            held, matrix = _matrix(right["embedding"].take(pa.array(order)).combine_chunks())
            known = right["m_idx"].to_numpy()[order][held]
            good, dense = _matrix(left["features"].combine_chunks())
            sides = [left[c].to_numpy() for c in ("ant_idx", "men_idx")]
            if len(known):
                places = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in sides]
                whole = good & (known[places[0]] == sides[0]) & (known[places[1]] == sides[1])
                at = np.cumsum(good) - 1  # the row of ``dense`` of each good pair
                wanted = np.flatnonzero(whole)
                for k in range(0, len(wanted), rows):
                    part = wanted[k : k + rows]
                    scores[part] = forward(model.value, np.hstack([matrix[places[0][part]], matrix[places[1][part]], dense[at[part]]]))
        out = pa.array(scores, pa.float64(), mask=np.isnan(scores))
        return pa.table([left["doc_id"], left["men_idx"], left["ant_idx"], out], names=["doc_id", "men_idx", "ant_idx", "score"])

    asked = pairs.select("doc_id", F.col("men_idx").cast("int").alias("men_idx"), F.col("ant_idx").cast("int").alias("ant_idx"), "features")
    given = vectors.select(F.col("doc_id").alias("doc"), F.col("m_idx").cast("int").alias("m_idx"), "embedding")
    return asked.groupBy("doc_id").cogroup(given.groupBy("doc")).applyInArrow(run, f"doc_id {kind}, men_idx int, ant_idx int, score double")


def score_words(rows: DataFrame, layers: Layers, vectors: np.ndarray, out: str = "score") -> DataFrame:
    """Scores of inputs that name words instead of holding their vectors: (words, spans, features) arrays per row.

    words: numbers of rows of ``vectors``, the tuned matrix, in the order of the network's inputs; spans: averages, features: the rest.
    The network's input is spans, words' vectors, features. A null array, or one of another length, gives a null score.
    """
    model = rows.sparkSession.sparkContext.broadcast((layers, vectors))  # bounded by the model
    width = layers[0][0].shape[1]
    keep = [c for c in rows.columns if c not in ("words", "spans", "features")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep), f"{out} double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layers, vectors = model.value
        for frame in frames:
            size = [sum(np.shape(x)[0] * k for x, k in ((w, vectors.shape[1]), (s, 1), (f, 1))) if w is not None and s is not None and f is not None else -1
                    for w, s, f in zip(frame["words"], frame["spans"], frame["features"])]
            good, scores = np.array(size) == width, np.full(len(frame), np.nan)
            if good.any():
                words, spans, rest = (np.stack(frame.loc[good, c].to_numpy()) for c in ("words", "spans", "features"))
                scores[good] = forward(layers, np.hstack([spans, vectors[words.astype(int)].reshape(len(words), -1), rest]).astype(np.float64))
            yield frame[keep].assign(**{out: scores})

    return rows.mapInPandas(run, schema).withColumn(out, F.when(F.isnan(out), None).otherwise(F.col(out)))


def candidate_scores(pair_scores: DataFrame, single_scores: DataFrame) -> DataFrame:
    """(doc_id, m_idx, scores): each mention's scores of its antecedents in order, and of a new entity last."""
    sorted_ = F.array_sort(F.collect_list(F.struct("ant_idx", "score")))
    lists = pair_scores.groupBy("doc_id", F.col("men_idx").alias("m_idx")).agg(F.transform(sorted_, lambda x: x["score"]).alias("own"))
    both = single_scores.select("doc_id", "m_idx", "score").join(lists, ["doc_id", "m_idx"], "left")
    return both.select("doc_id", "m_idx", F.concat(F.coalesce("own", F.array().cast("array<double>")), F.array("score")).alias("scores"))


def rule_scores(pairs: DataFrame) -> DataFrame:
    """A stand-in score from compressed pair features ``f``: 10 exact + 5 heads + 3 relaxed - the mention distance's bin."""
    from corefold.functions.features import distance_bin

    at = lambda i: F.get("f", F.lit(i))
    return pairs.withColumn("score", (10 * at(4) + 5 * at(3) + 3 * at(5) - distance_bin(at(7))).cast("double"))
